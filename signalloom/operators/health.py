"""Campaign health over chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Array columns that are counted.
DIMENSIONS = ["event_families", "severities", "event_names", "causes", "operators", "countries",
              "network_domains", "tags"]
# How many dominant values a report shows, by column.
TOP_VALUES = {"tags": 20}
TOP_DEFAULT = 10

# Weight of each count in the penalty.
PENALTIES = [
    ("failure_chunk_count", 0.20),
    ("retry_chunk_count", 0.10),
    ("high_severity_chunk_count", 0.30),
    ("n_critical", 0.20),
    ("n_timing", 0.05),
    ("n_network_state", 0.05),
]

# Counts that decide the issue cluster and the action.
SIGNALS = {
    "n_critical": ("severities", "critical"),
    "n_timing": ("event_families", "timing"),
    "n_network_state": ("event_families", "network_state"),
    "n_failure": ("event_families", "failure"),
    "n_retry": ("event_families", "retry"),
    "n_plmn": ("causes", "PLMN_NOT_ALLOWED"),
    "n_timeout": ("causes", "TIMEOUT"),
    "n_reject": ("event_names", "REJECT_SIGNAL"),
    "n_not_registered": ("event_names", "NAS_NOT_REGISTERED"),
    "n_detached": ("event_names", "DETACHED"),
}


def _keyed(df: DataFrame, by: str | None) -> tuple[DataFrame, str]:
    return (df.withColumn("_campaign", F.lit(1)), "_campaign") if by is None else (df, by)


def value_counts(chunks: DataFrame, by: str | None = None) -> DataFrame:
    """Occurrences of every value of the counted columns: ``dim``, ``value``, ``n``.

    One pass over the chunks.  ``first_seen`` is where the value first occurs in trace
    order.  Counts are combined per testcase first, with fixed-width hash buffers.
    """
    df, key = _keyed(chunks, by)
    sets = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("vals")) for d in DIMENSIONS])
    listed = df.select(key, "testcase_id", "chunk_index", F.explode(sets).alias("s")).select(
        key, "testcase_id", "chunk_index", F.col("s.dim").alias("dim"),
        F.posexplode("s.vals").alias("pos", "value"),
    )
    place = F.col("chunk_index") * F.lit(1 << 20) + F.col("pos")
    per_case = listed.groupBy(key, "dim", "value", "testcase_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(place).alias("place")
    )
    counts = per_case.groupBy(key, "dim", "value").agg(
        F.sum("n").alias("n"), F.min(F.struct("testcase_id", "place")).alias("first_seen")
    )
    return counts.drop("_campaign") if by is None else counts


def top_values(
    counts: DataFrame, by: str | None = None, most: int = TOP_DEFAULT, most_of: dict[str, int] | None = None
) -> DataFrame:
    """Dominant values per column, most frequent first, ties by first appearance.

    ``most`` values of each column, or as many as ``most_of`` names for it.
    """
    most_of = TOP_VALUES if most_of is None else most_of
    df, key = _keyed(counts, by)
    order = Window.partitionBy(key, "dim").orderBy(F.desc("n"), "first_seen")
    limit = F.lit(most)
    for dim, size in most_of.items():
        limit = F.when(F.col("dim") == dim, F.lit(size)).otherwise(limit)
    widest = max([most, *most_of.values()])
    ranked = df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= widest)
    return ranked.filter(F.col("rank") <= limit).drop("_campaign")


def flag_counts(chunks: DataFrame, by: str | None = None) -> DataFrame:
    """Chunk, trace and testcase counts and the three flag counts; no row without chunks."""
    df, key = _keyed(chunks, by)
    counts = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.count_distinct(F.nullif(F.col("trace_id"), F.lit(""))).alias("unique_trace_count"),
        F.count_distinct(F.nullif(F.col("testcase_id"), F.lit(""))).alias("unique_testcase_count"),
        F.count_if("has_failure").alias("failure_chunk_count"),
        F.count_if("has_retry_recommended").alias("retry_chunk_count"),
        F.count_if("has_high_severity").alias("high_severity_chunk_count"),
    )
    return counts.drop("_campaign") if by is None else counts


def health_status(score: Column, degraded: float = 0.75, critical: float = 0.50) -> Column:
    return F.when(score < critical, "CRITICAL").when(score < degraded, "DEGRADED").otherwise("HEALTHY")


def health_score() -> Column:
    """1 minus the weighted penalty per chunk, within 0 and 1, to four places."""
    penalty = reduce(lambda a, b: a + b, [F.col(name) * F.lit(w) for name, w in PENALTIES])
    share = F.least(penalty / F.greatest(F.col("total_chunks"), F.lit(1)), F.lit(1.0))
    return F.round(F.greatest(F.lit(0.0), F.lit(1.0) - share), 4)


def issue_cluster() -> Column:
    """Name of the dominant issue; the first test that holds wins."""

    def seen(name: str) -> Column:
        return F.col(name) > 0

    # Cluster names in test order.
    return (
        F.when(seen("n_plmn") | seen("n_reject"), "Roaming registration rejection pattern")
        .when(seen("n_timeout") | seen("n_timing"), "Timeout / instability pattern")
        .when(seen("n_not_registered") | seen("n_detached"), "Registration instability pattern")
        .when(seen("n_failure") & seen("n_critical"), "Critical failure-heavy operational pattern")
        .when(seen("n_retry"), "Transient retry-heavy pattern")
        .otherwise("No dominant operational issue cluster detected")
    )


def recommended_action() -> Column:
    """Action text from status, retry decisions and signals; the first test that holds wins."""
    status = F.col("campaign_status")
    # Action texts in test order.
    return (
        F.when(status == "CRITICAL", "Stop automated retries and escalate for manual telecom investigation.")
        .when(F.col("n_do_not_retry") > 0, "Avoid repeated retries for identical failure clusters.")
        .when(F.col("n_cooldown") > 0, "Retry after cooldown and monitor whether instability persists.")
        .when(
            (F.col("n_plmn") > 0) | (F.col("n_network_state") > 0),
            "Escalate to roaming/operator validation before re-running campaign.",
        )
        .when(status == "DEGRADED", "Continue monitoring and retry only selected transient failures.")
        .otherwise("No immediate operational action required.")
    )


def decision_counts(
    retry_reports: DataFrame, decision_col: str = "retry_recommendation", by: str | None = None
) -> DataFrame:
    """Reports per decision, empty decisions left out.

    The column counted by default is one the retry reports do not carry, so the result is
    empty then; ``decision_col="retry_decision"`` counts what they do carry.
    """
    df, key = _keyed(retry_reports, by)
    if decision_col not in df.columns:
        df = df.withColumn(decision_col, F.lit(None).cast("string"))
    kept = df.filter(F.coalesce(F.col(decision_col), F.lit("")) != "")
    counts = kept.groupBy(key, F.col(decision_col).alias("decision")).agg(F.count(F.lit(1)).alias("n"))
    return counts.drop("_campaign") if by is None else counts


def scored(
    chunks: DataFrame,
    retry_reports: DataFrame | None = None,
    decision_col: str = "retry_recommendation",
    by: str | None = None,
    degraded: float = 0.75,
    critical: float = 0.50,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Counts, score, status, issue cluster and action: one row per campaign."""
    decisions = None if retry_reports is None else decision_counts(retry_reports, decision_col, by)
    counts = value_counts(chunks, by) if counts is None else counts
    return _scored(flag_counts(chunks, by), counts, decisions, by, degraded, critical)


def _scored(
    flags: DataFrame, counts: DataFrame, decisions: DataFrame | None, by: str | None, degraded: float, critical: float
) -> DataFrame:
    flags, key = _keyed(flags, by)
    values, _ = _keyed(counts, by)
    signals = values.groupBy(key).agg(
        *[
            F.coalesce(F.sum(F.when((F.col("dim") == dim) & (F.col("value") == value), F.col("n"))), F.lit(0))
            .alias(name)
            for name, (dim, value) in SIGNALS.items()
        ]
    )
    row = flags.join(signals, key, "left").fillna(0, list(SIGNALS))
    if decisions is None:
        row = row.withColumn("n_do_not_retry", F.lit(0)).withColumn("n_cooldown", F.lit(0))
    else:
        decisions, _ = _keyed(decisions, by)
        picked = decisions.groupBy(key).agg(
            F.sum(F.when(F.col("decision") == "do_not_retry", F.col("n"))).alias("n_do_not_retry"),
            F.sum(F.when(F.col("decision") == "retry_after_cooldown", F.col("n"))).alias("n_cooldown"),
        )
        row = row.join(picked, key, "left").fillna(0, ["n_do_not_retry", "n_cooldown"])
    row = (
        row.withColumn("campaign_health_score", health_score())
        .withColumn("campaign_status", health_status(F.col("campaign_health_score"), degraded, critical))
        .withColumn("main_issue_cluster", issue_cluster())
        .withColumn("recommended_action", recommended_action())
    )
    return row.drop("_campaign")


def campaign_health(
    chunks: DataFrame,
    retry_reports: DataFrame | None = None,
    root_causes: DataFrame | None = None,
    decision_col: str = "retry_recommendation",
    by: str | None = None,
    degraded: float = 0.75,
    critical: float = 0.50,
) -> DataFrame:
    """The full health report: scores, dominant values and distributions, one row per campaign."""
    decisions = None if retry_reports is None else decision_counts(retry_reports, decision_col, by)
    causes = None if root_causes is None else cause_counts(root_causes, by)
    return health_of(flag_counts(chunks, by), value_counts(chunks, by), decisions, causes, by, degraded, critical)


def cause_counts(root_causes: DataFrame, by: str | None = None) -> DataFrame:
    """Root-cause reports per campaign."""
    df, key = _keyed(root_causes, by)
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("root_cause_report_count"))
    return counts.drop("_campaign") if by is None else counts


def health_of(
    flags: DataFrame,
    counts: DataFrame,
    decisions: DataFrame | None = None,
    causes: DataFrame | None = None,
    by: str | None = None,
    degraded: float = 0.75,
    critical: float = 0.50,
) -> DataFrame:
    """The health report from its counts: those of ``flag_counts``, ``value_counts``,
    ``decision_counts`` and ``cause_counts``."""
    row, key = _keyed(_scored(flags, counts, decisions, by, degraded, critical), by)
    top, _ = _keyed(top_values(counts, by), by)

    def listed(dim: str) -> Column:
        pairs = F.array_sort(F.collect_list(F.when(F.col("dim") == dim, F.struct("rank", "value", "n"))))
        return F.transform(pairs, lambda p: F.struct(p["value"].alias("value"), p["n"].alias("n")))

    dominant = top.groupBy(key).agg(*[listed(d).alias(f"dominant_{d}") for d in DIMENSIONS if d != "severities"])
    # Severities are a handful of labels.
    values, _ = _keyed(counts.filter(F.col("dim") == "severities"), by)
    severity = values.groupBy(key).agg(
        F.map_from_entries(
            F.transform(
                F.array_sort(F.collect_list(F.struct("first_seen", "value", "n"))),
                lambda s: F.struct(s["value"], s["n"]),
            )
        ).alias("severity_distribution")
    )
    row = row.join(dominant, key, "left").join(severity, key, "left")
    empty = F.expr("cast(map() as map<string,bigint>)")
    if decisions is None:
        row = row.withColumn("retry_decision_distribution", empty)
    else:
        decisions, _ = _keyed(decisions, by)
        spread = decisions.groupBy(key).agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("decision", "n"))))
            .alias("retry_decision_distribution")
        )
        row = row.join(spread, key, "left").withColumn(
            "retry_decision_distribution", F.coalesce("retry_decision_distribution", empty)
        )
    if causes is None:
        row = row.withColumn("root_cause_report_count", F.lit(0).cast("long"))
    else:
        causes, _ = _keyed(causes, by)
        row = row.join(causes, key, "left").fillna(0, ["root_cause_report_count"])
    return row.drop("_campaign", "n_do_not_retry", "n_cooldown", *SIGNALS)
