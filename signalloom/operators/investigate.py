"""The queries an engineer asks of events and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.rules import IMPORTANT_TOKENS
from ..session import staged
from .ordering import with_position

# What a diagnosis says.
CAUSE_UNKNOWN_TIMEOUT = ("Timeout pattern detected. Check network stability, transport delay, "
                         "radio conditions and retry policy.")
CAUSE_UNKNOWN_FAILURE = ("Failure signals detected, but exact cause is not extracted yet. "
                         "Inspect raw trace around failed events.")
CAUSE_UNKNOWN = "No clear failure cause detected yet."
ADVICE = {
    "timeout": "Check timeout thresholds, network stability, signaling delay and retry behavior.",
    "retry": "Compare retry count with historical successful retries before escalation.",
    "failure": "Inspect failed trace lines and compare with similar incidents.",
    "chunks": "Review important chunks and similar historical patterns.",
    "none": "No immediate action detected.",
}


def _col(df: DataFrame, name: str, kind: str = "string") -> Column:
    """A column, or null where the table has none of that name."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _true(col: Column) -> Column:
    return F.coalesce(col, F.lit(False))


def is_failure() -> Column:
    return (
        _true(F.col("result") == "failed")
        | _true(F.col("event_family") == "failure")
        | _true(F.expr(tx.contains_any("lower(event_name)", ("fail", "reject"))))
    )


def is_retry(events: DataFrame) -> Column:
    return (
        _true(_col(events, "retry_recommended", "boolean"))
        | _true(F.col("event_family") == "retry")
        | _true(F.lower(F.col("event_name")).contains("retry"))
        | _true(F.lower(F.col("cause")).contains("retry"))
    )


def _names_timeout() -> Column:
    return _true(F.col("event_name") == "TIMEOUT") | _true(F.col("cause") == "TIMEOUT")


def is_timeout() -> Column:
    return _names_timeout() | _true(F.col("event_family") == "timing")


def testcase_overview(events: DataFrame) -> DataFrame:
    """Per testcase: first operator and country, worst severity, event and failure counts."""
    failed = _true(F.col("result") == "failed") | _true(F.col("event_family") == "failure")
    first = F.min_by(F.struct("operator", "country", "severity"), "seq")
    grouped = events.groupBy(F.coalesce("testcase_id", F.lit("unknown")).alias("testcase_id")).agg(
        first.alias("first"),
        F.count(F.lit(1)).alias("events"),
        F.count_if(failed).alias("failures"),
        F.count_if(_true(_col(events, "retry_recommended", "boolean"))).alias("retry_recommended"),
        F.bool_or(_true(F.col("severity") == "high")).alias("any_high"),
        F.bool_or(_true(F.col("severity") == "medium")).alias("any_medium"),
    )
    return grouped.select(
        "testcase_id",
        F.col("first.operator").alias("operator"),
        F.col("first.country").alias("country"),
        F.when(F.col("any_high"), "high").when(F.col("any_medium"), "medium")
        .otherwise(F.col("first.severity")).alias("severity"),
        "events",
        "failures",
        "retry_recommended",
    ).orderBy("testcase_id")


def testcase_ids(events: DataFrame) -> DataFrame:
    present = F.coalesce(F.col("testcase_id"), F.lit("")) != ""
    return events.filter(present).select("testcase_id").distinct().orderBy("testcase_id")


def of_testcase(table: DataFrame, testcase: str) -> DataFrame:
    """Rows of one testcase; the filter reaches the Parquet scan."""
    return table.filter(F.col("testcase_id") == testcase)


def of_chunk(table: DataFrame, chunk_id: str) -> DataFrame:
    return table.filter(F.col("chunk_id") == chunk_id)


def global_kpis(events: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Testcases, events, failures, retries, high-severity events and summaries: one row."""
    kpis = events.agg(
        F.count_distinct(F.coalesce("testcase_id", F.lit("unknown"))).alias("testcases"),
        F.count(F.lit(1)).alias("events"),
        F.count_if(is_failure()).alias("failures"),
        F.count_if(is_retry(events)).alias("retries"),
        F.count_if(_true(F.col("severity") == "high")).alias("high_severity"),
    )
    if summaries is None:
        return kpis.withColumn("summaries", F.lit(0).cast("long"))
    return kpis.withColumn("summaries", summaries.agg(F.count(F.lit(1))).scalar())


def _first(value: Column, order: str, when: Column | None = None) -> Column:
    """First non-empty value in row order."""
    usable = tx.blank_to_null(value)
    usable = usable if when is None else F.when(when, usable)
    return F.min_by(usable, F.when(usable.isNotNull(), F.col(order)))


def investigation_header(events: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per testcase: operator, country, main failure, cause, action and the signal counts.

    Operator and country fall back to the first chunk that names one.
    """
    per_case = events.groupBy("testcase_id").agg(
        _first(F.col("operator"), "seq").alias("_operator"),
        _first(F.col("country"), "seq").alias("_country"),
        _first(F.col("event_name"), "seq", is_failure()).alias("main_failure"),
        _first(F.col("cause"), "seq").alias("main_cause"),
        _first(_col(events, "recommendation"), "seq").alias("recommended_action"),
        F.count_if(is_failure()).alias("failures"),
        F.count_if(is_retry(events)).alias("retries"),
        F.count_if(is_timeout()).alias("timeouts"),
        F.count_if(_true(F.col("severity") == "high")).alias("high_events"),
        F.bool_or(_names_timeout()).alias("_named_timeout"),
    )
    per_chunk = chunks.groupBy("testcase_id").agg(
        _first(F.get("operators", F.lit(0)), "chunk_index").alias("_chunk_operator"),
        _first(F.get("countries", F.lit(0)), "chunk_index").alias("_chunk_country"),
        F.count(F.lit(1)).alias("chunks"),
    )
    both = per_case.join(per_chunk, "testcase_id", "full").fillna(
        0, ["failures", "retries", "timeouts", "high_events", "chunks"]
    )
    return both.select(
        "testcase_id",
        F.coalesce("_operator", "_chunk_operator").alias("operator"),
        F.coalesce("_country", "_chunk_country").alias("country"),
        "main_failure",
        "main_cause",
        "recommended_action",
        "failures",
        "retries",
        "timeouts",
        "high_events",
        "chunks",
        _true(F.col("_named_timeout")).alias("named_timeout"),
    )


def diagnosis(header: DataFrame) -> DataFrame:
    """Problem, cause and action texts from investigation headers."""

    def known(name: str, default: str) -> Column:
        return F.coalesce(F.col(name), F.lit(default))

    problem = F.concat(
        F.lit("Detected "),
        F.when(F.col("high_events") > 0, "high").otherwise("medium"),
        F.lit(" operational issue for operator="),
        known("operator", "unknown"),
        F.lit(", country="),
        known("country", "unknown"),
        F.lit(". Main failure="),
        known("main_failure", "unknown"),
        F.lit(". Cause="),
        known("main_cause", "not extracted yet"),
        F.lit("."),
    )
    cause = (
        F.when(F.col("main_cause").isNotNull(), F.concat(F.lit("Main detected cause: "), F.col("main_cause")))
        .when(F.col("timeouts") > 0, CAUSE_UNKNOWN_TIMEOUT)
        .when(F.col("failures") > 0, CAUSE_UNKNOWN_FAILURE)
        .otherwise(CAUSE_UNKNOWN)
    )
    return header.select(
        "testcase_id",
        problem.alias("problem"),
        cause.alias("likely_cause"),
        F.coalesce("recommended_action", default_recommendation()).alias("action"),
    )


def default_recommendation() -> Column:
    """Advice from an investigation header when no event carries a recommendation."""
    return (
        F.when(F.col("named_timeout"), ADVICE["timeout"])
        .when(F.col("retries") > 0, ADVICE["retry"])
        .when(F.col("failures") > 0, ADVICE["failure"])
        .when(F.col("chunks") > 0, ADVICE["chunks"])
        .otherwise(ADVICE["none"])
    )


def value_distribution(events: DataFrame) -> DataFrame:
    """Per testcase, how often each family, name, severity and cause occurs, ranked."""
    # The columns shown.
    dims = ["event_family", "event_name", "severity", "cause"]
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in dims])
    listed = events.select("testcase_id", "seq", F.explode(pairs).alias("p")).select(
        "testcase_id", "seq", "p.dim", "p.value"
    )
    counts = (
        listed.filter(F.coalesce(F.col("value"), F.lit("")) != "")
        .groupBy("testcase_id", "dim", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
    )
    order = Window.partitionBy("testcase_id", "dim").orderBy(F.desc("n"), "first_seq")
    return counts.withColumn("rank", F.row_number().over(order)).drop("first_seq")


def event_timeline(events: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Events as timeline rows, ordered by ``seq`` within a testcase.

    ``max_chars`` cuts messages for display; sorting is left to the reader.
    """
    return events.select(
        "testcase_id",
        "seq",
        "timestamp",
        "event_name",
        F.col("event_family").alias("family"),
        "severity",
        "result",
        "cause",
        _col(events, "retry_recommended", "boolean").alias("retry"),
        _col(events, "recommendation").alias("recommendation"),
        tx.cut_text(F.col("normalized_message"), max_chars, "...").alias("message"),
    )


def chunk_table(chunks: DataFrame, important_only: bool = False) -> DataFrame:
    """Chunks as display rows; ``important_only`` keeps those with any flag set."""
    flags = ["has_failure", "has_high_severity", "has_retry_recommended"]
    kept = chunks.filter(_true(F.col(flags[0])) | _true(F.col(flags[1])) | _true(F.col(flags[2]))) \
        if important_only else chunks
    return kept.select(
        "testcase_id",
        "chunk_index",
        "chunk_id",
        "event_count",
        F.array_join("event_names", ", ").alias("events"),
        F.array_join("event_families", ", ").alias("families"),
        F.array_join("causes", ", ").alias("causes"),
        *flags,
    )


def raw_evidence(
    events: DataFrame, important_only: bool = True, most: int | None = None, fallback: int | None = None
) -> DataFrame:
    """Raw lines per testcase with their place: the important ones, or all where none is.

    ``most`` keeps the first lines of a testcase, ``fallback`` those of one without important
    lines.  Places are counted in blocks, so no task receives a whole trace.
    """
    line = F.coalesce(
        *[tx.blank_to_null(_col(events, name)) for name in ("raw_message", "raw", "source_line")]
    )
    lines = events.select("testcase_id", "seq", line.alias("line")).filter("line is not null")

    def first(rows: DataFrame, n: int | None) -> DataFrame:
        kept = rows if n is None else rows.filter(F.col("position") <= n)
        return kept.select("testcase_id", F.col("position").cast("int").alias("position"), "seq", "line")

    if not important_only:
        return first(with_position(lines, name="position"), most)
    # written once: lines are read by the hits, by the rest and by what tells them apart
    marked = staged(lines.withColumn("hit", F.expr(tx.contains_any("lower(line)", IMPORTANT_TOKENS))))
    some = marked.groupBy("testcase_id").agg(F.bool_or("hit").alias("some"))
    hits = with_position(marked.filter("hit"), name="position")
    others = with_position(marked.filter("NOT hit"), name="position", per_key=some).filter("NOT some")
    return first(hits, most).unionByName(first(others, most if fallback is None else fallback))


def recommendations(events: DataFrame, most: int | None = None) -> DataFrame:
    """Distinct recommendations per testcase in order of first appearance; ``most`` keeps the first."""
    firsts = (
        events.select("testcase_id", "seq", _col(events, "recommendation").alias("recommendation"))
        .filter(F.coalesce(F.col("recommendation"), F.lit("")) != "")
        .groupBy("testcase_id", "recommendation")
        .agg(F.min("seq").alias("first_seq"))
    )
    order = Window.partitionBy("testcase_id").orderBy("first_seq")
    placed = firsts.withColumn("position", F.row_number().over(order))
    return placed if most is None else placed.filter(F.col("position") <= most)
