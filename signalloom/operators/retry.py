"""Retry advice per chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIGH_DISTANCE = 0.01

# Decision, reason and risk by outcome.
OUTCOMES = {
    "high_severity": ("escalate",
                      "High severity telecom failure detected. Manual investigation recommended.",
                      "critical"),
    "recurring": ("do_not_retry",
                  "Highly similar recurring telecom failure pattern detected. "
                  "Retry probability appears low.",
                  "high"),
    "unstable": ("retry_after_cooldown",
                 "Possible transient telecom/network instability detected.",
                 "medium"),
    "refused": ("escalate",
                "Authentication/registration rejection likely requires operator investigation.",
                "high"),
    "failed": ("retry",
               "Operational failure detected but no strong evidence against retry.",
               "low"),
    "clean": ("no_retry_needed",
              "Chunk does not indicate retry-worthy failure.",
              "none"),
}


def reportable(chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """Chunks with a failure, high severity or retry flag; every chunk when none has one.

    The "none has one" test is a scalar subquery of the same plan, not a driver count.
    ``limit`` keeps the first chunks in trace order.
    """
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in ("has_failure", "has_high_severity", "has_retry_recommended")]
    flagged = flags[0] | flags[1] | flags[2]
    some = chunks.agg(F.coalesce(F.bool_or(flagged), F.lit(False))).scalar()
    kept = chunks.filter(flagged | ~some)
    return kept.orderBy("testcase_id", "chunk_index").limit(limit) if limit else kept


def retry_features(chunks: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Chunks with their neighbour count and mean neighbour distance (0 without any)."""
    near = neighbours.groupBy(F.col("query_chunk_id").alias("chunk_id")).agg(
        F.count(F.lit(1)).alias("historical_match_count"), F.avg("distance").alias("mean_distance")
    )
    return (
        chunks.join(near, "chunk_id", "left")
        .withColumn("historical_match_count", F.coalesce("historical_match_count", F.lit(0)))
        .withColumn("mean_distance", F.coalesce("mean_distance", F.lit(0.0)))
    )


def retry_outcome(min_matches: int = 3) -> Column:
    """Outcome of a chunk with features; the first condition that holds wins."""

    def has(column: str, *values: str) -> Column:
        return F.arrays_overlap(F.col(column), F.array(*[F.lit(v) for v in values]))

    failed = F.coalesce(F.col("has_failure"), F.lit(False))
    return (
        F.when(F.coalesce(F.col("has_high_severity"), F.lit(False)), "high_severity")
        .when(
            (F.col("historical_match_count") >= min_matches)
            & (F.col("mean_distance") <= HIGH_DISTANCE)
            & failed,
            "recurring",
        )
        .when(
            has("event_families", "timing", "network_state")
            | has("causes", "TIMEOUT", "RETRY")
            | has("tags", "timeout"),
            "unstable",
        )
        .when(
            has("event_families", "authentication", "registration")
            | has("causes", "NAS_NOT_REGISTERED")
            | has("tags", "REJECT_SIGNAL"),
            "refused",
        )
        .when(failed, "failed")
        .otherwise("clean")
    )


def retry_reports(
    chunks: DataFrame, neighbours: DataFrame, min_matches: int = 3, cooldown_minutes: int = 30
) -> DataFrame:
    """One retry decision per chunk, with the evidence it rests on."""
    decided = retry_features(chunks, neighbours).withColumn("_outcome", retry_outcome(min_matches))
    outcome = F.col("_outcome")

    def column(i: int) -> Column:
        cases = None
        for name, texts in OUTCOMES.items():
            cases = F.when(outcome == name, texts[i]) if cases is None else cases.when(outcome == name, texts[i])
        return cases

    return decided.select(
        "chunk_id",
        "trace_id",
        "testcase_id",
        column(0).alias("retry_decision"),
        column(1).alias("retry_reason"),
        F.when(outcome == "unstable", F.lit(cooldown_minutes)).when(outcome == "failed", F.lit(5))
        .alias("cooldown_minutes"),
        column(2).alias("risk_level"),
        "historical_match_count",
        F.round("mean_distance", 6).alias("average_distance"),
        "event_families",
        "causes",
        "tags",
        "has_failure",
        "has_high_severity",
    )
