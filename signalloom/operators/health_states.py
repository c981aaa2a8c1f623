"""Campaign health that accumulates over loads.

A load (a day's chunks, say) leaves a state: counts per campaign and value, where each value was
first seen, and which traces and testcases there were.  States add up, so the health of all
loads needs their states alone, and a load that is written again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .health import cause_counts, decision_counts, flag_counts, health_of, value_counts

#: Registers of a sketch are 2 ** this; the relative standard error is about 1.04 / sqrt(2 ** 14), 0.8 %.
SKETCH_BITS = 14

_FLAGS = ["total_chunks", "failure_chunk_count", "retry_chunk_count", "high_severity_chunk_count"]
#: Columns whose distinct values a report counts.
_DISTINCT = {"trace_id": "unique_trace_count", "testcase_id": "unique_testcase_count"}


def load_state(
    chunks: DataFrame,
    retry_reports: DataFrame | None = None,
    root_causes: DataFrame | None = None,
    decision_col: str = "retry_decision",
    by: str = "campaign",
    exact: bool = True,
) -> dict[str, DataFrame]:
    """The state of one load, as tables that :func:`merged_health` adds up.

    With ``exact`` the distinct traces and testcases are kept as rows; without, as sketches of
    2 ** SKETCH_BITS registers per campaign.  Chunks of a testcase may come in several loads.
    """
    counts = value_counts(chunks, by)
    state = {"values": counts, "flags": flag_counts(chunks, by).select(by, *_FLAGS)}
    named = {c: F.nullif(F.col(c), F.lit("")) for c in _DISTINCT}
    if exact:
        ids = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), named[c].alias("id")) for c in _DISTINCT]))
        state["ids"] = chunks.select(by, ids.alias("i")).select(by, "i.*").where("id IS NOT NULL").distinct()
    else:
        state["sketches"] = chunks.groupBy(by).agg(*[F.hll_sketch_agg(named[c], F.lit(SKETCH_BITS)).alias(c) for c in _DISTINCT])
    if retry_reports is not None:
        state["decisions"] = decision_counts(retry_reports, decision_col, by)
    if root_causes is not None:
        state["causes"] = cause_counts(root_causes, by)
    return state


def write_load(path: str, load: str, state: dict[str, DataFrame]) -> None:
    """The state of a load under ``path/<table>/load=<load>``; it replaces what the load left before."""
    for name, df in state.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/load={load}")


def read_states(spark: SparkSession, path: str, exact: bool = True) -> dict[str, DataFrame]:
    """The states of all loads under ``path``."""
    found = {}
    for name in ("values", "flags", "ids" if exact else "sketches", "decisions", "causes"):
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            found[name] = spark.read.parquet(f"{path}/{name}").drop("load")
    return found


def merged_health(states: dict[str, DataFrame], by: str = "campaign", degraded: float = 0.75, critical: float = 0.50) -> DataFrame:
    """The health report over all rows of ``states``: one row per campaign.

    Equal to one pass over the chunks of all loads; the two distinct counts are estimates where
    the states hold sketches.
    """
    values = states["values"].groupBy(by, "dim", "value").agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"))
    flags = states["flags"].groupBy(by).agg(*[F.sum(c).alias(c) for c in _FLAGS])
    if "ids" in states:
        # ids meet once per (campaign, kind, id), whatever the number of loads
        single = states["ids"].distinct()
        distinct = single.groupBy(by).agg(*[F.count_if(F.col("kind") == c).alias(n) for c, n in _DISTINCT.items()])
    else:
        distinct = states["sketches"].groupBy(by).agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(n) for c, n in _DISTINCT.items()])
    flags = flags.join(distinct, by, "left").fillna(0, list(_DISTINCT.values()))
    decisions = causes = None
    if "decisions" in states:
        decisions = states["decisions"].groupBy(by, "decision").agg(F.sum("n").alias("n"))
    if "causes" in states:
        causes = states["causes"].groupBy(by).agg(F.sum("root_cause_report_count").alias("root_cause_report_count"))
    return health_of(flags, values, decisions, causes, by, degraded, critical)
