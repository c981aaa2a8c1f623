"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import remove_folder, stage_folder


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its neighbours below are linked to the least of these."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(u, v)``: each linked node that is not the least of its component, and the least.

    ``links`` holds pairs ``(u, v)`` in any direction; loops and repeats do no harm.  Each
    round is written and read back, and the number of rounds grows with the logarithm of the
    nodes.  No links: no rows.
    """
    spark = links.sparkSession
    state = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before = None
    for _ in range(rounds):
        path = stage_folder(spark)
        state.write.parquet(path)
        state = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
        # done when each node has one link and what it leads to has none
        ends = state.select(F.col("u").alias("n"), F.lit(1).alias("up")).unionByName(state.select(F.col("v").alias("n"), F.lit(0).alias("up")).distinct())
        open_nodes = ends.groupBy("n").agg(F.sum("up").alias("ups"), F.count("*").alias("all")).where("ups > 1 OR (ups = 1 AND all > 1)")
        if open_nodes.limit(1).count() == 0:
            return state
        state = _small_star(_large_star(state))
    raise RuntimeError("components did not settle")
