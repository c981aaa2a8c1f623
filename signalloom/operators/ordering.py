"""Per-key positions without putting a whole key into one task.

Rows of a key are cut into blocks by their order column.  Only block totals are
summed per key; rows meet their block's totals on ``(key, block)``, so no group
in any shuffle holds more than ``block_rows`` rows, however hot the key is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import BLOCK_ROWS, staged


def with_position(
    df: DataFrame,
    key: str = "testcase_id",
    order: str = "seq",
    name: str = "event_index",
    per_key: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add the 1-based position of each row within its key.

    ``order`` must be an integer, unique within the key.  ``per_key`` (at most one
    row per key) is left-joined through the block totals, which keeps that join
    free of skew as well.
    """
    rows = df.withColumn("_block", F.expr(f"`{order}` div {block_rows}"))
    by_key = Window.partitionBy(key).orderBy("_block")
    totals = (
        rows.groupBy(key, "_block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(key, "_block", (F.sum("_n").over(by_key) - F.col("_n")).alias("_before"))
    )
    if per_key is not None:
        totals = totals.join(per_key, key, "left")
    within = Window.partitionBy(key, "_block").orderBy(order)
    return (
        rows.withColumn("_local", F.row_number().over(within))
        .join(totals, [key, "_block"], "left")
        .withColumn(name, F.col("_before") + F.col("_local"))
        .drop("_block", "_local", "_before")
    )


def latest_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the one with the highest ``order``; ties go to the greatest content."""
    content = F.xxhash64(*[c for c in df.columns if c not in (key, order)])
    newest = Window.partitionBy(key).orderBy(F.desc(order), F.desc(content))
    return df.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn")


def placed(rows: DataFrame, key: str, order: list[str], name: str = "place", total: str = "total") -> DataFrame:
    """``rows`` with the 0-based place of each in its key, and its key's number of rows.

    Any sortable columns order, ties included: rows equal in all of it get different places,
    and nulls come first.  The table is range-sorted by key and order, whose slices cut a hot
    key; only one total per key and slice meets the others of its key.
    """
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    # rows are numbered as they lie in their slice, which spares sending them once more
    ranged = tied.repartitionByRange(key, *order, "__tie").sortWithinPartitions(key, *order, "__tie")
    sliced = staged(ranged.withColumns({"__slice": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}))
    ahead = Window.partitionBy(key).orderBy("__slice")
    totals = sliced.groupBy(F.col(key), F.col("__slice")).agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    totals = totals.select(
        F.col(key).alias("__key"),
        F.col("__slice").alias("__of"),
        "__first",
        (F.sum("__n").over(ahead) - F.col("__n")).alias("__ahead"),
        F.sum("__n").over(Window.partitionBy(key)).alias(total),
    )
    own = (F.col("__slice") == F.col("__of")) & F.col(key).eqNullSafe(F.col("__key"))
    placed_rows = sliced.join(totals, own).withColumn(name, F.col("__ahead") + F.col("__row") - F.col("__first"))
    return placed_rows.select(*rows.columns, name, total)
