"""Joins on keys of which a few hold much of a table.

Adaptive execution splits skewed joins of stored tables, but not those of streams nor those
whose result has to keep its partitioning.  Here the heavy keys are found first: a frequent-items
sketch names the candidates, an exact count confirms them, and only they are dealt to several
tasks, with the other side's rows repeated as often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged

#: Heavy keys at most; a key with fewer than one in so many rows is none.
MOST_KEYS = 1000
#: Rows of one key that one task may get.
KEY_ROWS = 250_000


def heavy_keys(df: DataFrame, key: str, key_rows: int = KEY_ROWS, most: int = MOST_KEYS) -> DataFrame:
    """``key`` and ``parts`` (2 or more) of the keys with more than ``key_rows`` rows.

    At most ``most`` rows: keys that hold less than one in ``most`` of all rows are left out,
    which a table of ``most * key_rows`` rows and more may have.  Null is no key.  The table is
    read twice; both times only aggregates leave a task.
    """
    named = df.where(F.col(key).isNotNull()).select(F.col(key))
    # the sketch keeps every key above its support, and perhaps others
    frequent = named.stat.freqItems([key], 1.0 / most).select(F.explode(f"{key}_freqItems").alias(key))
    counted = named.join(F.broadcast(frequent), key, "left_semi").groupBy(key).agg(F.count("*").alias("n"))
    heavy = counted.where(F.col("n") > key_rows).orderBy(F.desc("n"), key).limit(most)
    return staged(heavy.select(key, F.ceil(F.col("n") / key_rows).cast("int").alias("parts")))


def spread_join(left: DataFrame, right: DataFrame, key: str, heavy: DataFrame, how: str = "left", spot: Column | None = None) -> DataFrame:
    """``left.join(right, key, how)`` with the rows of heavy keys dealt to several tasks.

    ``heavy`` is that of ``heavy_keys(left, key)``, or of another table whose keys are as heavy;
    it is broadcast, and so may serve a stream.  ``how`` is inner, left, left_semi or left_anti.
    ``spot`` deals the rows of a key: an expression over ``left`` that differs among them (their
    whole content by default).
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a {how} join would repeat the rows of its right side")
    parts = F.broadcast(heavy.select(F.col(key).alias("__heavy"), F.col("parts").alias("__parts")))
    if spot is None:
        spot = F.xxhash64(*[c for c in left.columns if left.schema[c].dataType.typeName() != "map"])
    dealt = left.join(parts, F.col(key) == F.col("__heavy"), "left")
    dealt = dealt.withColumn("__part", F.coalesce(F.pmod(spot, F.col("__parts")), F.lit(0)).cast("int")).drop("__heavy", "__parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))
    repeated = right.join(parts, F.col(key) == F.col("__heavy"), "left").withColumn("__part", copies).drop("__heavy", "__parts")
    return dealt.join(repeated, [key, "__part"], how).drop("__part")
