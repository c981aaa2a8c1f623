"""Heavy keys: found exactly, and dealt to several tasks."""

import pytest
from pyspark.sql import functions as F

from signalloom.operators.heavy import heavy_keys, spread_join


def tables(spark, n=9000):
    left = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 97 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 400)).alias("k"),
        F.col("id").alias("v"), F.create_map(F.lit("a"), F.col("id")).alias("m"),
    )
    right = spark.range(300).select(F.when(F.col("id") == 7, F.lit("hot")).otherwise(F.concat(F.lit("k"), "id")).alias("k"), (F.col("id") * 2).alias("w"))
    return left, right


def test_heavy_keys_are_exact(spark):
    left, _ = tables(spark)
    found = {r["k"]: r["parts"] for r in heavy_keys(left, "k", key_rows=500).collect()}
    assert found == {"hot": 6}
    assert heavy_keys(left, "k", key_rows=5000).count() == 0
    assert heavy_keys(left.limit(0), "k").count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_joins_equal_plain_ones(spark, how):
    left, right = tables(spark)
    heavy = heavy_keys(left, "k", key_rows=300)
    got = spread_join(left, right, "k", heavy, how).drop("m")
    want = left.drop("m").join(right, "k", how)
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    with pytest.raises(ValueError):
        spread_join(left, right, "k", heavy, "full_outer")


def test_no_task_gets_the_hot_key(spark):
    left, right = tables(spark)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for key, value in zip(before, ("false", "-1", "16")):
        spark.conf.set(key, value)
    try:
        heavy = heavy_keys(left, "k", key_rows=100)

        def sizes(df):
            return sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())

        plain, spread = sizes(left.join(right, "k")), sizes(spread_join(left, right, "k", heavy, "inner"))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sum(plain) == sum(spread) and plain[-1] > 3000
    assert spread[-1] < 3 * spread[len(spread) // 2]
