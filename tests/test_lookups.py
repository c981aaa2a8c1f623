"""Point lookups read as much of a large table as of a small one."""

from pyspark.sql import functions as F

from signalloom.sources import stages


def rows_read(df):
    """Rows that the scan of a plan gave, after row groups were ruled out."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


def test_lookups_read_few_row_groups(spark, tmp_path):
    read = {}
    for size in (20_000, 200_000):
        table = spark.range(size).select(
            F.concat(F.lit("t"), F.lpad((F.xxhash64("id") % 1000 + 1000).cast("string"), 6, "0")).alias("testcase_id"),
            F.col("id").alias("chunk_index"), F.concat(F.lit("c"), F.xxhash64("id")).alias("chunk_id"), F.lit("x" * 20).alias("text"),
        )
        path = str(tmp_path / str(size))
        stages.write_clustered(table, path, ["testcase_id", "chunk_index"], ["testcase_id", "chunk_id"], group_rows=1000)
        stored = stages.read_stage(spark, path)
        assert stored.count() == size
        chunk = stored.select(F.min_by("chunk_id", "chunk_index")).first()[0]
        case = stored.where(F.col("chunk_id") == chunk).first()["testcase_id"]
        read[size] = [rows_read(stored.where(F.col("testcase_id") == case)), rows_read(stored.where(F.col("chunk_id") == chunk))]
        assert stored.where("testcase_id = 'none'").count() == 0
        assert [r["chunk_index"] for r in stored.where(F.col("chunk_id") == chunk).collect()] == [0]
    small, large = read[20_000], read[200_000]
    # by range: at most the groups that hold the testcase; by bloom filter: its group, and a false positive or two
    assert max(small[0], large[0]) <= 3000 and max(small[1], large[1]) <= 12_000
