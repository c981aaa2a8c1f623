"""Chunk arrays come in files by rows, not by testcases, and lines are printed once for their lengths."""

from pyspark.sql import functions as F

from signalloom.operators import chunking
from signalloom.plans.catalogue import QUERIES


def test_files_of_chunks_do_not_grow_with_testcases(spark, tmp_path):
    users = 300
    spark.range(2 * users).select(
        F.col("id").alias("event_id"),
        F.timestamp_seconds(F.col("id") + 1_700_000_000).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % users).alias("user_id"),
        F.lit("error").alias("event_type"),
        F.lit(1.0).alias("value"),
        F.concat(F.lit('{"k": '), F.col("id") % 8, F.lit("}")).alias("props"),
    ).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    made = QUERIES["chunk_array_files"](spark, str(tmp_path))
    assert made.select("testcase_id").distinct().count() == users
    assert made.select("chunk_id").distinct().count() == made.count()
    assert len(made.inputFiles()) <= 10


def test_lengths_of_lines_are_stored_and_not_printed_again(spark, monkeypatch):
    events = spark.sql(
        "SELECT 't' AS testcase_id, id + 1 AS event_index, concat('e', id) AS event_id, 'a' AS event_name, 'f' AS event_family, "
        "'s' AS severity, 'c' AS cause, 'o' AS operator, 'c' AS country, 'd' AS network_domain, array('x') AS tags, 'failed' AS result FROM range(50)"
    )
    given, bounds = [], chunking.chunk_bounds
    monkeypatch.setattr(chunking, "chunk_bounds", lambda lines, *rest: given.append(lines) or bounds(lines, *rest))
    assert chunking.build_chunks(events, 2000, 200).agg(F.max_by("event_ids", "chunk_index")).first()[0][-1] == "e49"
    assert given[0].inputFiles() and "concat_ws" not in given[0]._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_not_broadcast(spark, tmp_path, monkeypatch):
    # 200,000 lines of 2,000 traces take less than the 10 MB under which Spark broadcasts a table
    spark.sql("SELECT concat('t', id % 2000) AS testcase_id, id div 2000 + 1 AS event_index, 150 AS length FROM range(200000)").write.parquet(str(tmp_path / "lines"))
    kept, stage = [], chunking.staged
    monkeypatch.setattr(chunking, "staged", lambda rows: kept.append(rows) or stage(rows))
    bounds = chunking.chunk_bounds(spark.read.parquet(str(tmp_path / "lines")), 2000, 200)
    assert bounds.groupBy("testcase_id").agg(F.max("line_end").alias("end")).filter("end = 100").count() == 2000
    assert kept and "BroadcastHashJoin" not in kept[0]._jdf.queryExecution().executedPlan().toString()


def test_lines_and_events_meet_in_parts_by_rows(spark, tmp_path, monkeypatch):
    # compressed, all of these fit one task's share by size
    spark.sql("SELECT concat('t', id % 500) AS testcase_id, id div 500 + 1 AS event_index, 150 AS length FROM range(20000)").write.parquet(str(tmp_path / "lines"))
    monkeypatch.setattr(chunking, "NARROW_ROWS", 500, raising=False)
    kept, stage = [], chunking.staged
    monkeypatch.setattr(chunking, "staged", lambda rows: kept.append(stage(rows)) or kept[-1])
    bounds = chunking.chunk_bounds(spark.read.parquet(str(tmp_path / "lines")), 2000, 200)
    assert bounds.groupBy("testcase_id").agg(F.max("line_end").alias("end")).filter("end = 40").count() == 500
    assert len(kept[0].inputFiles()) >= 35 and bounds.rdd.getNumPartitions() == 40


def test_events_are_not_broadcast_to_their_chunks(spark):
    events = spark.sql(
        "SELECT 't' AS testcase_id, id + 1 AS event_index, concat('e', id) AS event_id, 'a' AS event_name, 'f' AS event_family, "
        "'s' AS severity, 'c' AS cause, 'o' AS operator, 'c' AS country, 'd' AS network_domain, array('x') AS tags, 'failed' AS result FROM range(50)"
    )
    chunks = chunking.build_chunks(chunking.staged(events), 2000, 200)
    assert chunks.agg(F.sum("event_count")).first()[0] >= 50
    assert "SortMergeJoin [testcase_id" in chunks._jdf.queryExecution().executedPlan().toString()
