"""Streams give what the same step gives on the whole table."""

from pyspark.sql import functions as F

from signalloom.plans import fixtures as fx
from signalloom.plans.catalogue import QUERIES
from signalloom.streaming import live

SF = "/root/testdata/sf0.001"


def split_in_two(spark, tmp_path):
    events = fx.table(spark, SF, "events")
    middle = events.approxQuantile("event_id", [0.5], 0.0)[0]
    folder = str(tmp_path / "in")
    for i, part in enumerate((events.filter(F.col("event_id") <= middle), events.filter(F.col("event_id") > middle))):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/part={i}")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*"), events


def test_streamed_events_equal_batch(spark, tmp_path):
    stream, table = split_in_two(spark, tmp_path)
    found = live.drain(live.stream_events(fx.as_trace_rows(stream)), str(tmp_path / "q"))
    expected = live.stream_events(fx.as_trace_rows(table))
    columns = ["event_id", "event_name", "severity", "normalized_message"]
    assert found.count() == expected.count()
    assert found.select(columns).exceptAll(expected.select(columns)).count() == 0


def test_closed_storm_windows_equal_batch(spark, tmp_path):
    stream, table = split_in_two(spark, tmp_path)
    counts = live.storm_counts(live.stream_events(fx.as_trace_rows(stream)), "6 hours", "3 hours")
    found = live.drain(counts, str(tmp_path / "q"))
    expected = live.storm_counts(live.stream_events(fx.as_trace_rows(table)), "6 hours", "3 hours")
    assert found.count() > 0
    assert found.exceptAll(expected).count() == 0


def test_replayed_rows_count_once(spark, tmp_path):
    stream, table = split_in_two(spark, tmp_path)
    rows = fx.as_trace_rows(stream)
    events = live.stream_events(rows.withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))).drop("x"))
    found = live.drain(live.unique_events(events, "60 days").select("event_id"), str(tmp_path / "q"))
    expected = live.stream_events(fx.as_trace_rows(table))
    assert live.without_clock(expected).count() > 0
    assert found.count() == expected.count() == found.distinct().count()


def test_vector_batches_keep_the_latest(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = "chunk_id string, v int"
    spark.createDataFrame([("a", 1), ("b", 1)], schema).coalesce(1).write.parquet(f"{folder}/n=0")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/n=*")
    run = live.upsert_vectors(stream, str(tmp_path / "vectors"), str(tmp_path / "state"))
    run.trigger(availableNow=True).start().awaitTermination()
    spark.createDataFrame([("b", 2)], schema).coalesce(1).write.parquet(f"{folder}/n=1")
    run.trigger(availableNow=True).start().awaitTermination()
    rows = live.read_vectors(spark, str(tmp_path / "vectors")).collect()
    assert {(r["chunk_id"], r["v"]) for r in rows} == {("a", 1), ("b", 2)}


def test_sessions_of_a_busy_testcase(spark):
    """Counted by slots they equal Spark's own session windows."""
    rows = [("hot", i * (61 if i % 50 else 4000)) for i in range(3000)] + [("a", 0), ("a", 1799), ("a", 3599), ("b", 5), ("b", 1805)]
    table = spark.createDataFrame(rows, "testcase_id string, s long").withColumn("timestamp", F.timestamp_seconds("s"))
    found = live.activity_sessions(table.repartition(4))
    plain = table.groupBy(F.session_window("timestamp", "30 minutes").alias("w"), "testcase_id").agg(F.count("*").alias("events"))
    expected = plain.select("testcase_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_no_shared_folder_is_an_error_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from signalloom.session import stage_folder

    context = SimpleNamespace(master="yarn", getCheckpointDir=lambda: None)
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)
    with pytest.raises(ValueError):
        stage_folder(cluster)


def test_streamed_ids_equal_those_of_the_batch(spark, tmp_path):
    """Micro-batches of several testcases, one of them busy; a restart in between."""
    from signalloom.operators.events import normalise
    from signalloom.operators.evidence import classify, trace_values

    rows = []
    for n in range(4):
        for i in range(90):
            case = "hot" if i % 3 else f"t{i % 7}"
            rows.append((n, case, 1000 * n + i, "2026-01-01 00:00:00", "0", "P", "E", "T", "timeout" if i % 2 else "nothing"))
    schema = "n int, testcase_id string, seq long, Timestamp string, CallId string, Ptc string, Event string, Type string, Information string"
    table = spark.createDataFrame(rows, schema)
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, live.STATE_STORE)
    try:
        for n in range(4):
            table.where(f"n = {n}").drop("n").repartition(2).write.parquet(str(tmp_path / "in" / f"part={n}"))
            stream = spark.readStream.schema(table.drop("n").schema).parquet(str(tmp_path / "in" / "part=*"))
            found = live.drain(live.numbered_events(stream).select("event_id", "seq", "testcase_id"), str(tmp_path / "run"))
    finally:
        spark.conf.unset(key)
    evidence = classify(table)
    want = normalise(evidence, trace_values(table)).select("event_id", "seq", "testcase_id")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and want.count() == 180
    again = live.numbered_events(table.drop("n")).select("event_id", "seq", "testcase_id")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, want.collect()))


def test_a_streamed_table_is_one_file_or_a_folder(spark, tmp_path):
    rows = spark.range(20).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float")).alias("embedding"), F.lit(1).alias("label"))
    rows.repartition(3).write.parquet(f"{tmp_path}/folder/embeddings.parquet")
    (tmp_path / "file").mkdir()
    rows.coalesce(1).write.parquet(f"{tmp_path}/one")
    next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / "file" / "embeddings.parquet")
    spark.range(3).write.parquet(f"{tmp_path}/file/other.parquet")
    for kind in ("folder", "file"):
        found = QUERIES["stream_vector_upsert"](spark, f"{tmp_path}/{kind}")
        assert sorted(r["chunk_id"] for r in found.collect()) == list(range(20))
