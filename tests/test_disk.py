"""What steps leave on disk: rows are sent and stored once, and shuffle files go with their step."""

import time

import numpy as np
from pyspark.sql import functions as F

from signalloom.operators import ordering
from signalloom.plans import catalogue
from signalloom.plans.catalogue import QUERIES
from signalloom.session import staged


def events(spark, folder, n=400, users=40):
    spark.range(n).select(
        F.col("id").alias("event_id"),
        F.timestamp_seconds(F.col("id") + 1_700_000_000).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % users).alias("user_id"),
        F.lit("error").alias("event_type"),
        F.lit(1.0).alias("value"),
        F.concat(F.lit('{"k": '), F.col("id") % 8, F.lit("}")).alias("props"),
    ).coalesce(1).write.parquet(f"{folder}/events.parquet")


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in files.mkString(" ").split() if "shuffle_" in name and name.endswith(".data")}


def test_shuffle_files_go_when_a_stage_is_written(spark):
    before = shuffle_files(spark)
    rows = staged(spark.range(1000).repartition(5, "id").withColumn("text", F.md5(F.col("id").cast("string"))))
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before and rows.count() == 1000


def test_rows_are_numbered_where_they_lie(spark):
    rows = spark.sql("SELECT if(id % 10 = 0, null, concat('k', id % 3)) AS key, if(id % 7 = 0, null, id div 4) AS at, repeat('x', 50) AS text FROM range(600)")
    found = ordering.placed(rows.repartition(6), "key", ["at"])
    # only the totals of keys and slices are sent once the rows are sorted
    assert "row_number" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r["key"], []).append((r["place"], r["at"] is not None, r["at"] or 0, r["total"]))
    assert len(got) == 4 and sum(map(len, got.values())) == 600
    for held in got.values():
        held.sort()
        assert [h[0] for h in held] == list(range(len(held))) and {h[3] for h in held} == {len(held)}
        assert [h[1:3] for h in held] == sorted(h[1:3] for h in held)


def test_chunk_arrays_lie_compressed(spark, tmp_path, monkeypatch):
    events(spark, tmp_path)
    folder = str(tmp_path / "arrays")
    monkeypatch.setattr(catalogue, "stage_folder", lambda spark: folder)
    made = QUERIES["chunk_array_files"](spark, str(tmp_path))
    assert made.count() >= 40 and made.select("chunk_id").distinct().count() == made.count()
    stored = sum(p.stat().st_size for p in tmp_path.glob("arrays/**/part-*"))
    text = spark.read.text(folder).agg(F.sum(F.length("value"))).first()[0]
    assert text > 5 * stored


def test_the_chain_stores_what_it_reads(spark, tmp_path, monkeypatch):
    events(spark, tmp_path)
    rng = np.random.default_rng(11)
    vectors = [(i, [float(x) for x in rng.normal(size=4)], 0) for i in range(30)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    kept, stage = [], catalogue.staged
    monkeypatch.setattr(catalogue, "staged", lambda df: kept.append(stage(df)) or kept[-1])
    reports = QUERIES["retry_chain"](spark, str(tmp_path))
    chunks = QUERIES["chunk_files"](spark, str(tmp_path)).select("chunk_id").collect()
    assert {r["chunk_id"] for r in reports.collect()} == {r["chunk_id"] for r in chunks}
    assert {"testcase_id", "tags", "has_failure"} <= set(kept[0].columns) and not {"text", "event_ids"} & set(kept[0].columns)


def test_events_are_sent_to_their_chunks_unprinted(spark, tmp_path):
    events(spark, tmp_path)
    plan = catalogue.fx.chunks_of(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    sent = min(i for i, line in enumerate(lines) if "RepartitionByExpression" in line)
    assert "concat_ws" in "".join(lines[:sent]) and "concat_ws" not in "".join(lines[sent:])
