"""The vector store: what a batch reads and writes, versions, replays and halves of runs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from signalloom.sources.vector_store import VectorStore

SCHEMA = "chunk_id long, v int, embedding array<double>"


def rows(spark, *pairs):
    return spark.createDataFrame([(k, v, [float(v), 1.0]) for k, v in pairs], SCHEMA)


def held(store, version=None):
    return {r["chunk_id"]: r["v"] for r in store.read(version).collect()}


def files(folder):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names}


def test_a_batch_touches_its_buckets_alone(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "s"), buckets=8)
    assert store.upsert(rows(spark, *[(i, 0) for i in range(200)]), 0)
    before = files(tmp_path / "s" / "data")
    one = rows(spark, (7, 1), (7, 2))
    bucket = one.select(store.bucket_of(F.col("chunk_id"))).first()[0]
    # the other buckets are not even read: they may be gone
    others = [b for b in range(8) if b != bucket]
    assert store.upsert(one, 1)
    after = files(tmp_path / "s" / "data")
    assert {f: t for f, t in after.items() if f in before} == before
    assert {f.split("bucket=")[1].split("/")[0] for f in after.keys() - before.keys() if "bucket=" in f} == {str(bucket)}
    assert held(store) == {i: 2 if i == 7 else 0 for i in range(200)}
    assert held(store, 0) == {i: 0 for i in range(200)}
    plan = store.lookup(spark.createDataFrame([(7,)], "chunk_id long")).inputFiles()
    assert plan and not any(f"bucket={b}/" in f for f in plan for b in others)
    assert [r["v"] for r in store.lookup(spark.createDataFrame([(7,), (9999,)], "chunk_id long")).collect()] == [2]


def test_replays_and_interrupted_runs(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    store = VectorStore(spark, path, buckets=4)
    store.upsert(rows(spark, (1, 1), (2, 1)), 5)

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr("signalloom.sources.manifests.commit", lost)
        with pytest.raises(RuntimeError):
            store.upsert(rows(spark, (1, 9), (3, 9)), 6)
    # readers still see the version before; the run can be repeated
    assert held(VectorStore(spark, path)) == {1: 1, 2: 1}
    assert store.upsert(rows(spark, (1, 2), (3, 2)), 6)
    assert not store.upsert(rows(spark, (1, 7)), 6)
    assert held(store) == {1: 2, 2: 1, 3: 2} and store.versions() == [5, 6]
    with pytest.raises(ValueError):
        store.upsert(rows(spark, (1, 7)), 4)


def test_new_columns_null_keys_and_empty_stores(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "s"), buckets=2)
    with pytest.raises(ValueError):
        store.read()
    with pytest.raises(Exception, match="without chunk_id"):
        store.upsert(rows(spark, (None, 1)), 1)
    store.upsert(rows(spark, (1, 1), (2, 1)), 1)
    store.upsert(rows(spark, (2, 5)).withColumn("label", F.lit("x")).drop("v"), 2)
    found = {r["chunk_id"]: (r["v"], r["label"]) for r in store.read().collect()}
    assert found == {1: (1, None), 2: (None, "x")}
    # a store keeps its buckets
    assert VectorStore(spark, str(tmp_path / "s"), buckets=99).buckets == 2


def test_vacuum_keeps_what_is_read(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "s"), buckets=4)
    for n in range(5):
        store.upsert(rows(spark, *[(i, n) for i in range(20) if n == 0 or i % 5 == n]), n)
    want = {n: held(store, n) for n in (3, 4)}
    assert store.vacuum(keep=2) == [0, 1, 2]
    assert {n: held(store, n) for n in (3, 4)} == want and store.versions() == [3, 4]
    places = json.loads((tmp_path / "s" / "versions" / "4.json").read_text())["places"]
    assert set(places) == {"0", "1", "2", "3"}
