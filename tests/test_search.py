"""Nearest neighbours against brute force, and the vector table."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from signalloom.operators import neighbours
from signalloom.operators import vectors as vec
from signalloom.operators.neighbours import nearest_chunks


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12)) * 4
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=12)]) for i in range(300)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(90)]  # copies
    data = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(4)
    return df, np.array([i for i, _ in rows]), data


def brute(ids, data, k, metric, exclude):
    if metric == "cosine":
        unit = data / np.linalg.norm(data, axis=1, keepdims=True)
        far = 1 - unit @ unit.T
    else:
        far = ((data[:, None] - data[None]) ** 2).sum(2)
        far = np.sqrt(far) if metric == "l2" else far
    if exclude:
        np.fill_diagonal(far, np.inf)
    return {
        ids[i]: [(int(ids[j]), round(float(far[i, j]), 6)) for j in np.lexsort((ids, far[i].round(9)))[:k]]
        for i in range(len(ids))
    }


@pytest.mark.parametrize("metric,exclude,task", [("sq_l2", False, 2048), ("sq_l2", True, 40), ("l2", False, 25),
                                                  ("cosine", False, 60)])
def test_self_join_is_exact(points, metric, exclude, task):
    df, ids, data = points
    rows = nearest_chunks(df, k=4, metric=metric, exclude_self=exclude, task_vectors=task).collect()
    found: dict = {}
    for r in sorted(rows, key=lambda r: (r["query_chunk_id"], r["rank"])):
        found.setdefault(r["query_chunk_id"], []).append((r["chunk_id"], round(r["distance"], 6)))
    expected = brute(ids, data, 4, metric, exclude)
    assert set(found) == set(expected)
    for i in expected:
        assert [d for _, d in found[i]] == pytest.approx([d for _, d in expected[i]], abs=1e-5)
        if metric == "sq_l2":
            assert [j for j, _ in found[i]] == [j for j, _ in expected[i]]


def test_hot_copies_meet_their_lists_by_broadcast(points, monkeypatch):
    df, _, _ = points
    plain = {tuple(r) for r in nearest_chunks(df, k=3).select("query_chunk_id", "rank", "chunk_id").collect()}
    monkeypatch.setattr(neighbours, "HOT_SHARE", 20)  # only the copied vectors are hot now
    split = {tuple(r) for r in nearest_chunks(df, k=3).select("query_chunk_id", "rank", "chunk_id").collect()}
    assert split == plain and len(plain) == 3 * 390


def test_probes_trade_recall_for_work(points):
    df, ids, data = points
    exact = {(r["query_chunk_id"], r["chunk_id"]) for r in nearest_chunks(df, k=4, task_vectors=40).collect()}
    quick = {(r["query_chunk_id"], r["chunk_id"]) for r in nearest_chunks(df, k=4, task_vectors=40, probes=4).collect()}
    assert len(exact & quick) / len(exact) > 0.8


def test_no_vectors_no_neighbours(points):
    df, _, _ = points
    assert nearest_chunks(df.limit(0)).count() == 0


def test_search_and_filter(points):
    df, ids, data = points
    found = vec.search(df, data[5].tolist(), k=3).collect()
    assert (found[0]["chunk_id"], found[0]["rank"], found[0]["similarity_score"]) == (5, 1, 1.0)
    kept = vec.search(df, data[5].tolist(), k=3, where=F.col("chunk_id") > 100).collect()
    assert all(r["chunk_id"] > 100 for r in kept) and len(kept) == 3


def test_upsert_keeps_the_latest_batch(spark):
    stored = spark.createDataFrame([("a", 1, "old"), ("b", 1, "old")], "chunk_id string, batch_id int, v string")
    batch = spark.createDataFrame([("b", 2, "new"), ("c", 2, "new")], "chunk_id string, batch_id int, v string")
    assert {(r["chunk_id"], r["v"]) for r in vec.upsert(stored, batch).collect()} == {
        ("a", "old"), ("b", "new"), ("c", "new")}


def test_text_vectors_find_the_same_text(spark):
    texts = spark.createDataFrame(
        [("a", "timeout on attach"), ("b", "plmn not allowed"), ("c", "sip retry again"), ("d", "  ")],
        "chunk_id string, text string")
    usable, rejected = vec.split_empty(texts, "text")
    assert [r["chunk_id"] for r in rejected.collect()] == ["d"]
    model = vec.fit_text_vectors(usable)
    asked = vec.embed(model, usable.filter("chunk_id = 'b'").withColumn("chunk_id", F.lit("q")))
    best = nearest_chunks(vec.embed(model, usable), asked, k=1).first()
    assert (best["query_chunk_id"], best["chunk_id"]) == ("q", "b")


@pytest.mark.parametrize("task", [2048, 30])
def test_many_ties_go_to_the_lowest_ids(spark, task):
    """Unit vectors at right angles: each is as far from all others."""
    rows = [(i, [1.0 if j == i else 0.0 for j in range(100)]) for i in range(100)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(3)
    found = {}
    for r in nearest_chunks(df, k=3, task_vectors=task).collect():
        found.setdefault(r["query_chunk_id"], {})[r["rank"]] = r["chunk_id"]
    for i in range(100):
        assert [found[i][n] for n in (1, 2, 3)] == [i, *[j for j in range(3) if j != i][:2]]


def test_zero_vectors_have_a_cosine_distance(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    found = {(r["query_chunk_id"], r["chunk_id"]): r["distance"] for r in nearest_chunks(df, k=3, metric="cosine").collect()}
    assert found[1, 1] == 0 and found[1, 2] == found[1, 3] == found[2, 1] == found[2, 3] == pytest.approx(1.0)
    assert {r["chunk_id"]: r["distance"] for r in vec.search(df, [1.0, 0.0], 3, "cosine").collect()} == {2: 0.0, 1: 1.0, 3: 1.0}


def test_probes_reach_most_neighbours(points):
    df, ids, data = points
    exact = {(r["query_chunk_id"], r["chunk_id"]) for r in nearest_chunks(df, k=5).collect()}
    some = {(r["query_chunk_id"], r["chunk_id"]) for r in nearest_chunks(df, k=5, probes=8).collect()}
    assert len(some & exact) >= 0.9 * len(exact)


def test_texts_are_embedded_whole(spark):
    tail = "unusual ending words"
    rows = [("a", "common words here " * 600 + tail), ("b", tail), ("c", "common words here"), ("d", "...")]
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    model = vec.fit_text_vectors(df, dimensions=64)
    found = {r["chunk_id"]: np.array(r["embedding"]) for r in vec.embed(model, df).collect()}
    assert found["a"] @ found["b"] > 0 and not found["d"].any()
    assert np.linalg.norm(found["b"]) == pytest.approx(1, abs=1e-5)


def test_rows_of_one_batch_have_a_defined_winner(spark):
    stored = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "chunk_id string, v int, batch_id int")
    batch = spark.createDataFrame([("a", 7, 2), ("a", 8, 2)], stored.schema)
    first = {(r["chunk_id"], r["v"]) for r in vec.upsert(stored, batch).collect()}
    again = {(r["chunk_id"], r["v"]) for r in vec.upsert(stored, batch.orderBy("v", ascending=False)).collect()}
    assert first == again and ("b", 1) in first and len(first) == 2


def test_vectors_leave_for_their_groups_a_few_at_a_time():
    rng = np.random.default_rng(3)
    groups = neighbours._Groups(rng.normal(size=(300, 64)))
    groups.near, groups.far, groups.sizes = np.zeros(300), np.full(300, 1e9), np.ones(300)
    rows = rng.normal(size=(1000, 64))
    frames = list(groups.routes(iter([pd.DataFrame({"key": np.arange(1000), "vector": list(rows)})]), 5, None))
    assert max(map(len, frames)) * 64 <= neighbours.CELLS
    cells = pd.concat(frames).groupby("key")["cell"]
    row, cell = groups.reachable(rows, 5, None)
    assert cells.apply(list).to_dict() == {k: cell[row == k].tolist() for k in range(1000)}
    assert len(row) > 100_000


def test_places_of_vectors_in_groups_are_held_a_few_at_a_time():
    rng = np.random.default_rng(5)
    groups = neighbours._Groups(rng.normal(size=(1000, 8)))
    groups.near, groups.far, groups.sizes = np.zeros(1000), np.full(1000, 1e9), np.ones(1000)
    batch = pd.DataFrame({"key": np.arange(8000), "vector": list(rng.normal(size=(8000, 8)))})
    tracemalloc.start()
    try:
        left = sum(len(frame) for frame in groups.routes(iter([batch]), 900, None))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert left > 6_000_000 and peak < 100_000_000


def test_a_block_is_measured_a_few_rows_at_a_time():
    rng = np.random.default_rng(4)
    left = pd.DataFrame({"key": np.arange(4000), "vector": list(rng.normal(size=(4000, 8)))})
    right = left.assign(least=left["key"])
    tracemalloc.start()
    try:
        pairs = neighbours.block_nearest(2)(left, right)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 4000 * 4000 * 8
    assert pairs.groupby("query")["key"].first().tolist() == list(range(4000))
