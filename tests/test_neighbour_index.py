"""The stored index and neighbour tables that follow new vectors."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.operators.neighbour_index import NeighbourIndex, _tiles, updated_neighbours
from signalloom.operators.neighbours import nearest_chunks


def table(spark, rows):
    return spark.createDataFrame([(int(i), [float(x) for x in v], int(i) % 4) for i, v in rows], "chunk_id long, embedding array<double>, label int")


def found(df):
    columns = ["query_chunk_id", "rank", "chunk_id", "distance"]
    return sorted((r[0], r[1], r[2], round(r[3], 6)) for r in df.select(*columns).collect())


def clustered(rng, n, centers, dims=8):
    spots = rng.normal(size=(centers, dims)) * 10
    return [(i, spots[i % centers] + rng.normal(size=dims) * 0.3) for i in range(n)]


@pytest.mark.parametrize("metric", ["sq_l2", "l2", "cosine"])
def test_search_of_clusters(spark, tmp_path, metric):
    rng = np.random.default_rng(1)
    rows = clustered(rng, 600, 12)
    # a third of all vectors are one
    rows += [(1000 + i, rows[0][1]) for i in range(300)]
    vectors = table(spark, rows)
    index = NeighbourIndex.build(vectors, str(tmp_path / "i"), metric=metric, list_vectors=30)
    again = NeighbourIndex(spark, str(tmp_path / "i"))  # as another session would find it
    for part in (0, 1):
        queries = vectors.where(F.col("chunk_id") % 20 == part)
        exact = found(nearest_chunks(vectors, queries, 5, metric))
        assert part or found(again.search_exact(queries)) == exact
        assert found(again.search(queries, probes=index.list_count())) == exact
        near = {(q, c) for q, _, c, _ in found(again.search(queries, probes=6))}
        assert len(near & {(q, c) for q, _, c, _ in exact}) >= 0.9 * len(exact)
    own = found(again.search(vectors.where("chunk_id < 5"), k=3, probes=index.list_count(), exclude_self=True, where=F.col("label") == 2))
    assert own == found(nearest_chunks(vectors, vectors.where("chunk_id < 5"), 3, metric, True, F.col("label") == 2))


def test_a_batch_reads_its_cells(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = clustered(rng, 800, 16)
    vectors = table(spark, rows)
    index = NeighbourIndex.build(vectors, str(tmp_path / "i"), list_vectors=25)
    cells = index.table().select("cell").distinct().count()
    one = index.search(vectors.where("chunk_id = 3"), probes=1)
    assert one.count() == 5 and cells > 3
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*cell#", plan), plan


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (None, [1.0, 1.0]), (4, None)]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    index = NeighbourIndex.build(vectors, str(tmp_path / "i"), metric="cosine", list_vectors=1)
    got = found(index.search(vectors, k=2, probes=99))
    assert got == [(1, 1, 1, 0.0), (1, 2, 2, 0.0), (2, 1, 1, 0.0), (2, 2, 2, 0.0), (3, 1, 3, 0.0), (3, 2, 1, 1.0)]
    with pytest.raises(ValueError):
        NeighbourIndex.build(vectors.where("chunk_id = 4"), str(tmp_path / "none"))


@pytest.mark.parametrize("exclude_self", [False, True])
def test_neighbour_tables_follow_three_batches(spark, exclude_self):
    rng = np.random.default_rng(3)
    stored = {i: v for i, v in clustered(rng, 60, 5, 4)}
    neighbours = nearest_chunks(table(spark, stored.items()), k=4, exclude_self=exclude_self)
    batches = [
        {i: rng.normal(size=4) * 10 for i in range(60, 75)},
        {i: stored[i] + 5 for i in range(0, 60, 7)},  # other vectors for stored chunks
        {5: stored[9], 80: stored[9], 81: rng.normal(size=4)},
    ]
    for batch in batches:
        neighbours = updated_neighbours(neighbours, table(spark, stored.items()), table(spark, batch.items()), 4, exclude_self=exclude_self)
        stored |= batch
        want = found(nearest_chunks(table(spark, stored.items()), k=4, exclude_self=exclude_self))
        assert found(neighbours) == want
        neighbours = spark.createDataFrame(neighbours.collect(), neighbours.schema)


def test_build_without_arrow_and_many_lists_a_tile(spark, tmp_path):
    rng = np.random.default_rng(5)
    vectors = table(spark, clustered(rng, 300, 9))
    key = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        index = NeighbourIndex.build(vectors, str(tmp_path / "i"), list_vectors=10)
        assert found(index.search(vectors, probes=index.list_count())) == found(nearest_chunks(vectors))
    finally:
        spark.conf.set(key, before)
    # of the lists of a tile only those that a query probes are searched
    own = found(index.search(vectors, k=300, probes=1))
    lists = {r["chunk_id"]: r["list"] for r in index.table().select("chunk_id", "list").collect()}
    assert {(q, c) for q, _, c, _ in own} == {(q, c) for q in lists for c in lists if lists[q] == lists[c]}


def test_tiles_hold_a_block_or_one_list():
    tile_of, rows = _tiles(np.array([3, 4, 0, 5, 30, 1, 1]), 10)
    assert tile_of.tolist() == [0, 0, 0, 1, 2, 3, 3]
    assert rows.tolist() == [7, 5, 30, 2]
