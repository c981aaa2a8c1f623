import numpy as np
import pytest

from signalloom.llm import neighbour_tiles
from signalloom.llm.catalogue import ORACLE, QUERIES
from signalloom.llm.neighbour_tiles import Codes

from compare import connect, difference


def by_hand(queries, rows, k):
    """{query id: [(vec_id, cosine), ..]} with plain sums."""
    out = {}
    for q, u in queries:
        u = np.array(u, float)
        scored = []
        for v, w in rows:
            if v != q and len(w) == len(u):
                w = np.array(w, float)
                scored.append((-(u @ w) / np.sqrt(u @ u) / np.sqrt(w @ w), v))
        out[q] = [(v, -s) for s, v in sorted(scored)[:k]]
    return {q: x for q, x in out.items() if x}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_query_equals_sql(spark, small):
    assert difference(QUERIES["op12_neighbour_tiles"](spark, small), connect(small), ORACLE["op12_neighbour_tiles"]) is None


@pytest.mark.parametrize("block_rows, strip_rows", [(16_384, 1 << 20), (7, 40)])
def test_equals_brute_force_however_cut(spark, block_rows, strip_rows):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 8))
    near = [(base[i % 12] + rng.normal(scale=1e-4, size=8)).astype(np.float32).tolist() for i in range(150)]
    rows = [(i, v) for i, v in enumerate(near)] + [(200 + i, near[0]) for i in range(120)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    queries = table.where("vec_id % 10 = 0")
    got = neighbour_tiles.nearest(queries, table, 4, block_rows, strip_rows)
    same(found(got), by_hand([r for r in rows if r[0] % 10 == 0], rows, 4))


def test_the_bound_holds_and_long_vectors_are_summed_in_parts():
    rng = np.random.default_rng(6)
    for scale in (1.0, 1e-30, 1e200):
        mine, theirs = (Codes(rng.standard_cauchy((20, 2500)) * scale) for _ in range(2))
        near, wrong = mine.products(theirs, slice(0, 20))
        a, b = np.divmod(np.arange(400), 20)
        true = mine.cosines(theirs, a, b).reshape(20, 20)
        assert np.all(np.abs(near - true) <= wrong) and wrong.max() < 0.6


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], "x"), (1, [2.0, 0.0], None), (2, [0.0, 0.0], "x"), (3, None, "x"), (4, [1.0, None], "x"),
        (5, [1.0, nan], "x"), (6, [inf, 1.0], "x"), (7, [], "x"), (None, [1.0, 0.0], "x"), (8, [1.0, 0.0, 0.0], "x"),
        (9, [0.0, 1.0], "x"), (10, [1.0, 0.0], "x"), (10, [1.0, 0.0], "x"), (50, [0.0, 0.0], "x"), (100, [1.0, 1.0, 1.0], "y"),
        (100, [1.0, 1.0, 1.0], "z"),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string").withColumnRenamed("id", "dims")
    got = found(neighbour_tiles.nearest(table.where("vec_id % 50 = 0"), table, 4))
    assert {q: [v for v, _ in x] for q, x in got.items()} == {0: [1, 10, 10, 9], 100: [8]}
    copies = spark.createDataFrame([(0, [1.0, 0.0])] * 30 + [(i, [1.0, 0.0]) for i in range(1, 9)], "vec_id long, embedding array<double>")
    assert [v for v, _ in found(neighbour_tiles.nearest(copies.where("vec_id = 0"), copies, 5))[0]] == [1, 2, 3, 4, 5]
    assert [v for v, _ in found(neighbour_tiles.nearest(copies.where("vec_id = 8"), copies, 5))[8]] == [0] * 5
    assert neighbour_tiles.nearest(table.limit(0), table).count() == 0
    assert neighbour_tiles.nearest(table, table.limit(0)).count() == 0
