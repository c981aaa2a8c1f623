import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from signalloom.llm import fair_mix
from signalloom.llm.catalogue import ORACLE, QUERIES


def test_query_equals_sql(spark, small):
    assert difference(QUERIES["op5_fair_mix"](spark, small), connect(small), ORACLE["op5_fair_mix"]) is None


def fill(sizes, weights=(5, 2, 1), repeats=3):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, left = {}, sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in fixed]
        rate = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if rate * weight[s] > repeats * sizes[s]]
        if not over:
            return fixed | {s: rate * weight[s] for s in open_}
        for s in over:
            fixed[s] = repeats * sizes[s]
            left -= fixed[s]


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 500}, {"a": 0, "b": 7}, {"x": 100}, {"a": 1, "b": 1, "c": 1, "d": 900}])
def test_targets_equal_resharing(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "queue string, source_size long")
    got = {r["queue"]: r["target"] for r in fair_mix.targets(table, (5, 2, 1), 3).collect()}
    assert got == pytest.approx(fill(sizes))


def test_sources_come_near_their_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 400)), ["a", "b", "c", None][i % 4 if i % 3 else 0]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    mix = fair_mix.mix(docs).toPandas()
    by = mix.groupby(mix["source"].fillna("~")).agg({"taken": "sum", "target": "first", "size": "sum", "source_size": "first"})
    assert (by["size"] == by["source_size"]).all()
    assert ((by["taken"] - by["target"]).abs() <= 5).all()  # within the words left over by rounding
    assert mix["taken"].sum() == mix["size"].sum() and (mix["taken"] <= 3 * mix["size"]).all()
    again = fair_mix.mix(docs.repartition(2)).toPandas()
    keys = ["doc_id", "taken"]
    assert again[keys].sort_values(keys).values.tolist() == mix[keys].sort_values(keys).values.tolist()
    kept = fair_mix.mixed(docs.withColumn("taken_words", F.lit("own")))
    assert kept.columns == [*docs.columns, "taken_words", "_taken_words"]
    assert kept.agg(F.sum("_taken_words")).first()[0] == mix["size"].sum()


def test_odd_rows(odd, nothing):
    rows = fair_mix.mix(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert sum(r["taken"] for r in rows) == sum(r["size"] for r in rows)
    assert fair_mix.mix(nothing).count() == 0 and fair_mix.mixed(nothing).count() == 0
    blank = fair_mix.mix(odd.where("doc_id IN (3, 4, 5)")).collect()
    assert [r["taken"] for r in blank] == [0, 0, 0]
