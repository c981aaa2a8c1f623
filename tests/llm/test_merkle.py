import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from compare import connect, difference
from signalloom.llm import merkle
from signalloom.llm.catalogue import ORACLE, QUERIES


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(digests, fanout):
    """(root, siblings in order with the side they stand on, per leaf)."""
    paths = [[] for _ in digests]
    spots = list(range(len(digests)))
    while len(digests) > 1:
        for leaf, at in enumerate(spots):
            a = at - at % fanout
            paths[leaf].append(("".join(digests[a:at]), "".join(digests[at + 1 : a + fanout])))
            spots[leaf] = at // fanout
        digests = [sha(*digests[a : a + fanout]) for a in range(0, len(digests), fanout)]
    return digests[0], paths


def by_hand(rows, fanout):
    """rows: (doc_id, source, lang, n_chars, text)"""
    queues = {}
    for r in rows:
        queues.setdefault(r[1], []).append((r[0], sha(*[framed(v) for v in r])))
    order = sorted(queues, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        queues[s].sort(key=lambda e: (e[0] is not None, e[0] or 0, e[1]))
        trees[s] = tree([leaf for _, leaf in queues[s]], fanout)
    root, tops = tree([trees[s][0] for s in order], fanout) if order else (None, [])
    out = Counter()
    for s, top in zip(order, tops):
        for (i, leaf), path in zip(queues[s], trees[s][1]):
            out[i, leaf, trees[s][0], root, sha(*[b + a for b, a in path + top])] += 1
    return out


def found(df):
    return Counter((r["id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in df.collect())


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def test_query_equals_sql(spark, small):
    assert difference(QUERIES["op13_merkle"](spark, small), connect(small), ORACLE["op13_merkle"]) is None


# with a fanout of 2 a run has 8 leaves, so that these sizes take several rounds and end unevenly
@pytest.mark.parametrize("sizes", [(1,), (8, 9), (0, 17, 64, 65), (200, 3, 131, 1, 41)])
def test_equals_brute_force(spark, sizes):
    rows = [(i * 7 % 1009, f"s{k}" if k else None, "en", i, f"text {i} é") for k, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    made = merkle.manifest(docs, fanout=2, proofs=True)
    assert found(made) == by_hand(rows, 2)
    assert made.where(~F.col("verified")).count() == 0
    assert made.where(merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0


def test_many_sources(spark):
    rows = [(i, f"source {i % 150}", None, None, "x") for i in range(400)]
    assert found(merkle.manifest(spark.createDataFrame(rows, SCHEMA), fanout=3)) == by_hand(rows, 3)


def test_a_changed_field_is_found(spark):
    rows = [(i, "a", "en", 1, "Text" if i % 3 else "text") for i in range(50)]
    made = merkle.manifest(spark.createDataFrame(rows, SCHEMA), fanout=4, claims={"text": F.lower("text")})
    assert {r["id"] for r in made.where("verified").collect()} == {i for i in range(50) if i % 3 == 0}


def test_odd_rows(spark, odd, nothing):
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in odd.collect()]
    clash = odd.withColumn("queue", F.lit(1)).withColumn("run", F.lit("x")).withColumn("leaf", F.lit(2)).withColumn("path", F.lit(3))
    assert found(merkle.manifest(clash, fanout=2)) == by_hand(rows, 2)
    # null and empty differ, and so do fields that run into one another
    pair = spark.createDataFrame([(1, "a", None, None, ""), (1, "a", "", None, None)], SCHEMA)
    assert merkle.manifest(pair).select("leaf").distinct().count() == 2
    assert merkle.manifest(nothing).count() == 0
