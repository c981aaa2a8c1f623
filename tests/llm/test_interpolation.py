import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.llm import interpolation
from signalloom.llm.blocks import remainder
from signalloom.llm.catalogue import QUERIES


def tokens(text):
    return [*re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower()), None]


def splits():
    rest = F.coalesce(remainder("doc_id", 40), F.lit(0))
    return F.coalesce(rest % 5 != 1, F.lit(True)), rest < 5


def check_base(rows, docs):
    trained = [t for i, t in docs if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for t in trained for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (i if i is not None else -1, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n,
         round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6))
        for i, t in docs
    )
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want])


def test_query_equals_counting_by_hand(spark, small):
    rows = QUERIES["op2_interpolation"](spark, small).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    check_base(rows, docs)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_blocks_and_orders(spark, small, order):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    train, deleted = splits()
    many = interpolation.scores(docs, train, deleted, order, block_bytes=60_000).toPandas().sort_values("doc_id")
    one = interpolation.scores(docs, train, deleted, order).toPandas().sort_values("doc_id")
    assert np.allclose(many["score"], one["score"]) and np.allclose(many["base_score"], one["base_score"])
    assert (many["score"] < 0).all()


def test_weights_are_shares_and_unseen_contexts_give_none_to_bigrams(spark):
    rows = [(i, t) for i, t in enumerate(["a b a c", "a b b", "c a b a", "b a", "a c c b"] * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table, numbers = interpolation.counts(docs, F.lit(True), F.col("doc_id") % 4 == 0)
    mixed = interpolation.weights(table, numbers, 2)
    assert np.allclose(mixed.sum(axis=1), 1) and (mixed[0][2] == 0)


def test_odd_rows(spark, odd, nothing):
    train, deleted = splits()
    rows = interpolation.scores(odd, train, deleted).collect()
    check_base(rows, [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert all(math.isfinite(r["score"]) for r in rows)
    assert interpolation.scores(nothing, train, deleted).count() == 0
    untrained = interpolation.scores(odd, F.lit(False), F.lit(False)).collect()
    assert {(round(r["base_score"], 9) + 0.0, r["score"], r["n_known"]) for r in untrained} == {(0.0, 0.0, 0)}
