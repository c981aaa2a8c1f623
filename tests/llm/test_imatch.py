import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from signalloom.llm import imatch
from signalloom.llm.catalogue import QUERIES


def check_edits(rows, docs):
    """Lengths and edited texts against the table in order of id."""
    ordered = sorted(((-1 << 63) if i is None else i, t or "") for i, t in docs)
    got = sorted(((-1 << 63) if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows)
    want = []
    for at, (i, text) in enumerate(ordered):
        other, m = ordered[(at + 1) % len(ordered)][1], len(text) // 4
        want.append((i, len(text), hashlib.sha256((text[: len(text) - m] + other[:m]).encode()).hexdigest()))
    assert got == sorted(want)


def test_query(spark, small):
    rows = QUERIES["op4_imatch"](spark, small).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    check_edits(rows, docs)
    texts = dict(docs)
    prints = {r["doc_id"]: r["fingerprint"] for r in rows}
    by_text = {}
    for i, t in texts.items():
        assert by_text.setdefault(t, prints[i]) == prints[i]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert sum(r["near_edited"] > r["near_next"] for r in rows) > 0.85 * len(rows)


def test_fingerprint_by_hand(spark, small):
    """The subsets of one level, from the terms' hashes in Python."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    terms = imatch.lexicon(docs, 0.01, 0.2, 100_000)
    words = sorted({w for r in docs.collect() for w in re.findall(r"[a-z0-9\x80-\U0010ffff]+", _lower(r["text"]))})
    hashes = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    known = set(terms)
    counts = {}
    for r in docs.collect():
        for w in set(re.findall(r"[a-z0-9\x80-\U0010ffff]+", _lower(r["text"]))):
            counts[hashes[w]] = counts.get(hashes[w], 0) + 1
    assert known == {h for h, n in counts.items() if max(2, 2) <= n <= 40}
    for r in docs.withColumn("p", imatch.fingerprints(terms, "text")[0]).limit(40).collect():
        own = {hashes[w] for w in re.findall(r"[a-z0-9\x80-\U0010ffff]+", _lower(r["text"]))}
        level = max(0, math.floor(math.log2(len(own) / 40))) if own else 0
        assert r["p"]["level"] == level
        for name, up in (("low", level), ("high", level + 1)):
            subsets = {h & 15 for h in own & known if h & (((1 << up) - 1) << 4) == 0}
            empty = not any(h & (((1 << level) - 1) << 4) == 0 for h in own & known)
            assert {s for s, v in enumerate(r["p"][name]) if v} == subsets
            assert (r["p"]["whole"] != 0) == empty


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.mark.parametrize("parts", ["1", "7"])
def test_next_document_over_ranges(spark, parts):
    rows = [(i * i, f"text number {i} " * (i % 7)) for i in range(60)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        check_edits(imatch.compare_edits(docs).collect(), rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_odd_rows(spark, odd, nothing):
    rows = imatch.compare_edits(odd).collect()
    assert len(rows) == odd.count()
    distinct = {(r["doc_id"], r["text"] or "") for r in odd.collect()}
    seen, once = set(), []
    for r in rows:
        key = (r["doc_id"], r["n_chars"], r["edited_sha256"])
        once += [] if key in seen else [r]
        seen.add(key)
    check_edits(once, distinct)  # equal rows count once in the order
    assert imatch.compare_edits(nothing).count() == 0
    single = imatch.compare_edits(odd.where("doc_id = 2")).collect()
    assert single[0]["near_next"] == 1.0


def test_too_many_terms_is_an_error(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    with pytest.raises(ValueError):
        imatch.lexicon(docs, 0.0, 1.0, 10)


def test_only_dataframe_functions(spark, small):
    plan = imatch.compare_edits(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("words_edited", [0, 4])
def test_a_third_of_the_rows_are_near_copies(spark, words_edited):
    """All terms of such a group are out of the band; its members are alike all the same."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(6000)]
    one = rng.sample(vocabulary, 120)
    rows = []
    for i in range(600):
        words = list(one) if i % 6 < 2 else rng.choices(vocabulary, k=120)
        for at in rng.sample(range(120), words_edited if i % 6 < 2 else 0):
            words[at] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in imatch.compare_edits(docs).collect()}
    copies = [found[i] for i in found if i % 6 == 0]
    others = [found[i] for i in found if i % 6 in (2, 3, 4)]
    assert min(r["near_edited"] for r in copies) > 0.1
    assert min(r["near_next"] for r in copies) > (0.3 if words_edited else 0.99)
    assert max(r["near_next"] for r in others) < 0.1
