import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from signalloom.llm import simhash
from signalloom.llm.catalogue import QUERIES
from signalloom.llm.components import components


def print_by_hand(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def groups_by_hand(prints):
    """Smallest id reachable, for a dict id -> print."""
    ids = sorted(prints)
    value = np.array([prints[i] for i in ids], np.uint64)
    near = np.bitwise_count(value[:, None] ^ value[None, :]) <= 2
    out = {}
    for start in range(len(ids)):
        if ids[start] in out:
            continue
        todo = [start]
        while todo:
            at = todo.pop()
            if ids[at] not in out:
                out[ids[at]] = ids[start]
                todo += np.flatnonzero(near[at]).tolist()
    return out


@pytest.mark.parametrize("direct, held", [(1, 40), (1024, 1 << 18)])
def test_trie_finds_every_pair(monkeypatch, direct, held):
    monkeypatch.setattr(simhash, "_DIRECT", direct)
    monkeypatch.setattr(simhash, "_HELD", held)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 150, dtype=np.uint64)
    flips = [np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64) for _ in range(2)]
    x = np.unique(np.concatenate([base, base[rng.integers(0, 150, 500)] ^ flips[0] ^ flips[1], base & np.uint64(0xFFF)]))
    want = np.bitwise_count(x[:, None] ^ x[None, :]) <= 2
    got = np.zeros_like(want)
    for i, j in simhash.trie_pairs(x, x, 2):
        got[i, j] = True
    assert (got == np.triu(want, 1)).all()
    a, b = x[::2].copy(), x[1::2].copy()
    cross = np.zeros((len(a), len(b)), int)
    for i, j in simhash.trie_pairs(a, b, 2):
        cross[i, j] += 1
    assert (cross == want[::2, 1::2]).all()


@pytest.mark.parametrize("node", [8, 16_384])
def test_query_equals_brute_force(spark, small, monkeypatch, node):
    monkeypatch.setattr(simhash, "NODE_PRINTS", node)
    rows = QUERIES["op7_simhash"](spark, small).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    prints = {i: print_by_hand(t) for i, t in texts.items()}
    groups = groups_by_hand(prints)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{prints[i]:016x}", groups[i]) for i in texts}
    assert len(rows) == len(texts)


def test_fingerprint_is_spark_s_xxhash(spark):
    text = "Ünder THE bridge\twe met"
    got = spark.createDataFrame([(text,)], "s string").select(F.xxhash64(F.lit("the bridge we"))).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"the bridge we", 42)
    assert simhash.fingerprint(text) == print_by_hand(text)


def test_a_chain_is_one_component(spark):
    chain = [(i, i + 1) for i in range(300)] + [(500, 500), (700, 600), (600, 700)]
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {700: 600}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_document_of_each_group_stays(spark, odd, nothing):
    words = [f"word{i}" for i in range(200)]
    near = words[:150] + ["changed"] + words[151:]
    rows = [(5, " ".join(words)), (3, " ".join(near)), (9, " ".join(words)), (7, "something else than that"), (None, "no id here at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("print", F.lit("own"))
    prints = {i: print_by_hand(t) for i, t in rows if i is not None}
    groups = groups_by_hand(prints)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted({0, *groups.values()})
    assert {r["print"] for r in kept.collect()} == {"own"}
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == odd.count()
    # no words: print zero, linked like any other
    assert {r["component_id"] for r in found if r["doc_id"] in (3, 4, 5)} == {3}
    assert simhash.keep_one(odd).where("doc_id = 6").count() == 0 and simhash.keep_one(odd).where("doc_id IS NULL").count() == 1
    assert simhash.near_duplicates(nothing).count() == 0
