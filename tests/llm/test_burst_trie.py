import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import connect, difference
from signalloom.llm import burst_trie
from signalloom.llm.catalogue import ORACLE, QUERIES


def by_hand(seqs):
    """seqs: {conv_id: [(role, text), ..]}; nodes by definition."""
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    out = set()
    for node, convs in members.items():
        subtree = [n for n in members if n[: len(node)] == node]
        children = [n for n in subtree if len(n) == len(node) + 1]
        leaves = [n for n in subtree if not any(x[: len(n)] == n and len(x) > len(n) for x in subtree)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in subtree if n)
        ends = ",".join(str(c) for c in sorted(convs) if len(seqs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(convs), len(node), parent, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rebuilt_by_hand(seqs):
    out = {}
    for c, own in seqs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = seqs.get(c - c % 100, [])[:h] + own[h:]
    return out


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows)) and df.columns == burst_trie.NODE_COLUMNS
    return set(rows)


def table(spark, seqs):
    rows = [(c, n, role, text) for c, s in seqs.items() for n, (role, text) in enumerate(s)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)


def some(rng, n, words, long):
    return {int(c): [("user" if i % 2 else "bot", "w" * int(rng.integers(1, words))) for i in range(rng.integers(0, long))] for c in range(n)}


def test_query_equals_sql(spark, small):
    assert difference(QUERIES["op11_burst_trie"](spark, small), connect(small), ORACLE["op11_burst_trie"]) is None


@pytest.mark.parametrize("capacity", [10_000, 30, 1])
def test_equals_brute_force_however_it_bursts(spark, capacity):
    rng = np.random.default_rng(7)
    seqs = {c: s for c, s in some(rng, 60, 3, 7).items() if s}
    same = [("user", "x" * (i % 5)) for i in range(40)]
    # near copies that part late, copies, one that ends on the way, one long on its own
    seqs |= {100 + i: same[: 30 + i % 3] + ([("bot", f"end {i}")] if i % 4 else []) for i in range(12)}
    seqs |= {150: same, 151: same, 200: [("user", f"only {i}") for i in range(50)]}
    turns = burst_trie.numbered(table(spark, seqs))
    assert found(burst_trie.prefix_trie(turns, capacity=capacity)) == by_hand(seqs)


@pytest.mark.parametrize("capacity", [10_000, 5])
def test_rebuilt_conversations(spark, monkeypatch, capacity):
    monkeypatch.setattr(burst_trie, "SLICE", 3)  # long conversations, on a small scale
    rng = np.random.default_rng(8)
    every = {100 * (c // 8) + c % 8 * 3: s for c, s in some(rng, 90, 4, 9).items() if s}
    for gone in (300, 500):
        every.pop(gone, None)
    turns, convs = burst_trie.rebuilt(burst_trie.numbered(table(spark, every)))
    want = rebuilt_by_hand(every)
    assert any(not s for s in want.values())
    assert {r["conv_id"]: r["n_turns"] for r in convs.collect()} == {c: len(s) for c, s in want.items()}
    assert found(burst_trie.prefix_trie(turns, convs, capacity)) == by_hand(want)


def test_odd_rows(spark):
    rows = [
        (1, None, "user", "first"), (1, 5, None, None), (1, 5, "user", "b"), (1, 5, "user", "b"), (2, 0, "user", "first"),
        (None, 0, "user", "lost"), (3, 0, "use", "rfirst"), (4, 0, "", ""), (5, 1, None, ""),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("step", F.lit("x")).withColumn("a", F.lit(1))
    turns = burst_trie.numbered(frame)
    ties = {r["t"]: r["h"] for r in spark.createDataFrame([("", ""), ("user", "b")], "r string, t string").select("t", F.xxhash64(F.lit(1), "r", "t").alias("h")).collect()}
    middle = sorted([("", ""), ("user", "b"), ("user", "b")], key=lambda t: ties[t[1]])
    seqs = {1: [("user", "first"), *middle], 2: [("user", "first")], 3: [("use", "rfirst")], 4: [("", "")], 5: [("", "")]}
    assert found(burst_trie.prefix_trie(turns)) == by_hand(seqs)
    assert burst_trie.prefix_trie(burst_trie.numbered(frame.limit(0))).count() == 0
