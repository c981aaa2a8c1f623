import hashlib
from collections import Counter

import numpy as np
import pytest

from signalloom.llm import suffix_levels
from signalloom.llm.catalogue import QUERIES
from signalloom.llm.packed import unpack_ints


def by_hand(rows, length=400):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(hash(b[i : i + length]) for _, b in data for i in range(len(b) - length + 1))
    out = Counter()
    for doc, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[hash(b[i : i + length])] > 1:
                gone[i : i + length] = True
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out[doc, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def found(df):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def test_query_equals_brute_force(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = by_hand(rows)
    assert sum(n for k, n in want.items() if k[2]) > 20
    assert found(QUERIES["op10_suffix_levels"](spark, small)) == want


@pytest.mark.parametrize("batches, block_bytes", [(1, 1 << 20), (5, 2000)])
def test_batches_and_blocks_change_nothing(spark, batches, block_bytes):
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghij "))
    shared = ["".join(rng.choice(letters, n)) for n in (40, 60, 130)]
    rows = []
    for i in range(40):
        own = ["".join(rng.choice(letters, int(n))) for n in rng.integers(0, 60, 3)]
        rows.append((i, own[0] + shared[i % 3][i % 7 :] + own[1] + (shared[2] if i % 5 == 0 else "") + own[2]))
    rows += [(90, "a" * 300), (91, "xyz" * 100), (92, "é" * 50 + "b" * 49), (93, "b" * 50), (94, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_levels.remove_repeats(docs, length=50, reach=24, gram=8, batches=batches, block_bytes=block_bytes)
    assert found(got) == by_hand(rows, 50)
    # what is too short to go shows as a match, and what goes is matched
    for r in got.collect():
        assert r["n_matched"] >= r["longest_match"] >= (50 if r["n_removed"] else 0)
        assert r["longest_match"] > 0 or all(s[x : x + 48] not in dict(rows)[r["doc_id"]] for s in shared[:2] for x in range(len(s) - 47))


def test_a_batch_meets_the_levels_before_it(spark):
    rng = np.random.default_rng(4)
    own = ["".join(rng.choice(list("abcdefgh"), 900)) for _ in range(6)]
    texts = [own[0], own[1], own[0][:500] + own[2][:300], own[3], own[1], own[4]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "block int, text string")
    asked = suffix_levels.suffixes(docs, 400, 128, 32, 1).cache()
    family = suffix_levels.SuffixFamily(spark)
    seen = []
    for n in range(6):
        batch = asked.where(f"block = {n}")
        leading = [unpack_ints(r["a"]) for r in family.matches(batch).where("kind = 0").collect()]
        seen.append(int((np.concatenate(leading) > 0).sum()) if leading else 0)
        family.add(batch)
    assert seen[0] == seen[1] == seen[3] == seen[5] == 0 and 0 < seen[2] < seen[4]
    assert [len(level) for level in family.levels] == [0, 1, 1]
    asked.unpersist()


def test_passages_too_short_to_go_are_matched(spark):
    rng = np.random.default_rng(11)
    passages = ["".join(rng.choice(list("abcdefghij "), 260)) for _ in range(30)]
    rows = [(i, "".join(rng.choice(list("abcdefghij "), 300)) + (passages[i % 30] if i < 60 else "")) for i in range(120)]
    got = {r["doc_id"]: r for r in suffix_levels.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=9000).collect()}
    assert all(r["n_removed"] == 0 for r in got.values())
    assert all((r["longest_match"] >= 144) == (i < 60) for i, r in got.items())


def test_odd_rows(odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(suffix_levels.remove_repeats(odd, length=30, reach=16, gram=8)) == by_hand(rows, 30)
    assert suffix_levels.remove_repeats(nothing).count() == 0
