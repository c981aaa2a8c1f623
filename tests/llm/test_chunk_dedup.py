import numpy as np

from signalloom.llm import chunk_dedup
from signalloom.llm.catalogue import QUERIES
from signalloom.llm.packed import utf8


def words(rng, n):
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_repeated_passages_are_caught_and_clean_documents_are_not(spark):
    rng = np.random.default_rng(8)
    passages = [words(rng, 60) for _ in range(60)]
    rows = [(i, words(rng, 120)) for i in range(100)]  # clean
    for n, p in enumerate(passages):
        for k in range(3):
            rows.append((1000 + 10 * n + k, f"{words(rng, 30 + k)} {p} {words(rng, 50)}"))
    found = chunk_dedup.repeated_passages(table(spark, rows), block_bytes=20_000).collect()
    removed = {r["doc_id"] for r in found}
    assert all(i >= 1000 for i in removed)
    texts = dict(rows)
    for n, p in enumerate(passages):
        first = 1000 + 10 * n
        assert {first + 1, first + 2} <= removed and first not in removed
        for r in (x for x in found if x["doc_id"] // 10 == first // 10):
            assert r["kept_doc_id"] == first
            cut = texts[r["doc_id"]].encode()[r["start_byte"] : r["start_byte"] + r["n_bytes"]]
            assert cut in f" {p} ".encode() and r["n_bytes"] >= 96
    clean = chunk_dedup.without_passages(table(spark, rows)).collect()
    assert {r["doc_id"]: r["text"] for r in clean if r["doc_id"] not in removed} == {i: t for i, t in rows if i not in removed}
    assert all(len(r["text"]) < len(texts[r["doc_id"]]) for r in clean if r["doc_id"] in removed)


def test_cuts_move_along_with_insertions():
    rng = np.random.default_rng(2)
    text = words(rng, 400)

    def chunks(t):
        buf, offsets = utf8(_array([t]))
        edges = chunk_dedup.cuts(buf, offsets, 4, 256)
        return [t.encode()[a:b] for a, b in zip(edges[:-1], edges[1:])]

    before, after = chunks(text), chunks("inserted " + text)
    assert b"".join(before).decode() == text
    assert len(set(before) - set(after)) <= 3


def _array(texts):
    import pyarrow as pa

    return pa.array(texts)


def test_texts_without_cuts_and_wide_characters():
    for text in ("a" * 5000, "é" * 3000, "", "x", "日本語" * 900):
        buf, offsets = utf8(_array([text, text]))
        edges = chunk_dedup.cuts(buf, offsets, 4, 256)
        assert set(offsets) <= set(edges) and (np.diff(edges) <= 259).all()
        for a, b in zip(edges[:-1], edges[1:]):
            buf[a:b].tobytes().decode()


def test_equals_brute_force_by_chunks(spark, small):
    """Every passage of the query is covered by chunks that occur earlier, and no such one is left out."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    seen, want = {}, set()
    for i in sorted(docs):
        buf, offsets = utf8(_array([docs[i]]))
        edges = chunk_dedup.cuts(buf, offsets, 4, 256).tolist()
        n = len(edges) - 1
        covered, keeper = [False] * (n + 1), {}
        for a in range(max(1, n - 3) if n else 0):
            z = min(n, a + 4)
            data = buf[edges[a] : edges[z]].tobytes()
            if data in seen:
                covered[a:z] = [True] * (z - a)
                keeper[a] = seen[data]
            else:
                seen[data] = i
        begin = None
        for at, c in enumerate(covered):
            if c and begin is None:
                begin = at
            elif not c and begin is not None:
                if edges[at] - edges[begin] >= 96:
                    want.add((i, keeper[max(k for k in keeper if k <= (begin + at) // 2)], edges[begin], edges[at] - edges[begin], at - begin))
                begin = None
    got = {tuple(r) for r in QUERIES["op6_chunk_dedup"](spark, small).collect()}
    assert got == want and len(want) > 20


def test_odd_rows(odd, nothing):
    rows = chunk_dedup.repeated_passages(odd, min_bytes=20).collect()
    assert {(r["doc_id"], r["kept_doc_id"]) for r in rows} == {(6, 1), (7, 7)}
    assert sum(r["doc_id"] == 6 for r in rows) == 2
    assert chunk_dedup.repeated_passages(nothing).count() == 0


def test_rows_without_an_id_keep_one_copy_however_cut(spark):
    rng = np.random.default_rng(12)
    passage = words(rng, 80)
    rows = [(None, f"{words(rng, 40)} {passage} {words(rng, 40)}") for _ in range(6)]
    found = [chunk_dedup.repeated_passages(table(spark, rows), block_bytes=n).collect() for n in (1 << 20, 700, 300)]
    assert [len(f) for f in found] == [5, 5, 5]
    assert {(r["doc_id"], r["kept_doc_id"]) for f in found for r in f} == {(None, None)}
