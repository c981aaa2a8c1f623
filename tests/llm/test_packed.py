import numpy as np
import pyarrow as pa
import pytest

from signalloom.llm import packed
from signalloom.llm.packed import LOWER, PUNCT, SPACE, bucket_edges, pack_ints, pack_sorted, span_digests, unpack_ints, unpack_sorted, utf8, words


@pytest.mark.parametrize("values", [[], [0], [1, 2**63, 2**64 - 1], [5] * 10, list(range(0, 70_000, 7))])
def test_round_trips(values):
    array = np.array(values, np.uint64)
    assert (unpack_ints(pack_ints(array)) == array).all()
    assert (unpack_sorted(pack_sorted(np.sort(array))) == np.sort(array)).all()


def test_words_equal_split():
    texts = ["The  quick\tfox", None, "", " \n", "one", "tail ", "Ünïcode É words", "x\x00y z", "\x1fctrl"]
    buf, offsets = utf8(pa.chunked_array([pa.array(texts[:4]), pa.array(texts[4:])]))
    low = LOWER[buf]
    starts, ends, text = words(low, offsets, SPACE)
    got = [(int(t), low[a:z].tobytes()) for a, z, t in zip(starts, ends, text)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in (t or "").encode().lower().split()]
    assert len(words(low, offsets, PUNCT)[0]) == 12


def test_digests_depend_on_bytes_alone(monkeypatch):
    monkeypatch.setattr(packed, "PIECE", 64)
    buf = np.frombuffer(b"abc" * 10 + b"Q" * 300 + b"abcabc" + b"R" * 130, np.uint8)
    starts, ends = np.array([0, 3, 30, 330, 336]), np.array([3, 6, 330, 333, 466])
    got = span_digests(buf, starts, ends)
    assert got[0] == got[1] == got[3] and len(set(got.tolist())) == 3
    monkeypatch.setattr(packed, "PIECE", 1 << 20)
    assert (span_digests(buf, starts, ends) == got).all()


def test_edges_cut_by_key_range():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**46, 1000, dtype=np.uint64))
    for buckets in (1, 3, 64):
        edges = bucket_edges(keys, buckets, 46)
        which = (keys >> np.uint64(14)) * np.uint64(buckets) >> np.uint64(32)
        assert (np.repeat(np.arange(buckets), np.diff(edges)) == which).all()
