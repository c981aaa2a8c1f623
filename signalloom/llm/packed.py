"""Words and digests of Arrow text as NumPy arrays, and their compact transport.

Texts arrive as one Arrow buffer, so a batch costs a few array passes and no Python call per
word.  A digest is a polynomial over randomised byte values modulo 2**64, finished with a
bijective mixer; it depends on the bytes of its span alone.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa


def give_back() -> None:
    """Hand memory that is free again back to the system, which counts it as the worker's until then."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: What separates alphanumeric words; bytes of non-ASCII characters belong to words.
PUNCT = np.ones(256, dtype=bool)
PUNCT[0x30:0x3A] = PUNCT[0x61:0x7B] = PUNCT[0x80:] = False

_VALUES = np.random.default_rng(7_040_917).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes hashed at a time, which bounds the temporary arrays.
PIECE = 1 << 20


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE + 1, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A digest of an ordered pair of digests."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x2545F4914F6CDD1D) + mix(b))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column (null: empty) and the offset of each text, one more than texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    if not len(offsets):
        return buf[:0], np.zeros(1, np.int64)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(buf: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text index of each word; no word crosses two texts."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~gap[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets[1:], starts, "right")


def prefix_sums(piece: np.ndarray) -> np.ndarray:
    """Sums from which ``spans`` takes the digest of any span of the piece (at most PIECE bytes)."""
    sums = np.zeros(len(piece) + 1, np.uint64)
    np.cumsum(_VALUES[piece] * _UP[: len(piece)], out=sums[1:])
    return sums


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    raw = (sums[ends] - sums[starts]) * _DOWN[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def _long_span(buf: np.ndarray) -> int:
    total, step = 0, 1
    for at in range(0, len(buf), PIECE):
        piece = buf[at : at + PIECE]
        total = (total + int(np.sum(_VALUES[piece] * _UP[: len(piece)], dtype=np.uint64)) * step) % 2**64
        step = step * int(_UP[PIECE]) % 2**64
    return int(mix(np.array([(total + len(buf) * 0xA0761D6478BD642F) % 2**64], np.uint64))[0])


def span_digests(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Digest of each span; starts and ends both ascend."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = int(np.searchsorted(ends, a + PIECE, "right"))
        if j <= i:
            out[i] = _long_span(buf[a : ends[i]])
            i += 1
            continue
        sums = prefix_sums(buf[a : ends[j - 1]])
        out[i:j] = spans(sums, starts[i:j] - a, ends[i:j] - a)
        i = j
    return out


def counted(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sum of each weight (none: the number) per key."""
    if not weights:
        return np.unique(keys, return_counts=True)
    distinct, where = np.unique(keys, return_inverse=True)
    return distinct, *(np.bincount(where, w, len(distinct)).astype(np.int64) for w in weights)


# --- transport ---------------------------------------------------------------------------


def pack_ints(values: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes each as the largest needs.

    Equal places of all numbers lie together, so that the high ones of mostly small numbers
    are runs of zeros to the compression of a shuffle.
    """
    values = np.ascontiguousarray(values, dtype=np.uint64)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack_ints(blob: bytes) -> np.ndarray:
    width = blob[0]
    raw = np.frombuffer(blob, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.reshape(-1).view(np.uint64)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending keys as the first one and the differences of the rest."""
    if not len(keys):
        return b""
    return int(keys[0]).to_bytes(8, "little") + pack_ints(np.diff(keys))


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    first = np.frombuffer(blob, np.uint64, count=1)
    return np.cumsum(np.concatenate([first, unpack_ints(blob[8:])]), dtype=np.uint64)


def bucket_edges(keys: np.ndarray, buckets: int, bits: int = 64) -> np.ndarray:
    """Where each of ``buckets`` equal key ranges begins in ascending keys of ``bits`` bits."""
    lows = [(-(-(b << 32) // buckets)) << (bits - 32) for b in range(1, buckets)]
    inner = np.searchsorted(keys, np.array(lows, np.uint64)) if lows else np.zeros(0, np.int64)
    return np.concatenate([[0], inner, [len(keys)]]).astype(np.int64)
