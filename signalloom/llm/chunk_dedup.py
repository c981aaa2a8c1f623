"""Substring de-duplication by content-defined chunking.

A gear hash rolls over the bytes of a text and cuts where some of its bits are zero, so that
cuts depend on the bytes just before them and move along with insertions.  A chunk begins at
every cut and ends ``pieces`` cuts later, so chunks overlap and a passage loses little at its
borders.  Chunks are de-duplicated by digest: the first one (least document, first place)
stays.  Repeated chunks that make a passage are reported or cut out; short ones are not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, block_count, block_of, shielded, text_bytes, with_text
from .counting import ASKED, Asking, sum_and_least, told, totals
from .packed import PIECE, span_digests, utf8

_GEAR = np.random.default_rng(20_260_917).integers(0, 2**32, 256, dtype=np.uint32)
#: The gear hash shifts by one bit a byte, so bits up to 15 depend on 16 bytes.
_REACH = 16
_NO_ID = (1 << 62) + (1 << 61)


def cuts(buf: np.ndarray, offsets: np.ndarray, cut_bits: int, max_bytes: int) -> np.ndarray:
    """Where chunks begin or end, ascending, with the ends of all texts among them.

    A cut comes before a whole character, at least ``_REACH`` bytes into its text, and at the
    latest ``max_bytes`` after the one before.
    """
    found = []
    mask = np.uint32(((1 << cut_bits) - 1) << (_REACH - cut_bits))
    for at in range(0, len(buf), PIECE):
        low = max(0, at - _REACH)
        h = _GEAR[buf[low : at + PIECE]]
        for step in (1, 2, 4, 8):
            longer = h.copy()
            longer[step:] += h[:-step] << np.uint32(step)
            h = longer
        found.append(np.flatnonzero((h[at - low :] & mask) == 0) + at + 1)
    inner = np.concatenate(found) if found else np.zeros(0, np.int64)
    inner = inner[inner < len(buf)]
    inner = inner[(buf[inner] & 0xC0) != 0x80]
    begins = offsets[np.searchsorted(offsets, inner, "right") - 1]
    out = np.union1d(inner[inner - begins >= _REACH], offsets)
    gaps = np.diff(out)
    extra = (gaps - 1) // max_bytes
    if extra.any():
        which = np.repeat(np.arange(len(gaps)), extra)
        turn = np.arange(len(which)) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        more = out[which] + turn * max_bytes
        for _ in range(3):  # forward to the next whole character
            more = np.where((buf[np.minimum(more, len(buf) - 1)] & 0xC0) == 0x80, more + 1, more)
        out = np.union1d(out, more)
    return out


def _rank(doc_id: Column, text: Column) -> Column:
    """Ids as non-negative numbers in their order; below zero and missing ones come last.

    Rows without an id are told apart by their texts, so that one of them stays wherever they are.
    """
    spare = F.lit(_NO_ID) + F.coalesce(F.xxhash64(text), F.lit(0)).bitwiseAND(F.lit((1 << 61) - 1))
    return F.when(doc_id.isNull(), spare).when(doc_id < 0, F.lit(1 << 62) - doc_id).otherwise(doc_id)


def _id(rank: np.ndarray) -> pa.Array:
    values = np.where(rank < (1 << 62), rank, (1 << 62) - rank)
    return pa.array(values, pa.int64(), mask=rank >= _NO_ID)


class _Chunks:
    def __init__(self, table: pa.Table, cut_bits: int, max_bytes: int, pieces: int):
        buf, self.offsets = utf8(table.column("text"))
        self.edges = cuts(buf, self.offsets, cut_bits, max_bytes)
        self.text = np.searchsorted(self.offsets, self.edges[:-1], "right") - 1  # of each piece
        n = len(self.text)
        end = np.searchsorted(self.text, self.text, "right")  # one past the last piece of the text
        begin = np.arange(n)
        self.begin = begin[(begin + pieces <= end) | (begin == np.searchsorted(self.text, self.text))]
        self.end = np.minimum(self.begin + pieces, end[self.begin])
        self.keys = span_digests(buf, self.edges[self.begin], self.edges[self.end])
        self.rank = table.column("rank").to_numpy()[self.text] if n else np.zeros(0, np.int64)
        self.distinct, self.where = np.unique(self.keys, return_inverse=True)


def repeated_passages(
    docs: DataFrame,
    min_bytes: int = 96,
    cut_bits: int = 4,
    pieces: int = 4,
    max_bytes: int = 256,
    block_bytes: int = BLOCK_BYTES,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per repeated passage: doc_id, kept_doc_id, start_byte, n_bytes, n_chunks.

    A passage is a stretch covered by chunks that all occur earlier (in a document with a
    smaller id, or before in the same one), at least ``min_bytes`` long; ``kept_doc_id`` is the
    document that keeps the chunk at its middle, ``n_chunks`` counts the pieces.  With pieces of
    2**``cut_bits`` bytes on average a repeated text of some 50 words holds many whole chunks.
    A text of fewer pieces is one chunk; null and empty texts have none.  Rows of one id are one
    document read in turn; ids below zero and missing ids come last, and of those without an id
    each distinct text is a document.
    """
    blocks = block_count(text_bytes(docs, text), block_bytes)
    buckets = max(1, -(-blocks // 2))
    rank = _rank(F.col(doc_id).cast("long"), F.col(text))
    source = docs.select(rank.alias("rank"), F.col(text).alias("text"), block_of(doc_id, text, blocks).alias("block"))

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        chunks, out = _Chunks(table, cut_bits, max_bytes, pieces), Asking()
        least = np.full(len(chunks.distinct), np.iinfo(np.int64).max)
        np.minimum.at(least, chunks.where, chunks.rank[chunks.begin])
        out.add(key[0].as_py(), 0, chunks.distinct, np.bincount(chunks.where, minlength=len(least)), least, buckets)
        return out.table()

    def passages(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        chunks = _Chunks(table, cut_bits, max_bytes, pieces)
        times, least = (x[chunks.where] for x in told(answers, 0))
        # the first of its digest in the least document stays
        own = np.flatnonzero(chunks.rank[chunks.begin] == least)
        _, first = np.unique(chunks.keys[own], return_index=True)
        repeated = times > 1
        repeated[own[first]] = False
        change = np.zeros(len(chunks.text) + 1, np.int64)
        np.add.at(change, chunks.begin[repeated], 1)
        np.add.at(change, chunks.end[repeated], -1)
        covered = np.cumsum(change[:-1]) > 0
        turn = np.flatnonzero(np.concatenate([[True], (covered[1:] != covered[:-1]) | (chunks.text[1:] != chunks.text[:-1])])[: len(covered)])
        begin, end = turn, np.append(turn[1:], len(covered))[: len(turn)]
        begin, end = begin[covered[begin]], end[covered[begin]]
        size = chunks.edges[end] - chunks.edges[begin]
        begin, end, size = begin[size >= min_bytes], end[size >= min_bytes], size[size >= min_bytes]
        again = np.flatnonzero(repeated)
        middle = again[np.searchsorted(chunks.begin[again], (begin + end) // 2, "right") - 1]
        return pa.table(
            {
                "doc_id": _id(chunks.rank[begin]),
                "kept_doc_id": _id(least[middle]),
                "start_byte": pa.array(chunks.edges[begin] - chunks.offsets[chunks.text[begin]], pa.int64()),
                "n_bytes": pa.array(size, pa.int64()),
                "n_chunks": pa.array(end - begin, pa.int64()),
            }
        )

    answers = totals(source.groupBy("block").applyInArrow(ask, ASKED), sum_and_least)
    schema = "doc_id long, kept_doc_id long, start_byte long, n_bytes long, n_chunks long"
    return source.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(passages, schema)


def without_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents with their own columns and without their repeated passages; ids must be unique."""
    found = repeated_passages(docs, doc_id=doc_id, text=text, **how)
    spans = found.groupBy(F.col("doc_id").alias("__id")).agg(F.sort_array(F.collect_list(F.struct("start_byte", "n_bytes"))).alias("__spans"))

    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for value, gone in zip(texts.to_pylist(), spans.to_pylist()):
            if gone:
                data, at, kept = value.encode(), 0, []
                for s in gone:
                    kept.append(data[at : s["start_byte"]])
                    at = s["start_byte"] + s["n_bytes"]
                value = b"".join([*kept, data[at:]]).decode()
            out.append(value)
        return pa.array(out, pa.string())

    plain, own = shielded(docs, doc_id, text, "n_chars")
    joined = plain.join(spans, F.col(doc_id) == F.col("__id"), "left")
    return own(with_text(joined, F.arrow_udf(cut, "string", F.ArrowUDFType.SCALAR)(F.col(text), F.col("__spans")), text))
