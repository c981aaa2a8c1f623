"""Exact removal of repeated byte strings with a logarithmic family of sparse suffix arrays.

Of all suffixes of the corpus the arrays hold those that start at anchors.  Every string of
``reach`` bytes has one: the place in it whose first ``gram`` bytes have the least digest.  Equal
strings have their anchors at equal places, so two copies of a longer string share the anchor of
its first ``reach`` bytes, and with it the suffix's first ``reach`` bytes.

An array is sorted by digests of the suffixes' leading bytes, not by the bytes themselves: equal
beginnings are neighbours, which is all that is asked of the order.  Every batch of documents
gets its array; arrays of equal level are merged into one of the next level.  ``matches``
merge-scans the suffixes of any documents against all levels.  Because removal is symmetric (the
first copy goes as well), the documents of all batches are scanned when the last batch is in.

Where the surroundings of an anchor are repeated as a whole, all strings with that anchor are;
where only its beginning is, the strings themselves are counted.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import remove_folder, stage_folder
from .blocks import BLOCK_BYTES, block_count, block_of, text_bytes
from .counting import ASKED, Asking, told, totals
from .packed import PIECE, combine, counted, mix, pack_ints, pack_sorted, prefix_sums, spans, unpack_ints, unpack_sorted, utf8

_LEADING, _AROUND, _STRING = 0, 1, 2
_LEVEL = -2


class Anchors:
    """The anchors of a block's texts, and which strings each is the anchor of.

    ``at``: places, ascending.  ``first`` and ``last``: the first and last string of ``length``
    bytes whose first ``reach`` bytes have their anchor here; where ``last`` is smaller there is
    none, since its text ends before.
    """

    def __init__(self, texts, length: int, reach: int, gram: int):
        self.buf, self.offsets = utf8(texts)
        self.length, self.reach, self.gram = length, reach, gram
        first, last, self.at = self._runs()
        self.text = np.searchsorted(self.offsets, self.at, "right") - 1
        self.end = self.offsets[self.text + 1]
        self.first, self.last = first, np.minimum(last, self.end - length)

    def _runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last string of ``reach`` bytes, within one text, of each anchor."""
        wide, reach = self.reach - self.gram + 1, self.reach
        runs = []
        step = PIECE - reach
        ends = self.offsets[1:]
        for a in range(0, max(0, len(self.buf) - reach + 1), step):
            z = min(len(self.buf), a + step + reach - 1)
            sums = prefix_sums(self.buf[a:z])
            at = np.arange(z - a - self.gram + 1)
            digest = mix(spans(sums, at, at + self.gram))
            # the place in the low bits: the least value names its first place
            key = (digest & ~np.uint64(0x1FFFFF)) | at.astype(np.uint64)
            rows = -(-len(key) // wide)
            padded = np.full(rows * wide, np.uint64(0xFFFFFFFFFFFFFFFF))
            padded[: len(key)] = key
            grid = padded.reshape(rows, wide)
            up = np.minimum.accumulate(grid, axis=1).reshape(-1)
            down = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
            n = z - a - reach + 1
            least = (np.minimum(down[:n], up[wide - 1 : wide - 1 + n]) & np.uint64(0x1FFFFF)).astype(np.int64)
            # strings that would cross the end of a text have no anchor
            for end in ends[np.searchsorted(ends, a, "right") : np.searchsorted(ends, z - 1, "right")] - a:
                least[max(0, end - reach + 1) : end] = -1
            new = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
            stop = np.append(new[1:], n) - 1
            whole = least[new] >= 0
            runs.append(np.stack([new[whole], stop[whole], least[new[whole]]]) + a)
        if not runs:
            return (np.zeros(0, np.int64),) * 3
        first, last, anchor = np.concatenate(runs, axis=1)
        # the border of two pieces may cut a run
        new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])[: len(anchor)])
        return first[new], last[np.append(new[1:], len(anchor))[: len(new)] - 1], anchor[new]

    def digests(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Digests of spans of at most some hundred bytes; starts ascend."""
        out = np.empty(len(starts), np.uint64)
        reach = 2 * self.length
        i = 0
        while i < len(starts):
            a = int(starts[i])
            j = int(np.searchsorted(starts, a + PIECE - reach, "right"))
            sums = prefix_sums(self.buf[a : min(len(self.buf), a + PIECE)])
            out[i:j] = spans(sums, starts[i:j] - a, ends[i:j] - a)
            i = j
        return out

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Per anchor the digest of the suffix's first bytes, and of all bytes its strings may hold.

        A suffix that ends before ``reach`` bytes is told apart by its length.
        """
        begin = self.offsets[self.text]
        low = np.maximum(begin, self.at - (self.reach - self.gram))
        high = np.minimum(self.end, self.at + self.length)
        leading = self.digests(self.at, np.minimum(self.end, self.at + self.reach))
        return leading, combine(self.digests(low, high), (self.at - low).astype(np.uint64))

    def strings(self, which: np.ndarray) -> np.ndarray:
        """Starts of all strings of some anchors, ascending."""
        n = np.maximum(0, self.last[which] - self.first[which] + 1)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(self.first[which], n) + inner


def suffixes(docs: DataFrame, length: int, reach: int, gram: int, buckets: int) -> DataFrame:
    """``ASKED`` rows of the suffixes of each block: distinct digests and how often each occurs."""

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        anchors, out = Anchors(table.column("text"), length, reach, gram), Asking()
        for kind, keys in zip((_LEADING, _AROUND), anchors.entries()):
            distinct, times = counted(keys)
            out.add(key[0].as_py(), kind, distinct, times, np.zeros(len(times), np.int64), buckets)
        return out.table()

    return docs.select("block", "text").groupBy("block").applyInArrow(ask, ASKED)


class SuffixFamily:
    """Levels of arrays: rows of key range, ascending digests and how often each occurs.

    ``fanout`` arrays of one level become one of the next.
    """

    def __init__(self, spark, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = []

    def _write(self, arrays: DataFrame) -> str:
        def merge(table: pa.Table) -> pa.Table:
            keys = np.concatenate([unpack_sorted(k) for k in table.column("keys").to_pylist()])
            times = np.concatenate([unpack_ints(a) for a in table.column("a").to_pylist()])
            distinct, total = counted(keys, times.astype(np.int64))
            one = table.slice(0, 1)
            nothing = pack_ints(np.zeros(len(distinct), np.int64))
            return pa.table([one["kind"], one["bucket"], pa.array([_LEVEL], pa.int32()), [pack_sorted(distinct)], [pack_ints(total)], [nothing]], schema=one.schema)

        path = stage_folder(self.spark)
        arrays.groupBy("kind", "bucket").applyInArrow(merge, ASKED).write.parquet(path)
        return path

    def add(self, batch: DataFrame) -> None:
        """The array of one batch of ``suffixes``, and the merges it calls for."""
        self.levels = self.levels or [[]]
        self.levels[0].append(self._write(batch))
        for n in range(len(self.levels)):
            if len(self.levels[n]) == self.fanout:
                merged = self._write(self._read(self.levels[n]))
                for path in self.levels[n]:
                    remove_folder(self.spark, path)
                self.levels[n] = []
                if n + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[n + 1].append(merged)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(ASKED).parquet(*paths)

    def arrays(self) -> DataFrame:
        paths = [p for level in self.levels for p in level]
        return self._read(paths) if paths else self.spark.createDataFrame([], ASKED)

    def matches(self, asked: DataFrame) -> DataFrame:
        """How often all levels hold the suffixes of each block of ``suffixes``."""
        return totals(asked.withColumn("a", F.lit(None).cast("binary")).unionByName(self.arrays())).where("block >= 0")


def remove_repeats(
    docs: DataFrame,
    length: int = 400,
    reach: int = 144,
    gram: int = 32,
    batches: int = 4,
    block_bytes: int = BLOCK_BYTES,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_matched, longest_match and kept per document.

    Every byte goes that is covered by a string of ``length`` bytes which also starts somewhere
    else, in the same document or another, judged on the input.  Strings never cross documents;
    a null text is empty.  Repeated rows are documents of their own.  Strings are compared by
    64-bit digests within the strings of one anchor.

    ``n_matched`` counts the bytes of ``reach``-byte strings at anchors that also start somewhere
    else, ``longest_match`` is the longest stretch of them: any match of ``2 * reach`` bytes and
    more shows there, also where it is too short to be removed.  ``kept`` is binary.
    """
    if not gram <= reach or 2 * reach - gram > length:
        raise ValueError("a string has to hold its anchor's first reach bytes: 2 * reach - gram <= length")
    spark = docs.sparkSession
    blocks = block_count(text_bytes(docs, text), block_bytes)
    buckets = max(1, -(-blocks // 3))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), block_of(doc_id, text, blocks).alias("block"))
    folder = stage_folder(spark)
    suffixes(source, length, reach, gram, buckets).write.parquet(folder)
    asked = spark.read.schema(ASKED).parquet(folder)
    family = SuffixFamily(spark, fanout=4)
    for n in range(min(batches, blocks)):
        family.add(asked.where(F.col("block") % batches == n))

    def judged(anchors: Anchors, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors whose strings are all repeated, whose strings have to be counted, and whose
        beginning is repeated."""
        leading, around = [
            told(answers, kind)[0][np.unique(keys, return_inverse=True)[1]] for kind, keys in zip((_LEADING, _AROUND), anchors.entries())
        ]
        return around > 1, leading > around, leading > 1

    def ask_strings(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        out = Asking()
        if table.num_rows:
            anchors = Anchors(table.column("text"), length, reach, gram)
            starts = anchors.strings(judged(anchors, answers)[1])
            distinct, times = counted(anchors.digests(starts, starts + length))
            out.add(key[0].as_py(), _STRING, distinct, times, np.zeros(len(times), np.int64), buckets)
        return out.table()

    def marked(n: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        change = np.zeros(n + 1, np.int32)
        np.add.at(change, begins, 1)
        np.add.at(change, ends, -1)
        return np.cumsum(change[:-1]) > 0

    def cut(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        anchors = Anchors(table.column("text"), length, reach, gram)
        gone, open_, begun = judged(anchors, answers)
        starts = anchors.strings(open_)
        times = told(answers, _STRING)[0][np.unique(anchors.digests(starts, starts + length), return_inverse=True)[1]]
        starts = starts[times > 1]
        gone &= anchors.last >= anchors.first
        size = len(anchors.buf)
        removed = marked(size, np.append(anchors.first[gone], starts), np.append(anchors.last[gone], starts) + length)
        begun &= anchors.at + reach <= anchors.end
        matched = marked(size, anchors.at[begun], anchors.at[begun] + reach)
        rows = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "n_matched": [], "longest_match": [], "kept": []}
        for a, z in zip(anchors.offsets[:-1], anchors.offsets[1:]):
            mark = removed[a:z]
            n = int(np.count_nonzero(mark))
            kept = (anchors.buf[a:z][~mark] if n else anchors.buf[a:z]).tobytes()
            n_spans = np.count_nonzero(mark[1:] & ~mark[:-1]) + int(mark[0]) if n else 0
            same = matched[a:z]
            n_matched = int(np.count_nonzero(same))
            longest = 0
            if n_matched:
                edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
                longest = int((edges[1::2] - edges[::2]).max())
            values = (int(z - a), n, int(n_spans), hashlib.sha256(kept).hexdigest(), n_matched, longest, kept)
            for column, value in zip(rows.values(), values):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        made = {name: pa.array(values, kind) for (name, values), kind in zip(rows.items(), kinds)}
        return pa.table({"doc_id": table.column("doc_id").combine_chunks()} | made)

    found = family.matches(asked)
    strings = source.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(ask_strings, ASKED)
    answers = found.unionByName(totals(strings))
    id_type = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_matched long, longest_match long, kept binary"
    return source.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cut, schema)
