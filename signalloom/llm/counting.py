"""Totals over all documents for the keys of each block of documents.

A block sends each of its distinct keys once, with its own sums, as sorted arrays cut by key
range.  A range of keys meets in one task, which sends every block the totals of the keys it
asked for, in the same order.  However often a key occurs, a block sends it once, so no key
makes a task larger than one entry per block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .packed import bucket_edges, give_back, pack_ints, pack_sorted, unpack_ints, unpack_sorted

#: kind: a family of keys; bucket: a key range; block: who asks; a and b: two numbers per key.
ASKED = "kind int, bucket int, block int, keys binary, a binary, b binary"
TOLD = "block int, kind int, bucket int, a binary, b binary"

#: Takes (key starts, a in key order, b in key order) to (total a, total b) per key.
Fold = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def sums(starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.add.reduceat(a, starts), np.add.reduceat(b, starts)


def sum_and_least(starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.add.reduceat(a, starts), np.minimum.reduceat(b, starts)


class Asking:
    """Collects the rows of ``ASKED`` of one task."""

    def __init__(self):
        self.columns: list[list] = [[], [], [], [], [], []]

    def add(self, block: int, kind: int, keys: np.ndarray, a: np.ndarray, b: np.ndarray, buckets: int, bits: int = 64) -> None:
        """``keys`` ascend without repeats; a and b are not negative."""
        edges = bucket_edges(keys, buckets, bits)
        for bucket in np.flatnonzero(np.diff(edges)):
            part = slice(edges[bucket], edges[bucket + 1])
            row = (kind, int(bucket), block, pack_sorted(keys[part]), pack_ints(a[part]), pack_ints(b[part]))
            for column, value in zip(self.columns, row):
                column.append(value)

    def table(self) -> pa.Table:
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        names = [c.split()[0] for c in ASKED.split(", ")]
        return pa.table([pa.array(v, k) for v, k in zip(self.columns, kinds)], names=names)


def totals(asked: DataFrame, fold: Fold = sums, extra: Callable | None = None, own_b: bool = False) -> DataFrame:
    """``TOLD`` rows for ``ASKED`` rows; a null a is nothing for every key.

    ``extra(kind, total a, total b)`` may give two arrays to be told to block -1 per range.
    With ``own_b`` a block is told the total of b only for keys to which it gave some b, else 0.
    """

    def tell(table: pa.Table) -> pa.Table:
        give_back()
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        blocks = table.column("block").to_pylist()
        keys = [unpack_sorted(k) for k in table.column("keys").to_pylist()]
        a = np.concatenate([unpack_ints(x) if x else np.zeros(len(k), np.int64) for x, k in zip(table.column("a").to_pylist(), keys)]).astype(np.int64)
        b = np.concatenate([unpack_ints(x) for x in table.column("b").to_pylist()]).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        every = np.concatenate(keys)
        del keys
        order = np.argsort(every)
        every = every[order]
        new = np.concatenate([[True], every[1:] != every[:-1]])
        all_a, all_b = fold(np.flatnonzero(new), a[order], b[order])
        where = np.empty(len(order), np.int64)
        where[order] = np.cumsum(new) - 1
        rows = [[], [], [], [], []]
        for block, lo, hi in zip(blocks, [0, *ends[:-1]], ends):
            mine = where[lo:hi]
            told_b = np.where(b[lo:hi] > 0, all_b[mine], 0) if own_b else all_b[mine]
            for column, value in zip(rows, (block, kind, bucket, pack_ints(all_a[mine]), pack_ints(told_b))):
                column.append(value)
        if extra is not None:
            told = extra(kind, all_a, all_b)
            for column, value in zip(rows, (-1, kind, bucket, pack_ints(told[0]), pack_ints(told[1]))):
                column.append(value)
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array(v, k) for v, k in zip(rows, kinds)], names=[c.split()[0] for c in TOLD.split(", ")])

    return asked.groupBy("kind", "bucket").applyInArrow(tell, TOLD)


def told(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The totals of one kind in the order of the block's ascending keys."""
    rows = sorted(
        (r for r in table.select(["kind", "bucket", "a", "b"]).to_pylist() if r["kind"] == kind), key=lambda r: r["bucket"]
    )
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate([unpack_ints(r[c]) for r in rows]).astype(np.int64) for c in ("a", "b"))
