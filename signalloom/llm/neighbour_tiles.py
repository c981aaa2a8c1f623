"""Nearest neighbours by a block matrix join with int8 product tiles.

Queries are cut into blocks and candidates into strips; a tile is one block against one strip.
A task holds the query block of its tile and streams the strip past it.  Of every piece of the
strip the products of int8 codes give all distances of the tile with a bound of their error;
only pairs that the bound leaves a chance are recomputed in double precision from the original
vectors, and a heap of the best ``k`` per query goes from piece to piece.  The tiles' lists are
merged by heaps again.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of one product tile held at a time (float32).
TILE_VALUES = 4 << 20
#: Codes are at most 127, so that a sum of so many products is exact in float32.
EXACT_DIMS = (1 << 24) // (127 * 127)

_BEST = "query_id long, vec_ids array<long>, scores array<double>"


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


class Codes:
    """int8 codes of vectors with their scale and the length of what the codes leave out."""

    def __init__(self, vectors: np.ndarray):
        # a power of two more or less changes no cosine, and squares stay finite
        self.vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        unit = self.vectors / self.norms[:, None]
        self.scale = np.abs(unit).max(axis=1) / 127
        self.codes = np.rint(unit / self.scale[:, None]).astype(np.int8)
        left = unit - self.codes * self.scale[:, None]
        self.left = np.sqrt((left * left).sum(axis=1))

    def products(self, other: Codes, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Cosines by codes and the most they can be wrong by.

        With u = u' + e and v = v' + f the products differ by u'f + ev, at most (1 + |e|)|f| + |e|.
        """
        sums = np.zeros((rows.stop - rows.start, len(other.codes)), np.float32)
        for a in range(0, self.codes.shape[1], EXACT_DIMS):
            part = slice(a, a + EXACT_DIMS)
            sums += self.codes[rows, part].astype(np.float32) @ other.codes[:, part].astype(np.float32).T
        sums *= self.scale[rows, None].astype(np.float32)
        sums *= other.scale[None, :].astype(np.float32)
        mine = self.left[rows, None]
        wrong = ((1 + mine) * other.left[None, :] + mine + 1e-5).astype(np.float32)
        return sums, wrong

    def cosines(self, other: Codes, mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        """Double precision, of the original vectors; a row's sum depends on that row alone."""
        dots = (self.vectors[mine] * other.vectors[theirs]).sum(axis=1)
        return dots / (self.norms[mine] * other.norms[theirs])


class Block:
    """A query block with the best ``k`` of each query so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.k, self.codes = ids, k, Codes(vectors)
        # heaps of (score, -vec_id): the worst of the best comes first
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.least = np.full(len(ids), -np.inf)

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        other = Codes(vectors)
        step = max(1, TILE_VALUES // len(ids))
        for a in range(0, len(self.ids), step):
            rows = slice(a, min(a + step, len(self.ids)))
            near, wrong = self.codes.products(other, rows)
            near[self.ids[rows, None] == ids[None, :]] = -np.inf
            floor = self.least[rows]
            if len(ids) > self.k:
                sure = np.partition(near - wrong, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
                floor = np.maximum(floor, sure)
            # ties may still win by their id, so equality stays
            mine, theirs = np.nonzero((near + wrong >= floor[:, None].astype(np.float32) - 1e-5) & (near > -np.inf))
            for z in range(0, len(mine), 1 << 16):
                part = slice(z, z + (1 << 16))
                self._push(mine[part] + a, theirs[part], other, ids)

    def _push(self, mine: np.ndarray, theirs: np.ndarray, other: Codes, ids: np.ndarray) -> None:
        scores = self.codes.cosines(other, mine, theirs)
        worth = scores >= self.least[mine]
        for q, score, vec in zip(mine[worth].tolist(), scores[worth].tolist(), ids[theirs[worth]].tolist()):
            heap = self.heaps[q]
            if len(heap) < self.k:
                heapq.heappush(heap, (score, -vec))
            else:
                heapq.heappushpop(heap, (score, -vec))
            if len(heap) == self.k:
                self.least[q] = heap[0][0]

    def best(self) -> pa.Table:
        lists = [sorted(heap, key=lambda e: (-e[0], -e[1])) for heap in self.heaps]
        return pa.table(
            {
                "query_id": pa.array(self.ids, pa.int64()),
                "vec_ids": pa.array([[-v for _, v in x] for x in lists], pa.list_(pa.int64())),
                "scores": pa.array([[s for s, _ in x] for x in lists], pa.list_(pa.float64())),
            }
        )


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _sweep(k: int):
    """Tiles from rows sorted by tile, queries first."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, block = None, [], None

        def closed() -> Iterator[pa.RecordBatch]:
            if block is not None:
                yield from block.best().to_batches()

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("dims", "block", "strip", "side")])
            edges = np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1
            for a, z in zip([0, *edges], [*edges, batch.num_rows]):
                if a == z:
                    continue
                part, key = batch.slice(a, z - a), tuple(keys[:3, a])
                if key != tile:
                    yield from closed()
                    tile, held, block = key, [], None
                ids, vectors = part.column("id").to_numpy(), _matrix(part, key[0])
                if keys[3, a] == 0:
                    held.append((ids, vectors))
                    continue
                if held:
                    block = Block(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]), k)
                    held = []
                if block is not None:
                    block.meet(ids, vectors)
        yield from closed()

    return sweep


def _merge(k: int):
    """The best ``k`` of every query of a partition, by one heap each."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                heap = heaps.setdefault(row["query_id"], [])
                for score, vec in zip(row["scores"], row["vec_ids"]):
                    if len(heap) < k:
                        heapq.heappush(heap, (score, -vec))
                    else:
                        heapq.heappushpop(heap, (score, -vec))
        found = [(q, n, -v, s) for q, heap in heaps.items() for n, (s, v) in enumerate(sorted(heap, key=lambda e: (-e[0], -e[1])), 1)]
        columns = list(zip(*found)) or [[], [], [], []]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
        names = ("query_id", "rank", "vec_id", "score")
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=list(names))

    return merge


def _without_spare_copies(rows: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the ``k + 1`` smallest ids, each at most ``k`` times.

    One of them may be the query's own; no query can have others among its best ``k``.
    """
    ids = rows.groupBy("vector", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    by_id = Window.partitionBy("vector").orderBy("id")
    kept = ids.withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1)
    return kept.select("id", "vector", F.explode(F.sequence(F.lit(1), "times")).alias("n")).drop("n")


def nearest(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 5,
    block_rows: int = 16_384,
    strip_rows: int = 1 << 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of ``vectors`` of largest cosine per query.

    Exact; nearest first, ties to the smaller ``vec_id``.  A row with the query's id is the
    query's own and never found.  Rows without an id, and vectors that are null, zero or hold a
    null or non-finite component, take no part; vectors of unequal length are not compared.
    Repeated rows count each by itself; a query id that occurs several times asks with its least
    vector.  Fewer than ``k`` candidates: all of them; none: no row.  Other columns are ignored.
    The matrix of blocks and strips follows the number of rows and of shuffle partitions.
    """
    spark = queries.sparkSession

    def plain(rows: DataFrame) -> DataFrame:
        kept = rows.where(F.col(vec_id).isNotNull() & usable(F.col(vector)))
        return kept.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector"))

    asking = plain(queries).groupBy("id").agg(F.min("vector").alias("vector"))
    offered = _without_spare_copies(plain(vectors), k)
    n_queries = queries.select(F.count(vec_id)).first()[0]
    n_rows = vectors.select(F.count(vec_id)).first()[0]
    blocks = max(1, math.ceil(n_queries / block_rows))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    strips = max(1, math.ceil(n_rows / strip_rows), math.ceil(tasks / blocks))

    def spread(side: int, own: str, parts: int, other: str, copies: int) -> list[Column]:
        place = F.pmod(F.xxhash64("id", "vector"), F.lit(parts)).cast("int").alias(own)
        return [F.size("vector").alias("dims"), place, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(other), F.lit(side).alias("side"), "id", "vector"]

    tiles = asking.select(*spread(0, "block", blocks, "strip", strips)).unionByName(
        offered.select(*spread(1, "strip", strips, "block", blocks))
    )
    key = ("dims", "block", "strip")
    sorted_tiles = tiles.repartition(max(tasks, min(blocks * strips, 100_000)), *key).sortWithinPartitions(*key, "side")
    best = sorted_tiles.mapInArrow(_sweep(k), _BEST)
    return best.repartition("query_id").mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")
