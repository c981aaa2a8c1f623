"""A stored index for neighbour searches, and neighbour tables that follow new vectors.

The index is a table of lists.  A list holds the vectors nearest to its pivot; pivots lie in
cells around pivots of their own, so that a vector is measured against the cells' pivots and
those of a few cells, about four times the root of the number of lists.  Lists are partitions by
cell and sorted within, so that a batch of queries reads the cells, and the row groups, that it
probes.  It is built once and searched by as many batches as there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import staged
from .neighbours import _matrix, _squares, _unit, block_nearest, block_vectors, in_slices, nearest_chunks
from .vectors import similarity

#: Lists of an index at most; their pivots are broadcast (MAX_LISTS x dimensions doubles).
MAX_LISTS = 1 << 16
#: Vectors of a list that an index aims at.
LIST_VECTORS = 2048
#: Cells in which a vector looks for its list.
LOOK_CELLS = 4


class _Pivots:
    """The lists' pivots, ordered by cell."""

    def __init__(self, cells: np.ndarray, lists: np.ndarray, first: np.ndarray):
        self.cells, self.lists, self.first = cells, lists, first  # first: of each cell, one more than cells

    def probed(self, vectors: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest ``probes`` lists of each vector, from as many nearest cells as it takes."""
        rows, found = [], []
        order = np.sqrt(_squares(vectors, self.cells)).argsort(axis=1, kind="stable")
        held = np.diff(self.first)
        for i, cells in enumerate(order):
            enough = int(np.searchsorted(np.cumsum(held[cells]), probes)) + 1
            near = np.concatenate([np.arange(self.first[c], self.first[c + 1]) for c in cells[: max(LOOK_CELLS, enough)]])
            away = _squares(vectors[i : i + 1], self.lists[near])[0]
            best = near[np.lexsort((near, away))[:probes]]
            rows.append(np.full(len(best), i))
            found.append(best)
        return np.concatenate(rows), np.concatenate(found)

    def probes_of(self, vectors: np.ndarray, probes: int) -> np.ndarray:
        """``probed`` as a matrix of vectors and lists.

        Where a good part of all lists is probed, all are measured at once and selected, not sorted
        vector by vector.
        """
        mask = np.zeros((len(vectors), len(self.lists)), bool)
        if probes * 4 < len(self.lists):
            mask[self.probed(vectors, probes)] = True
            return mask
        order = np.sqrt(_squares(vectors, self.cells)).argsort(axis=1, kind="stable")
        held = np.diff(self.first)
        enough = (np.cumsum(held[order], axis=1) < probes).sum(axis=1) + 1
        looked = np.zeros(order.shape, bool)
        np.put_along_axis(looked, order, np.arange(order.shape[1]) < np.maximum(LOOK_CELLS, enough)[:, None], axis=1)
        away = _squares(vectors, self.lists)
        away[~np.repeat(looked, held, axis=1)] = np.inf
        if probes >= len(self.lists):
            return away < np.inf
        last = np.partition(away, probes - 1, axis=1)[:, probes - 1 : probes]
        mask = away < last
        # of lists as far as the last one the lower ones are probed
        tied = away == last
        return mask | (tied & (np.cumsum(tied, axis=1) <= probes - mask.sum(axis=1, keepdims=True)))

    def cell_of(self, lists: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, lists, "right") - 1


class NeighbourIndex:
    """An index under ``path``: ``lists`` (the table), ``pivots`` and ``sizes`` (one row per list)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(
        cls, vectors: DataFrame, path: str, metric: str = "sq_l2", list_vectors: int = LIST_VECTORS, max_lists: int = MAX_LISTS
    ) -> NeighbourIndex:
        """Write the index of ``vectors``: chunk_id, embedding and any columns to filter by.

        The pivots are a sample of ``max_lists`` vectors at most, chosen by a hash of the id; every
        vector with an id and an embedding is indexed.  ``metric`` is kept with the index.
        """
        spark = vectors.sparkSession
        index = cls(spark, path)
        scaled = _unit(F.col("embedding")) if metric == "cosine" else F.col("embedding").cast("array<double>")
        extra = [c for c in vectors.columns if c not in ("chunk_id", "embedding")]
        rows = vectors.where("chunk_id IS NOT NULL AND embedding IS NOT NULL")
        rows = staged(rows.select("chunk_id", scaled.alias("vector"), *extra))
        wanted = min(max_lists, max(1, math.ceil(rows.count() / list_vectors)))
        sample = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(wanted).select("vector").toPandas()
        if not len(sample):
            raise ValueError("no vectors to index")
        lists = np.unique(_matrix(sample["vector"]), axis=0)
        cells = lists[np.linspace(0, len(lists) - 1, max(1, round(math.sqrt(len(lists))))).astype(int)]
        own = _squares(lists, cells).argmin(axis=1)
        order = np.argsort(own, kind="stable")
        lists, own = lists[order], own[order]
        pivots = pd.DataFrame({"list": np.arange(len(lists)), "cell": own, "vector": lists.tolist(), "center": cells[own].tolist(), "metric": metric})
        schema = "list long, cell int, vector array<double>, center array<double>, metric string"
        spark.createDataFrame(pivots, schema).coalesce(1).write.parquet(f"{index.path}/pivots")
        shared = spark.sparkContext.broadcast(index._pivots())  # bounded by max_lists

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    found = shared.value.probed(_matrix(pdf["vector"]), 1)[1]
                    yield pdf.assign(cell=shared.value.cell_of(found).astype(np.int32), list=found)

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        placed = rows.mapInPandas(place, f"{kinds}, cell int, list long")
        # a list that holds most of the table is written by many tasks
        spread = placed.withColumn("__spot", F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 20)))
        spread = spread.repartitionByRange("cell", "list", "__spot").sortWithinPartitions("cell", "list").drop("__spot")
        spread.write.partitionBy("cell").parquet(f"{index.path}/lists")
        index.table().groupBy("list").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{index.path}/sizes")
        return index

    def _pivots(self) -> _Pivots:
        rows = self.spark.read.parquet(f"{self.path}/pivots").orderBy("list").toPandas()
        cells = rows.drop_duplicates("cell")
        used = cells["cell"].to_numpy()
        first = np.searchsorted(rows["cell"].to_numpy(), used)
        self.cell_names, self.metric = used, rows["metric"].iloc[0]
        return _Pivots(_matrix(cells["center"]), _matrix(rows["vector"]), np.append(first, len(rows)))

    def table(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists")

    def list_count(self) -> int:
        return self.spark.read.parquet(f"{self.path}/pivots").count()

    def search(
        self, queries: DataFrame, k: int = 5, probes: int = 8, where: Column | None = None, exclude_self: bool = False
    ) -> DataFrame:
        """query_chunk_id, rank, chunk_id, distance, similarity_score: the ``k`` nearest of the
        ``probes`` nearest lists of each query; ties go to the lower id.

        ``queries`` has chunk_id and embedding.  ``where`` filters the lists by columns of the
        index, before anything is measured.  Distances are those of ``nearest_chunks``.
        """
        pivots = self._pivots()
        scaled = _unit(F.col("embedding")) if self.metric == "cosine" else F.col("embedding").cast("array<double>")
        asked = staged(queries.where("chunk_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("chunk_id").alias("key"), scaled.alias("vector")))
        kind = asked.schema["key"].dataType.simpleString()
        shared = self.spark.sparkContext.broadcast(pivots)

        # one row per list; a tile is a run of lists with the vectors of one block, or one larger list
        sizes = self.spark.read.parquet(f"{self.path}/sizes").orderBy("list").toPandas()
        held = np.zeros(len(pivots.lists), np.int64)
        held[sizes["list"].to_numpy(np.int64)] = sizes["n"].to_numpy(np.int64)
        block = block_vectors(int(held.sum()))
        tile_of, rows_of = _tiles(held, block)
        tiles = self.spark.sparkContext.broadcast(tile_of)
        width = len(pivots.lists) + pivots.lists.shape[1]
        firsts = np.searchsorted(tile_of, np.arange(len(rows_of) + 1))

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for part in in_slices(len(pdf), width):
                    some = pdf.iloc[part]
                    mask = shared.value.probes_of(_matrix(some["vector"]), probes)
                    keys, vectors = some["key"].to_numpy(), some["vector"].to_numpy()
                    # a query goes once to a tile, with a bit for each list of it
                    row, tile, lists = [], [], []
                    for t in np.unique(tiles.value[mask.any(axis=0)]).tolist():
                        own = mask[:, firsts[t] : firsts[t + 1]]
                        row.append(np.flatnonzero(own.any(axis=1)))
                        tile.append(np.full(len(row[-1]), t))
                        lists += [bits.tobytes() for bits in np.packbits(own[row[-1]], axis=1)]
                    row, tile = np.concatenate(row), np.concatenate(tile)
                    for out in in_slices(len(row), pivots.lists.shape[1]):
                        yield pd.DataFrame({"key": keys[row[out]], "vector": vectors[row[out]], "tile": tile[out], "lists": lists[out]})

        routed = staged(asked.mapInPandas(route, f"key {kind}, vector array<double>, tile long, lists binary"))
        # one row per tile that is probed
        load = {r["tile"]: r["asked"] for r in routed.groupBy("tile").agg(F.count("*").alias("asked")).collect()}
        parts = [(t, math.ceil(int(rows_of[t]) / block) or 1, math.ceil(n / block)) for t, n in sorted(load.items())]
        parts = self.spark.createDataFrame(parts, "tile long, data_parts long, query_parts long")
        probed = np.flatnonzero(np.isin(tile_of, list(load)))
        cells = sorted({int(c) for c in pivots.cell_of(probed)})
        lists = self.table().where(F.col("cell").isin(cells))
        if len(probed):
            lists = lists.where((F.col("list") >= int(probed[0])) & (F.col("list") <= int(probed[-1])))
        if where is not None:
            lists = lists.where(where)
        spot = F.xxhash64(F.lit(7), F.col("key"))
        places = np.arange(len(tile_of)) - firsts[tile_of]
        places = self.spark.createDataFrame(list(zip(range(len(tile_of)), tile_of.tolist(), places.tolist())), "list long, tile long, place long")
        data = lists.select(F.col("chunk_id").alias("key"), "vector", F.col("chunk_id").alias("least"), "list")
        data = data.join(F.broadcast(places), "list").join(F.broadcast(parts), "tile").select(
            "key", "vector", "least", F.col("place").alias("list"), "tile", F.pmod(spot, F.col("data_parts")).alias("data_part"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_parts") - 1)).alias("query_part"),
        )
        asking = routed.join(F.broadcast(parts), "tile").select(
            "key", "vector", "lists", "tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("data_parts") - 1)).alias("data_part"),
            F.pmod(spot, F.col("query_parts")).alias("query_part"),
        )
        want = k + 1 if exclude_self else k
        side = ["tile", "data_part", "query_part"]
        pairs = asking.groupBy(side).cogroup(data.groupBy(side)).applyInPandas(block_nearest(want), f"query {kind}, key {kind}, distance double")
        if exclude_self:
            pairs = pairs.where("query != key")
        return _ranked(pairs.select(F.col("query").alias("query_chunk_id"), F.col("key").alias("chunk_id"), F.col("distance").alias("square")), k, self.metric)

    def search_exact(self, queries: DataFrame, k: int = 5, where: Column | None = None, exclude_self: bool = False) -> DataFrame:
        """What ``search`` would find if it probed all lists, by the exact join."""
        stored = self.table().withColumnRenamed("vector", "embedding")
        self._pivots()
        if self.metric == "cosine":
            queries = queries.withColumn("embedding", _unit(F.col("embedding")))
        found = nearest_chunks(stored, queries, k, "l2" if self.metric == "l2" else "sq_l2", exclude_self, where)
        distance = F.col("distance") / 2 if self.metric == "cosine" else F.col("distance")
        return found.withColumn("distance", distance).withColumn("similarity_score", similarity(F.col("distance")))


def _tiles(held: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The tile of each list, and the vectors of each tile, for lists of ``held`` vectors."""
    tile_of, now, rows = np.zeros(len(held), np.int64), 0, [0]
    for i, n in enumerate(held.tolist()):
        if rows[now] and rows[now] + n > block:
            now += 1
            rows.append(0)
        tile_of[i] = now
        rows[now] += n
    return tile_of, np.array(rows, np.int64)


def _ranked(pairs: DataFrame, k: int, metric: str) -> DataFrame:
    square = F.col("square")
    distance = {"l2": F.sqrt(square), "cosine": square / 2}.get(metric, square)
    order = Window.partitionBy("query_chunk_id").orderBy("square", "chunk_id")
    best = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("distance", distance)
    return best.select("query_chunk_id", "rank", "chunk_id", "distance", similarity(F.col("distance")).alias("similarity_score"))


def updated_neighbours(neighbours: DataFrame, stored: DataFrame, batch: DataFrame, k: int = 5, metric: str = "sq_l2", exclude_self: bool = False) -> DataFrame:
    """The neighbour table after ``batch`` (chunk_id, embedding) is merged into ``stored``.

    Equal to ``nearest_chunks`` over all vectors, but only new chunks, and chunks one of whose
    neighbours got another vector, search the whole table; all others keep their lists and take
    what the batch offers them.  Chunks of the batch that are stored are replaced.
    """
    changed = batch.select("chunk_id")
    kept = staged(stored.select("chunk_id", "embedding").join(changed, "chunk_id", "left_anti"))
    everything = kept.unionByName(batch.select("chunk_id", "embedding"))
    lists = neighbours.join(changed.withColumnRenamed("chunk_id", "query_chunk_id"), "query_chunk_id", "left_anti")
    # a list that held a replaced vector may lack the next one
    stale = lists.join(changed, "chunk_id", "left_semi").select(F.col("query_chunk_id").alias("chunk_id")).distinct()
    stale = staged(stale)
    asking = batch.select("chunk_id", "embedding").unionByName(kept.join(stale, "chunk_id", "left_semi"))
    fresh = nearest_chunks(everything, asking, k, metric, exclude_self)
    sound = kept.join(stale, "chunk_id", "left_anti")
    offers = nearest_chunks(batch, sound, k, metric)
    held = lists.join(stale.withColumnRenamed("chunk_id", "query_chunk_id"), "query_chunk_id", "left_anti")
    columns = ["query_chunk_id", "chunk_id", "distance", "similarity_score"]
    order = Window.partitionBy("query_chunk_id").orderBy("distance", "chunk_id")
    merged = held.select(*columns).unionByName(offers.select(*columns)).withColumn("rank", F.row_number().over(order))
    merged = merged.where(F.col("rank") <= k).select("query_chunk_id", "rank", "chunk_id", "distance", "similarity_score")
    return merged.unionByName(fresh)
