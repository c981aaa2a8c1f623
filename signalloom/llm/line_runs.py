"""Line de-duplication over levelled sorted runs of line hashes.

A run is a table of line keys bucketed and sorted by hash, with the documents that hold each
key.  Documents come in batches.  A batch merge-anti-joins the runs, which removes what they
have settled, and adds the rest as a run of its own; two runs of one level are merged into a
run of the next.  Only DataFrame functions are used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove_folder, stage_folder
from .blocks import shielded, with_text

_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Copies of a dropped key that a line may meet, so that a line of very many documents is
#: looked up by as many tasks.
SALTS = 16
_NO_ID = -(1 << 63)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and no other letter."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _SMALL))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def keyed_lines(docs: DataFrame, min_chars: int, *columns: str) -> DataFrame:
    """``columns``, ``pos`` and the 128-bit hash ``h1, h2`` of each line key that is long enough."""
    lines = docs.select(*columns, F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keys = lines.withColumn("line", F.btrim("line", F.lit(_BLANK))).where(F.length("line") >= min_chars)
    key = ascii_lower(F.col("line"))
    return keys.select(*columns, "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


class LineRuns:
    """Runs by level: ``(h1, h2, docs, last)``, the documents of a key and the largest of them.

    ``docs`` of a settled key (``enough`` or more) may leave out later documents.
    """

    def __init__(self, spark: SparkSession, enough: int, buckets: int | None = None):
        self.spark, self.enough = spark, enough
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = []

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex}", stage_folder(self.spark)
        (
            rows.repartition(self.buckets, "h1", "h2")
            .write.bucketBy(self.buckets, "h1", "h2")
            .sortBy("h1", "h2")
            .option("path", path)
            .saveAsTable(name)
        )
        return name, path

    def _drop(self, run: tuple[str, str]) -> None:
        self.spark.sql(f"DROP TABLE {run[0]}")
        remove_folder(self.spark, run[1])

    def add(self, batch: DataFrame) -> None:
        """``batch``: one row per key, of documents that no earlier batch held."""
        fresh = batch.alias("b")
        for run in [r for level in self.levels for r in level]:
            settled = self.spark.table(run[0]).where(F.col("docs") >= self.enough).hint("merge").alias("r")
            same = (F.col("b.h1") == F.col("r.h1")) & (F.col("b.h2") == F.col("r.h2"))
            fresh = fresh.join(settled, same & (F.col("b.last") <= F.col("r.last")), "left_anti")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(fresh.select("b.*")))
        self._compact(2)

    def _compact(self, most: int) -> None:
        """Merge the runs of each level that has ``most`` of them into one of the next level."""
        for n, level in enumerate(self.levels):
            if len(level) >= most:
                if n + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[n + 1].append(self._merge(level))
                level.clear()

    def _merge(self, runs: list[tuple[str, str]]) -> tuple[str, str]:
        """Runs are bucketed alike and meet without a shuffle; what they make is dealt to buckets again."""
        merged = self.spark.table(runs[0][0])
        for name, _ in runs[1:]:
            a, b = merged.alias("a"), self.spark.table(name).hint("merge").alias("b")
            same = (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2"))
            merged = a.join(b, same, "full_outer").select(
                F.coalesce("a.h1", "b.h1").alias("h1"),
                F.coalesce("a.h2", "b.h2").alias("h2"),
                (F.coalesce("a.docs", F.lit(0)) + F.coalesce("b.docs", F.lit(0))).alias("docs"),
                F.greatest("a.last", "b.last").alias("last"),
            )
        made = self._write(merged)
        for run in runs:
            self._drop(run)
        return made

    def settled(self) -> DataFrame:
        """All keys of ``enough`` documents, after a last compaction."""
        runs = [r for level in self.levels for r in level]
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long, docs long, last long")
        last = runs[0] if len(runs) == 1 else self._merge(runs)
        self.levels = [[last]]
        return self.spark.table(last[0]).where(F.col("docs") >= self.enough)


def _kept(lines: Column, drops: Column) -> Column:
    """The lines between the dropped places, joined; work in proportion to lines and drops."""

    def parts(whole: Column) -> Column:
        stops = F.concat(whole["drops"], F.array(F.size(whole["lines"])))
        begins = F.concat(F.array(F.lit(0)), F.transform(whole["drops"], lambda p: p + 1))
        between = F.transform(F.arrays_zip(begins.alias("a"), stops.alias("z")), lambda x: F.slice(whole["lines"], x["a"] + 1, x["z"] - x["a"]))
        return F.array_join(F.flatten(between), "\n")

    # bound once, so that the text is split once and not per dropped line
    return F.get(F.transform(F.array(F.struct(lines.alias("lines"), drops.alias("drops"))), parts), F.lit(0))


def dedup(
    docs: DataFrame,
    min_chars: int = 20,
    min_docs: int = 3,
    batches: int = 4,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """All columns of ``docs`` with ``__n_lines``, ``__n_dropped`` and ``__kept`` (the text left), for
    whose use names that begin with two underscores are reserved.

    A line's key is the line without blanks around it and with A-Z lower-cased.  Keys of at
    least ``min_chars`` code points in ``min_docs`` documents lose all their lines except in
    the document with the largest id.  Rows of one id are one document; a missing id is a
    document of its own that precedes all others.  A null or empty text is one empty line, and
    ``__kept`` is then empty.  No rows: no rows.
    """
    plain = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("doc"), F.col(text).alias("text"))
    runs = LineRuns(docs.sparkSession, min_docs)
    for n in range(batches):
        batch = keyed_lines(plain.where(F.pmod(F.xxhash64("doc"), F.lit(batches)) == n), min_chars, "doc")
        runs.add(batch.groupBy("h1", "h2").agg(F.count_distinct("doc").alias("docs"), F.max("doc").alias("last")))
    heavy = runs.settled().select("h1", "h2", "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # a row is known by its id and, should an id repeat, a hash of its text
    places = keyed_lines(plain.withColumn("t", F.hash("text")), min_chars, "doc", "t").withColumn("salt", F.pmod(F.hash("doc"), F.lit(SALTS)))
    drops = (
        places.join(heavy, ["h1", "h2", "salt"])
        .where("doc != last")
        .groupBy("doc", "t")
        .agg(F.sort_array(F.collect_set("pos")).alias("__drops"))
        .select(F.col("doc").alias("__doc"), F.col("t").alias("__t"), "__drops")
    )
    joined = docs.withColumns(
        {"__doc": F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)), "__t": F.hash(text)}
    ).join(drops, ["__doc", "__t"], "left")
    lines = lines_of(F.col(text))
    kept = F.when(F.col("__drops").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(_kept(lines, F.col("__drops")))
    return joined.withColumns(
        {
            "__n_lines": F.size(lines).cast("long"),
            "__n_dropped": F.coalesce(F.size("__drops"), F.lit(0)).cast("long"),
            "__kept": kept,
        }
    ).drop("__doc", "__t", "__drops")


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """The documents with their own columns and what is left of their texts; none is left out."""
    plain, own = shielded(docs, text, doc_id, "n_chars")
    marked = dedup(plain, text=text, doc_id=doc_id, **how)
    return own(with_text(marked, F.when(F.col("__n_dropped") > 0, F.col("__kept")).otherwise(F.col(text)), text))
