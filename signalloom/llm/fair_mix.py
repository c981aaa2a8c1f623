"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order, repeated up to ``repeats`` times.
A document's virtual finish time is the number of its source's words up to its end divided by
the source's target.  All queues are range-sorted by finish time and cut at the total budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

#: Ranges of virtual time per unit of it.
RANGES = 4096
#: Hex digits of the shuffle key that name a part of a source, so that no task gets a whole one.
PART_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, text: Column, seed: str) -> Column:
    """A pseudo-random place in the queue; only equal rows share it."""
    return F.md5(
        F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))).cast("binary")
    )


def targets(sizes: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """``(queue, source_size)`` with weight and target: shares of the total by weight, none above
    ``repeats`` times its size.

    In the order of ``limit / weight`` the sources at their limit come first, and all others
    get their weight times one rate.  One row per source meets in one task.
    """
    by_name = Window.orderBy("queue")
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("weight", F.get(wheel, (F.row_number().over(by_name) - 1) % len(weights)))
    limit = F.col("source_size") * F.lit(float(repeats))
    ranked = Window.orderBy(limit / F.col("weight"), "queue").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rates = weighed.select(
        "*",
        limit.alias("most"),
        (
            (F.sum("source_size").over(everything) - (F.sum(limit).over(ranked) - limit))
            / (F.sum("weight").over(everything) - (F.sum("weight").over(ranked) - F.col("weight")))
        ).alias("rate"),
    )
    fits = F.when(F.col("rate") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "queue", "rate"))
    rate = F.min(fits).over(everything)["rate"]
    return rates.select("queue", "source_size", "weight", F.least("most", rate * F.col("weight")).alias("target"))


def _packets() -> Column:
    """The copies of a document as queue entries; the one in service when its source's target is
    reached is two entries, split at that word."""
    quota = F.floor("target")

    def entry(a: Column, b: Column) -> Column:
        return F.struct(a.alias("first"), b.alias("last"), (b / F.col("target")).alias("finish"))

    copies = F.transform(
        F.sequence(F.lit(0), F.col("repeats") - 1),
        lambda e: F.struct(
            (e * F.col("source_size") + F.col("before")).alias("a"),
            (e * F.col("source_size") + F.col("before") + F.col("size")).alias("b"),
        ),
    )
    return F.flatten(
        F.transform(
            copies,
            lambda c: F.when(
                (c["a"] < quota) & (quota < c["b"]), F.array(entry(c["a"], quota), entry(quota, c["b"]))
            ).otherwise(F.array(entry(c["a"], c["b"]))),
        )
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    repeats: int = 3,
    seed: str = "mix",
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, source, place (shuffle key), size, source_size, target, taken.

    ``taken`` counts the words the mix takes of the document, repeats counted; the copy at the
    cut is taken in part.  Sources are weighed in code-point order, null last.  A document
    without words takes part with size 0 and nothing taken; equal rows share a place and are
    told apart by their turn.  Reruns agree.  An empty table gives no rows.
    """
    queue = F.when(F.col(source).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))
    sized = staged(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            queue.alias("queue"),
            shuffle_key(F.col(doc_id), F.col(text), seed).alias("place"),
            word_count(F.col(text)).alias("size"),
        ).withColumn("part", F.substring("place", 1, PART_DIGITS))
    )
    # one row per source and part carries what a document needs to know of its source
    parts = sized.groupBy("queue", "part").agg(F.sum("size").alias("part_size"))
    up_to = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    goals = targets(parts.groupBy("queue").agg(F.sum("part_size").alias("source_size")), weights, repeats)
    parts = parts.withColumn("ahead", F.sum("part_size").over(up_to) - F.col("part_size")).join(goals, "queue")
    inside = Window.partitionBy("queue", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queued = staged(
        sized.withColumn("within", F.sum("size").over(inside) - F.col("size"))
        .join(parts, ["queue", "part"])
        .select(
            "doc_id", "source", "queue", "place", "size", "source_size", "target",
            (F.col("ahead") + F.col("within")).alias("before"), F.lit(repeats).alias("repeats"),
        )
    )
    budget = queued.agg(F.sum("size")).first()[0] or 0
    cut = _cut(queued, budget)
    if cut is None:
        taken = F.lit(0).cast("long")
    else:
        here = F.lit(cut["finish"])

        def part_taken(p: Column) -> Column:
            whole = p["last"] - p["first"]
            level, last = p["finish"] == here, F.lit(cut["last"]).cast("long")
            own = level & (F.col("queue") == cut["queue"])
            earlier = (p["finish"] < here) | (level & (F.col("queue") < cut["queue"])) | (own & (p["last"] < last))
            words = F.when(earlier, whole).when(own & (p["last"] == last), F.lit(cut["words"])).otherwise(F.lit(0))
            return words.cast("long")

        taken = F.aggregate(F.transform(_packets(), part_taken), F.lit(0).cast("long"), lambda a, x: a + x)
        taken = F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(taken)
    return queued.select("doc_id", "source", "place", "size", "source_size", "target", taken.alias("taken"))


def _cut(queued: DataFrame, budget: int) -> dict | None:
    """The entry at which the range-sorted queues reach the budget, and the words taken of it.

    Entries are dealt to ranges of finish time, ranges are summed, and only the range in which
    the budget ends is sorted: about one in ``RANGES`` of all words, whatever the sources.
    """
    if not budget:
        return None
    entries = queued.where("size > 0 AND target > 0").select("queue", F.explode(_packets()).alias("p")).select("queue", "p.*")
    entries = entries.withColumn("range", F.floor(F.least(F.col("finish"), F.lit(2.0)) * RANGES))
    words = F.col("last") - F.col("first")
    ranges = entries.groupBy("range").agg(F.sum(words).alias("n")).orderBy("range").collect()  # at most 2 * RANGES + 1
    ahead = 0
    for r in ranges:
        if ahead + r["n"] >= budget:
            break
        ahead += r["n"]
    order = Window.orderBy("finish", "queue", "last").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    row = (
        entries.where(F.col("range") == r["range"])
        .withColumn("sum", F.sum(words).over(order) + ahead)
        .where(F.col("sum") >= budget)
        .orderBy("sum")
        .first()
    )
    return {"finish": row["finish"], "queue": row["queue"], "last": row["last"], "words": row["last"] - row["first"] - (row["sum"] - budget)}


def mixed(docs: DataFrame, taken: str = "taken_words", **how) -> DataFrame:
    """The documents of the mix: their own columns and ``taken``, the words taken (repeats counted).

    Documents of which nothing is taken are left out.  Equal rows take alike.  A column of the
    documents that is called like ``taken`` keeps its values, and the new one gets underscores.
    """
    while taken in docs.columns:
        taken = f"_{taken}"
    place = shuffle_key(F.col(how.get("doc_id", "doc_id")), F.col(how.get("text", "text")), how.get("seed", "mix"))
    chosen = mix(docs, **how).where("taken > 0").groupBy(F.col("place").alias("__place")).agg(F.max("taken").alias(taken))
    key = "__place"
    while key in docs.columns:
        key = f"_{key}"
    return docs.withColumn(key, place).join(chosen.withColumnRenamed("__place", key), key).drop(key)
