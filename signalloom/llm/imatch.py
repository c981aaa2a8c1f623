"""I-Match document fingerprints over randomised lexicons.

Terms inside a band of inverse document frequency form the lexicon.  Randomised subsets of it
are nested: at each level a subset is one of ``SLOTS`` parts, and each level keeps half of the
terms of the one before.  A document takes the two levels that leave about one of its terms per
subset, and its fingerprint is a hash of its sorted distinct terms in each subset.  An edit
changes the subsets that hold an edited term and leaves the others.  Copies and near copies of
one text that make up more of the table than the band allows push each other's terms out of it;
a document with few terms in the band is compared by the same subsets of all its terms.  Only
DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .line_runs import ascii_lower

SLOTS = 16
#: Distinct terms of a document per level-0 subset; about two in five are in the band.
_TERMS_PER_SLOT = 2.5
#: Less than one term in so many in the band, half of what is usual, is too few to compare by.
_FEW = 5
_NO_ID = -(1 << 63)


def term_hashes(text: Column) -> Column:
    """Hashes of the distinct alphanumeric terms, A-Z lower-cased; non-ASCII characters belong to terms."""
    words = F.filter(F.split(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, rarest: float, commonest: float, max_terms: int, text: str = "text") -> list[int]:
    """Term hashes in ``rarest`` to ``commonest`` of all documents, and in two at least.

    A document counts its terms once, so at most (distinct terms per document) / ``rarest``
    terms are in the band, whatever the number of documents.  More than ``max_terms`` is an error.
    """
    hashes = docs.select(term_hashes(F.coalesce(F.col(text), F.lit(""))).alias("terms"))
    total = docs.count()
    found = (
        hashes.select(F.explode("terms").alias("term"))
        .groupBy("term")
        .count()
        .where((F.col("count") >= max(2.0, rarest * total)) & (F.col("count") <= max(2.0, commonest * total)))
        .select("term")
        .limit(max_terms + 1)
        .collect()
    )
    if len(found) > max_terms:
        raise ValueError(f"more than {max_terms} terms in the band; raise `rarest`")
    return sorted(r["term"] for r in found)


def fingerprints(terms: list[int], *texts: str) -> Column:
    """An array with a struct ``level, low, high, whole, few, all_low, all_high`` per text column:
    its level, the subset hashes there and one level up (0: no term), a hash of the text where
    no term is in the lexicon, whether too few are, and the subset hashes over all terms.  All
    texts share one copy of the lexicon in the plan."""
    listed = ", ".join(f"{t}L" if t != _NO_ID else "(-9223372036854775807L - 1L)" for t in terms) or "NULL"

    def build(own: Column) -> Column:
        terms = own["terms"]
        level = F.greatest(F.floor(F.log2(F.size(terms) / F.lit(SLOTS * _TERMS_PER_SLOT))), F.lit(0)).cast("int")
        return F.struct(level.alias("level"), terms.alias("terms"), own["text"].alias("text"))

    # array(struct) with transform binds a value once, where a lambda would repeat its expression
    hashed_texts = F.transform(F.array(*[F.col(t) for t in texts]), lambda t: F.struct(term_hashes(t).alias("terms"), F.xxhash64(t).alias("text")))
    sized = F.transform(hashed_texts, build)
    chosen = F.transform(
        sized,
        lambda s: F.struct(
            s["level"].alias("level"),
            s["text"].alias("text"),
            F.sort_array(
                F.filter(s["terms"], lambda x: x.bitwiseAND(_low_bits(s["level"]) * SLOTS) == 0)
            ).alias("terms"),
        ),
    )
    in_band = F.transform(
        chosen,
        lambda s: F.struct(s["level"].alias("level"), s["text"].alias("text"), _in_list(s["terms"], listed).alias("terms"), s["terms"].alias("all")),
    )

    def hashed(s: Column, up: int, which: str = "terms") -> Column:
        wanted = _low_bits(s["level"] + up) * SLOTS + (SLOTS - 1)

        def subset(slot: Column) -> Column:
            own = F.filter(s[which], lambda x: x.bitwiseAND(wanted) == slot)
            digest = F.xxhash64(own).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
            return F.when(F.size(own) == 0, F.lit(0)).otherwise(F.greatest(digest, F.lit(1)))

        return F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), subset)

    return F.transform(
        in_band,
        lambda s: F.struct(
            s["level"].alias("level"),
            hashed(s, 0).alias("low"),
            hashed(s, 1).alias("high"),
            F.when(F.size(s["terms"]) == 0, s["text"]).otherwise(F.lit(0)).alias("whole"),
            (F.size(s["terms"]) * _FEW < F.size(s["all"])).alias("few"),
            _short(hashed(s, 0, "all")).alias("all_low"),
            _short(hashed(s, 1, "all")).alias("all_high"),
        ),
    )


def _low_bits(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1


def _short(hashes: Column) -> Column:
    """15 bits of each hash, enough to compare two subsets; most documents carry these unused."""
    return F.transform(hashes, lambda h: F.when(h == 0, 0).otherwise(h % 32767 + 1).cast("short"))


def _in_list(terms: Column, listed: str) -> Column:
    """The terms of the lexicon, which the plan holds as a literal hash set of bounded size."""
    return F.call_function("filter", terms, F.expr(f"__x -> __x IN ({listed})"))


def shown(print_: Column) -> Column:
    """The fingerprint as a string: its level and the hashes of both levels, after ``all/`` where
    they are those of all terms, or the hash of a text without a term."""

    def level(hashes: Column) -> Column:
        return F.array_join(F.transform(hashes, lambda h: F.when(h == 0, "-").otherwise(F.lower(F.hex(h)))), ".")

    def subsets(low: str, high: str) -> Column:
        return F.concat_ws("/", print_["level"].cast("string"), level(print_[low]), level(print_[high]))

    return (
        F.when(print_["few"], F.concat(F.lit("all/"), subsets("all_low", "all_high")))
        .when(print_["whole"] != 0, F.concat(F.lit("text/"), F.lower(F.hex(print_["whole"]))))
        .otherwise(subsets("low", "high"))
    )


def likeness(a: Column, b: Column) -> Column:
    """The share of equal hashes among the subsets in which either document has a term, at the
    better of the levels that both fingerprints have; 1 for equal fingerprints.  Where either
    has too few terms in the band, the subsets of all terms are compared."""

    def share(x: Column, y: Column) -> Column:
        pairs = F.zip_with(x, y, lambda p, q: F.when((p == 0) & (q == 0), None).otherwise((p == q).cast("double")))
        used = F.filter(pairs, lambda s: s.isNotNull())
        return F.when(F.size(used) > 0, F.aggregate(used, F.lit(0.0), lambda t, s: t + s) / F.size(used)).otherwise(0.0)

    few = a["few"] | b["few"]

    def pair(x: str, y: str) -> Column:
        def side(c: Column, name: str) -> Column:
            return F.when(few, c[f"all_{name}"]).otherwise(c[name])

        return share(side(a, x), side(b, y))

    up = a["level"] - b["level"]
    best = (
        F.when(up == 0, F.greatest(pair("low", "low"), pair("high", "high")))
        .when(up == 1, pair("low", "high"))
        .when(up == -1, pair("high", "low"))
        .otherwise(0.0)
    )
    same_text = (a["whole"] != 0) & (a["whole"] == b["whole"])
    return F.when(same_text, 1.0).otherwise(best)


def _neighbours(keys: DataFrame) -> DataFrame:
    """Distinct ``(id, t, n)`` in order of id and hash, each with the one before: ``prev_id, prev_t,
    prev_n``; before the first comes the last.  Ranges of ids are ordered on their own, and
    only their ends meet."""
    ranged = keys.repartitionByRange("id", "t").withColumn("part", F.spark_partition_id())
    order = Window.partitionBy("part").orderBy("id", "t")
    own = F.struct(F.col("id").alias("prev_id"), F.col("t").alias("prev_t"), F.col("n").alias("prev_n"))
    rows = staged(ranged.withColumn("own", own).withColumn("prev", F.lag("own").over(order)))
    ends = rows.groupBy("part").agg(F.max("own").alias("last"))
    along = Window.orderBy("part")
    every = Window.partitionBy()
    before = ends.select("part", F.coalesce(F.lag("last").over(along), F.max("last").over(every)).alias("end"))
    return rows.join(before, "part").select("id", "t", F.coalesce("prev", "end").alias("prev")).select("id", "t", "prev.*")


def compare_edits(
    docs: DataFrame,
    rarest: float = 0.001,
    commonest: float = 0.02,
    max_terms: int = 400_000,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, n_chars, edited_sha256, print, edited_print, near_edited, near_next per document.

    The edited text has its last quarter (rounded down) replaced by as much from the start of
    the next document by id, or all of it; after the last comes the first.  A null text is
    empty, a missing id comes first, rows of one id are ordered by a hash of their text, and
    equal rows count once in the order but are all returned.  No rows: no rows.
    """
    terms = lexicon(docs, rarest, commonest, max_terms, text)
    # id, text and hash alone are shuffled, once, and every join below reuses that exchange
    base = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("t", F.xxhash64("text"))
    order = staged(_neighbours(base.select("id", "t", F.length("text").alias("n")).distinct()))
    # a document gives its beginning to the one before it, no longer than that one needs
    placed = base.join(order, ["id", "t"])
    given = (
        placed.select(F.col("prev_id").alias("id"), F.col("prev_t").alias("t"), F.substring("text", F.lit(1), F.floor(F.col("prev_n") / 4).cast("int")).alias("piece"))
        .groupBy("id", "t")
        .agg(F.max("piece").alias("piece"))
    )
    n = F.length("text")
    edited = base.join(given, ["id", "t"]).select(
        "id", "t", F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"), "text", n.alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), (n - F.floor(n / 4)).cast("int")), "piece").alias("edited"),
    )
    made = staged(
        edited.select(
            "id", "t", "doc_id", F.col("n_chars").cast("long").alias("n_chars"),
            F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            fingerprints(terms, "text", "edited").alias("prints"),
        ).select("id", "t", "doc_id", "n_chars", "edited_sha256", F.col("prints")[0].alias("print"), F.col("prints")[1].alias("edited_print"))
    )
    following = (
        made.select("id", "t", "print")
        .join(order, ["id", "t"])
        .groupBy(F.col("prev_id").alias("id"), F.col("prev_t").alias("t"))
        .agg(F.first("print").alias("next_print"))
    )
    return made.join(following, ["id", "t"]).select(
        "doc_id", "n_chars", "edited_sha256", "print", "edited_print",
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
