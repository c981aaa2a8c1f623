"""Documents dealt to blocks of bounded size, and columns that operators share."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one task handles at a time.
BLOCK_BYTES = 8 << 20


def remainder(column: str, modulus: int) -> Column:
    """crc32 of a column as text, modulo; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts; one aggregate over one column."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def block_count(total_bytes: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(1, math.ceil(total_bytes / block_bytes))


def block_of(doc_id: str, text: str, blocks: int) -> Column:
    """The block of a document: by id, and by text where there is no id.

    Copies of a text differ in id, so that no group of copies meets in one block.
    """
    own = F.coalesce(F.xxhash64(F.when(F.col(doc_id).isNotNull(), F.col(doc_id))), F.lit(0))
    return F.pmod(F.when(F.col(doc_id).isNull(), F.xxhash64(text)).otherwise(own), F.lit(blocks)).cast("int")


def shielded(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but ``used`` under names that no operator uses, and a function that
    gives the columns of ``docs`` back to a result made of it."""
    away = {c: f"_own_{n}_" for n, c in enumerate(docs.columns) if c not in used}

    def own(made: DataFrame) -> DataFrame:
        return made.select(*[F.col(away.get(c, f"`{c}`")).alias(c) for c in docs.columns])

    return docs.select(*[F.col(f"`{c}`").alias(away.get(c, c)) for c in docs.columns]), own


def with_text(docs: DataFrame, text: Column, column: str = "text") -> DataFrame:
    """Documents with another text; where it differs, a whole-number ``n_chars`` follows it."""
    out = docs.withColumn("__text", text)
    for field in docs.schema.fields:
        if field.name == "n_chars" and isinstance(field.dataType, T.IntegralType):
            same = F.col("__text").eqNullSafe(F.col(column))
            out = out.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("__text").cast(field.dataType)))
    return out.withColumn(column, F.col("__text")).drop("__text")
