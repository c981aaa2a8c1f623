"""Chunk vectors: text for embedding, the vector table, and search."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schemas import CHUNK_SETS
from .ordering import latest_per_key


def semantic_text(chunks: DataFrame) -> Column:
    """Labelled sections of a chunk as one text for embedding."""

    def listed(name: str) -> Column:
        return F.coalesce(F.array_join(name, ", "), F.lit(""))

    # Section titles and contents, in order.
    sections = [
        ("Testcase", tx.shown(F.col("testcase_id"))),
        ("Countries", listed("countries")),
        ("Operators", listed("operators")),
        ("Network Domains", listed("network_domains")),
        ("Event Families", listed("event_families")),
        ("Event Names", listed("event_names")),
        ("Causes", listed("causes")),
        ("Tags", listed("tags")),
        ("Failure", tx.shown_flag(F.col("has_failure"))),
        ("Retry Recommended", tx.shown_flag(F.col("has_retry_recommended"))),
        ("Operational Evidence", F.coalesce("text", F.lit(""))),
    ]
    pieces = [F.lit("Telecom roaming operational trace.")]
    for title, body in sections:
        pieces.append(F.concat(F.lit(f"\n\n    {title}:\n    "), body))
    return tx.strip(F.concat(*pieces))


def signal_query(signals: Column) -> Column:
    """Search text for a list of signals; null for an empty list."""
    return F.when(
        F.size(signals) > 0,
        F.concat(F.lit("Telecom roaming trace failure involving: "), F.array_join(signals, ", ")),
    )


def embedding_input(text: Column, limit: int | None = None) -> Column:
    """Text for an embedding model, cut only for models that take ``limit`` characters."""
    whole = F.coalesce(text, F.lit(""))
    return whole if limit is None else F.substring(whole, 1, limit)


def split_empty(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows with text to embed, and the rejected rest."""
    usable = F.coalesce(tx.strip(F.col(text)), F.lit("")) != ""
    return df.filter(usable), df.filter(~usable)


@dataclass(frozen=True)
class TextModel:
    """Hashed TF-IDF: a word's slot comes from its MD5, a slot's weight from the texts that hold it."""

    text: str
    rarity: list[float]


def _slots(text: str, dimensions: int) -> Column:
    """The slot of each word of a text; words are runs of letters, digits and underscores."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.transform(words, lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long") % dimensions).cast("int"))


def fit_text_vectors(df: DataFrame, text: str = "text", dimensions: int = 256) -> TextModel:
    """A hashed TF-IDF text model of unit vectors.  ``df`` is the corpus its weights come from.

    One aggregate over whole texts; the model holds one number per dimension.
    """
    held = df.select(F.explode(F.array_distinct(_slots(text, dimensions))).alias("slot")).groupBy("slot").count()
    known = {r["slot"]: r["count"] for r in held.collect()}
    total = df.count()
    return TextModel(text, [math.log((1.0 + total) / (1.0 + known[i])) if i in known else 0.0 for i in range(dimensions)])


def embed(model: TextModel, df: DataFrame, output: str = "embedding") -> DataFrame:
    """Apply a fitted text model; the vector is an array of doubles, zero for a text without known words.

    A store that keeps floats casts when it writes.
    """
    rarity = np.array(model.rarity)

    @F.pandas_udf("array<double>")
    def weigh(slots: pd.Series) -> pd.Series:
        out = []
        for own in slots:
            row = np.bincount(own, minlength=len(rarity)) * rarity if len(own) else np.zeros(len(rarity))
            length = np.sqrt((row**2).sum())
            out.append(row / length if length else row)
        return pd.Series(out, index=slots.index)

    return df.withColumn(output, weigh(_slots(model.text, len(rarity))))


def flat_metadata(chunks: DataFrame) -> DataFrame:
    """Scalar metadata per chunk: value sets joined by commas, missing flags false."""
    flags = ["has_failure", "has_high_severity", "has_retry_recommended"]
    return chunks.select(
        "chunk_id",
        "trace_id",
        "testcase_id",
        "chunk_index",
        "event_count",
        *[F.coalesce(F.array_join(name, ","), F.lit("")).alias(name) for name in CHUNK_SETS],
        *[F.coalesce(name, F.lit(False)).alias(name) for name in flags],
        "source_trace",
        "source_result",
        "source_report",
    )


def attach_embeddings(chunks: DataFrame, embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks with their vectors, and the chunk ids that have none."""
    vectors = embeddings.select("chunk_id", "embedding")
    return chunks.join(vectors, "chunk_id"), chunks.join(vectors, "chunk_id", "left_anti").select("chunk_id")


def upsert(stored: DataFrame, batch: DataFrame, order: str = "batch_id") -> DataFrame:
    """Vector table after a batch: per chunk the row of the latest batch.

    Of several rows of a chunk in one batch the one with the greatest content wins.  Stored
    rows that the batch does not touch are neither sorted nor compared.
    """
    touched = batch.select("chunk_id").distinct()
    latest = latest_per_key(stored.join(touched, "chunk_id", "left_semi").unionByName(batch), "chunk_id", order)
    return stored.join(touched, "chunk_id", "left_anti").unionByName(latest)


def similarity(distance: Column) -> Column:
    """``1 / (1 + distance)`` to four places; null stays null."""
    return F.round(F.lit(1.0) / (F.lit(1.0) + distance), 4)


def distance_to(query: list[float], metric: str = "sq_l2"):
    """Arrow-batched distance of a vector column to one query vector."""
    target = np.asarray(query, dtype=np.float64)

    @F.pandas_udf("double")
    def measure(vectors: pd.Series) -> pd.Series:
        if len(vectors) == 0:
            return pd.Series([], dtype="float64")
        rows = np.stack(vectors.to_numpy()).astype(np.float64)
        if metric == "cosine":
            norms = np.linalg.norm(rows, axis=1) * np.linalg.norm(target)
            # a zero vector has no direction: distance 1
            return pd.Series(1.0 - np.divide(rows @ target, norms, out=np.zeros(len(rows)), where=norms > 0))
        squares = ((rows - target) ** 2).sum(axis=1)
        return pd.Series(np.sqrt(squares) if metric == "l2" else squares)

    return measure


def search(
    vectors: DataFrame,
    query: list[float],
    k: int = 5,
    metric: str = "sq_l2",
    where: Column | None = None,
) -> DataFrame:
    """The ``k`` nearest chunks to one query vector, ranked; ties by chunk id.

    ``where`` is applied before distances are measured.  ``orderBy`` + ``limit`` keeps
    ``k`` rows per task, so the final ranking sees a bounded set.
    """
    found = vectors if where is None else vectors.filter(where)
    nearest = (
        found.withColumn("distance", distance_to(query, metric)("embedding"))
        .orderBy("distance", "chunk_id")
        .limit(k)
    )
    rank = F.row_number().over(Window.orderBy("distance", "chunk_id"))
    return nearest.select(
        rank.alias("rank"),
        "chunk_id",
        "distance",
        similarity(F.col("distance")).alias("similarity_score"),
        *[c for c in found.columns if c not in ("chunk_id", "embedding")],
    )
