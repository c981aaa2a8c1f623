"""Language identification by compression against per-language dictionaries.

Every language gets a zstandard raw-content dictionary of at most ``dictionary_bytes`` of
normalised text.  A text is cut into windows, each window is compressed whole against every
dictionary, and the language with the smallest sum wins.  A narrow margin rejects the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import shielded

_OTHER = re.compile(r"[\W\d_]+")
_OTHER_SQL = r"[^\p{L}\p{Nl}\p{No}]+"
UNKNOWN = "und"


def normalised(text: str | None) -> str:
    """Lower-case letters, with one space for whatever stands between words."""
    plain = _OTHER.sub(" ", (text or "").lower()).strip()
    if not plain or plain.replace(" ", "").isalpha():
        return plain
    # numerals such as fractions count as word characters, yet are no letters
    return " ".join("".join(c if c.isalpha() else " " for c in plain).split())


def _piece(chars: Column) -> Column:
    """So many characters from a hash-chosen place of a text."""
    at = F.pmod(F.xxhash64(F.lit(1), F.col("text")), F.greatest(F.length("text") - chars, F.lit(1))).cast("int")
    return F.substring("text", at + 1, chars)


def learn(
    labelled: DataFrame,
    dictionary_bytes: int = 96 << 10,
    sample_chars: int = 600,
    max_languages: int = 500,
    text: str = "text",
    lang: str = "lang",
) -> dict[str, bytes]:
    """One dictionary per language, the most frequent first, from the rows with a text and a language.

    The fit reads a documented bounded sample: the distinct texts of each language with the
    smallest hashes, a piece of ``sample_chars`` from a hash-chosen place of each, until
    ``dictionary_bytes`` are filled.  Where all pieces of a language do not fill them, its texts
    give longer pieces.  What reaches the driver is bounded by the number of languages (an error
    beyond ``max_languages``) times about that size.  No labelled rows: no dictionaries.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where(
        "text IS NOT NULL AND lang IS NOT NULL AND text != ''"
    )
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return {}
    hashed = rows.withColumn("spread", F.xxhash64("text").bitwiseAND(F.lit((1 << 63) - 1)))
    first = _piece(F.lit(sample_chars))
    # copies of one text teach once; sums over eighths of each doubling of the hash say how far to read
    sums = (
        hashed.groupBy("lang", "spread")
        .agg(F.max(F.octet_length(F.regexp_replace(F.lower(first), _OTHER_SQL, " "))).alias("size"))
        .groupBy("lang", F.floor(F.log2(F.col("spread") + 1.0) * 8).cast("int").alias("step"))
        .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("texts"))
        .collect()
    )
    limits: dict[str, tuple[int, int]] = {}
    for name in counts:
        steps = sorted((r["step"], r["size"], r["texts"]) for r in sums if r["lang"] == name)
        total, upto, texts = 0, 0, sum(s[2] for s in steps)
        for upto, size, _ in steps:
            total += size
            if total >= dictionary_bytes:
                break
        # a text too short for a longer piece leaves room that is not given to the others
        chars = sample_chars if total >= dictionary_bytes else max(sample_chars, dictionary_bytes // texts)
        limits[name] = (upto, chars)
    known = sorted(limits.items())
    upto = F.create_map([F.lit(x) for k, v in known for x in (k, v[0])])[F.col("lang")]
    chars = F.create_map([F.lit(x) for k, v in known for x in (k, v[1])])[F.col("lang")]
    pieces = (
        hashed.where(F.floor(F.log2(F.col("spread") + 1.0) * 8) <= upto)
        .select("lang", "spread", _piece(chars).alias("piece"))
        .distinct()
    )
    filled: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for row in sorted(pieces.collect(), key=lambda r: (r["lang"], r["spread"], r["piece"])):
        piece = (" " + normalised(row["piece"])).encode()
        if size.get(row["lang"], 0) < dictionary_bytes and len(piece) > 1:
            filled.setdefault(row["lang"], []).append(piece)
            size[row["lang"]] = size.get(row["lang"], 0) + len(piece)
    common_first = sorted(filled, key=lambda k: (-counts[k], k))
    return {k: b"".join(filled[k])[-dictionary_bytes:] for k in common_first}


def windows(plain: str, window_bytes: int) -> Iterator[bytes]:
    """The whole text in pieces of ``window_bytes``, the last one shorter.

    What a piece repeats is copied from the piece itself and says nothing about the
    dictionaries; short pieces keep these in view of every part of a text, however it repeats.
    """
    data = plain.encode()
    for at in range(0, len(data), window_bytes):
        yield data[at : at + window_bytes]


class Compressors:
    """The learned dictionaries, ready in a worker."""

    def __init__(self, dictionaries: dict[str, bytes], window_bytes: int, temperature: float, level: int = 3):
        self.names = list(dictionaries)
        self.window, self.temperature, self.tools = window_bytes, temperature, []
        for name in self.names:
            content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            settings = zstandard.ZstdCompressionParameters.from_level(
                level,
                min_match=3,
                write_content_size=False,
                write_checksum=False,
                write_dict_id=False,
                format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            )
            self.tools.append(zstandard.ZstdCompressor(dict_data=content, compression_params=settings))

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """Language, confidence in it (0 to 1), and by what part the next language is longer."""
        plain = normalised(text)
        if not self.names or not plain:
            return UNKNOWN, 0.0, 0.0
        sizes = [0] * len(self.tools)
        for piece in windows(plain, self.window):
            for i, tool in enumerate(self.tools):
                sizes[i] += len(tool.compress(piece))
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        odds = np.exp2(-(np.array(sizes, float) - sizes[best]) / self.temperature)
        second = min((s for i, s in enumerate(sizes) if i != best), default=len(plain) + 1)
        return self.names[best], float(1 / odds.sum()), (second - sizes[best]) / max(1, second)


def predict(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    min_margin: float = 0.005,
    window_bytes: int = 512,
    temperature: float = 4.0,
    text: str = "text",
) -> DataFrame:
    """All columns of ``docs`` and ``__verdict`` (struct: lang, score, margin, rejected), in place of
    a column of that name.

    ``lang`` is a learned language, or ``und`` where the text is null, empty or without a
    letter; ``score`` rises with the bytes that the next languages need more; ``rejected``
    marks ``und`` and margins under ``min_margin`` of the size.  Texts of any length are read
    whole, window by window.  Only the text goes to Python; equal sizes go to the language that
    comes first in ``dictionaries``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # bounded by learn()

    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tools = Compressors(shared.value, window_bytes, temperature)
        for batch in batches:
            found = [tools.judge(t.as_py()) for t in batch]
            yield pa.StructArray.from_arrays(
                [
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                    pa.array([f[2] for f in found], pa.float64()),
                    pa.array([f[0] == UNKNOWN or f[2] < min_margin for f in found], pa.bool_()),
                ],
                names=["lang", "score", "margin", "rejected"],
            )

    verdict = F.arrow_udf(judged, "lang string, score double, margin double, rejected boolean", F.ArrowUDFType.SCALAR_ITER)
    return docs.withColumn("__verdict", verdict(F.col(text)))


def drop_rejected(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", **how) -> DataFrame:
    """The documents, with their own columns, whose language is clear."""
    plain, own = shielded(docs, text)
    return own(predict(plain, dictionaries, text=text, **how).where("NOT __verdict.rejected"))
