"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of n-grams of every order are mixed with weights that depend on
how often the contexts occur.  The weights are learned by expectation-maximisation on the
deleted part of the training documents, with the counts of the other part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage_folder
from .blocks import block_count, block_of, text_bytes
from .counting import ASKED, Asking, told, totals
from .packed import LOWER, SPACE, combine, counted, give_back, span_digests, utf8, words

_END, _START = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
#: Bits of a key by order: 62 for words, whose differences in a block then take six bytes; longer
#: n-grams have 46 (four bytes), where a chance match is one in millions and touches one term
#: of one mixture.
_WORD_BITS, _GRAM_BITS = 62, 46
#: Context frequencies are told apart by powers of two, estimates in the weights' fit by a
#: quarter of a power of two.
_CLASSES, _STEPS, _NEVER = 16, 4, -32768
#: Tokens whose estimates are in memory at a time.
_AT_ONCE = 1 << 18


class Grams:
    """The tokens of a block and, per order, the digest of the n-gram that ends at each."""

    def __init__(self, texts, order: int):
        buf, offsets = utf8(texts)
        buf = LOWER[buf]
        starts, ends, text = words(buf, offsets, SPACE)
        digests = span_digests(buf, starts, ends)
        self.n_tokens = np.bincount(text, minlength=len(offsets) - 1) + 1
        self.ends = np.cumsum(self.n_tokens) - 1
        self.firsts = self.ends - self.n_tokens + 1
        tokens = np.full(len(digests) + len(self.ends), _END, np.uint64)
        tokens[np.arange(len(digests)) + text] = digests
        tokens >>= np.uint64(64 - _WORD_BITS)
        self.keys = [tokens]
        chain = _START
        for _ in range(1, order):
            before = self.shifted(self.keys[-1], chain)
            self.keys.append(combine(before, tokens) >> np.uint64(64 - _GRAM_BITS))
            chain = combine(np.array([chain], np.uint64), np.array([_START], np.uint64))[0]

    def shifted(self, values: np.ndarray, first) -> np.ndarray:
        """Each token's predecessor's value; ``first`` where a text begins."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.firsts] = first
        return out


def _bits(order: int) -> int:
    return _WORD_BITS if order == 1 else _GRAM_BITS


def counts(
    docs: DataFrame, train: Column, deleted: Column, order: int = 2, block_bytes: int = 6 << 20, doc_id: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, dict[str, int]]:
    """Per document its tokens' counts, and the totals of the corpus.

    The table has doc_id, held_out, n_tokens, n_known, log_sum, ``c<k>`` (of each token, how
    often the n-gram of order k that ends there occurs in training documents) and, for deleted
    training documents, ``k<k>`` (the same without deleted documents).  It is written once.
    """
    spark = docs.sparkSession
    blocks = block_count(text_bytes(docs, text), block_bytes)
    buckets = blocks  # about as many keys to a range as to a block
    source = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(text).alias("text"),
        train.alias("train"),
        (train & deleted).alias("deleted"),
        block_of(doc_id, text, blocks).alias("block"),
    )

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        give_back()
        grams, out = Grams(table.column("text"), order), Asking()
        train = np.repeat(table.column("train").to_numpy(), grams.n_tokens)
        deleted = np.repeat(table.column("deleted").to_numpy(), grams.n_tokens)
        for k, keys in enumerate(grams.keys, 1):
            distinct, in_train, in_deleted = counted(keys, train, deleted)
            out.add(key[0].as_py(), k, distinct, in_train, in_deleted, buckets, _bits(k))
        return out.table()

    def vocabulary(kind: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.array([np.count_nonzero(a)]), np.array([np.count_nonzero(a - b)])

    def tally(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        give_back()
        block = key[0].as_py()
        n = table.num_rows
        grams = Grams(table.column("text"), order)
        cut = pa.array(np.concatenate([grams.firsts, [grams.ends[-1] + 1 if n else 0]]).astype(np.int32))
        deleted = table.column("deleted").to_numpy() if n else np.zeros(0, bool)
        columns = {
            "doc_id": table.column("doc_id").combine_chunks(),
            "held_out": pa.array(~table.column("train").to_numpy() if n else [], pa.bool_()),
            "n_tokens": pa.array(grams.n_tokens if n else [], pa.int64()),
        }
        every, kept = {}, {}
        token_deleted = np.repeat(deleted, grams.n_tokens) if n else np.zeros(0, bool)
        kept_cut = pa.array(np.concatenate([[0], np.cumsum(np.where(deleted, grams.n_tokens, 0))]).astype(np.int32) if n else [0], pa.int32())
        for k, keys in enumerate(grams.keys, 1):
            a, b = told(answers, k)
            where = np.unique(keys, return_inverse=True)[1]
            every[k] = a[where]
            kept[k] = (a - b)[where[token_deleted]]
        known = np.add.reduceat((every[1] > 0).astype(np.int64), grams.firsts) if n else []
        logs = np.add.reduceat(np.log10(every[1] + 0.5), grams.firsts) if n else []
        columns |= {"n_known": pa.array(known, pa.int64()), "log_sum": pa.array(logs, pa.float64())}
        for name, cuts, values in (("c", cut, every), ("k", kept_cut, kept)):
            for k in range(1, order + 1):
                columns[f"{name}{k}"] = pa.ListArray.from_arrays(cuts, pa.array(values[k], pa.int64()))
        sizes = [(None, None)] if block >= 0 else [tuple(int(x) for x in (v[0].sum(), v[1].sum())) for v in [told(answers, 1)]]
        rows = pa.table(columns)
        if block >= 0:
            return rows.append_column("words", pa.nulls(n, pa.int64())).append_column("kept_words", pa.nulls(n, pa.int64()))
        empty = {c.name: pa.nulls(1, c.type) for c in rows.schema}
        return pa.table(empty | {"words": pa.array([sizes[0][0]], pa.int64()), "kept_words": pa.array([sizes[0][1]], pa.int64())})

    asked = source.groupBy("block").applyInArrow(ask, ASKED)
    answers = totals(asked, extra=vocabulary, own_b=True)
    id_type = source.schema["doc_id"].dataType.simpleString()
    lists = "".join(f", {n}{k} array<bigint>" for n in "ck" for k in range(1, order + 1))
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, log_sum double{lists}, words long, kept_words long"
    joined = source.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tally, schema)
    path = stage_folder(spark)
    joined.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(joined.schema).parquet(path)
    corpus = table.agg(
        F.sum("words").alias("V"),
        F.sum("kept_words").alias("kept_V"),
        F.sum(F.when(~F.col("held_out"), F.col("n_tokens"))).alias("N"),
        F.sum(F.when(F.size("k1") > 0, F.col("n_tokens"))).alias("deleted_N"),
    ).first()
    numbers = {k: int(corpus[k] or 0) for k in ("V", "kept_V", "N", "deleted_N")}
    return table.where("n_tokens IS NOT NULL").drop("words", "kept_words"), numbers


def _parts(lists: list[pa.Array]) -> Iterator[list[pa.Array]]:
    """The rows of a batch in parts of some ``_AT_ONCE`` tokens, or one row."""
    ends = lists[0].offsets.to_numpy().astype(np.int64)
    at = 0
    while at + 1 < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + _AT_ONCE, "right")) - 1)
        yield [x.slice(at, upto - at) for x in lists]
        at = upto


def _estimates(lists: list[pa.Array], n: int, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token the estimates from order 0 (uniform) up, its context class, and where texts begin."""
    offsets = lists[0].offsets.to_numpy().astype(np.int64)
    firsts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0] - 1
    lone = ends >= firsts  # a list may be empty in the fit
    firsts, ends = firsts[lone], ends[lone]
    values = [x.flatten().to_numpy().astype(np.float64) for x in lists]
    size = len(values[0])
    out = [np.full(size, 1.0 / (v + 1)), values[0] / max(n, 1)]
    context_class = np.zeros(size, np.int64)
    for k in range(1, len(values)):
        context = np.empty(size)
        context[1:] = values[k - 1][:-1]
        context[firsts] = values[0][ends]  # every training text has one end and one beginning
        out.append(np.divide(values[k], context, out=np.zeros(size), where=context > 0))
        # the power of two, 0 for a context that training lacks
        power = np.minimum(np.frexp(context)[1], _CLASSES - 1) * (context > 0)
        context_class = context_class * _CLASSES + power.astype(np.int64)
    return np.array(out), context_class, firsts


def weights(table: DataFrame, numbers: dict[str, int], order: int, rounds: int = 60) -> np.ndarray:
    """Mixture weights by context class (rows) and order from 0 (columns).

    All tokens of deleted documents count, gathered as a histogram of context class and
    rounded estimates; its cells are bounded by the grid, not by the corpus.  Cells of one
    class share weights, and expectation-maximisation raises their likelihood.  A class without
    deleted tokens takes the weights of all classes together.
    """
    n, v = numbers["N"] - numbers["deleted_N"], numbers["kept_V"]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in _parts([batch.column(k) for k in range(order)])):
            estimates, context_class, _ = _estimates(part, n, v)
            with np.errstate(divide="ignore"):
                steps = np.where(estimates[1:] > 0, np.round(np.log2(estimates[1:]) * _STEPS), _NEVER).astype(np.int64)
            code = context_class
            for row in steps:
                code = (code << 16) | (row + 32768)
            found, times = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(times)], names=["cell", "n"])

    kept = table.where("size(k1) > 0").select(*[f"k{k}" for k in range(1, order + 1)])
    rows = kept.mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    code, times = rows["cell"].to_numpy(np.int64), rows["n"].to_numpy(np.float64)
    classes = _CLASSES ** (order - 1)
    estimates = [np.full(len(code), 1.0 / (v + 1))]
    for k in range(order):
        step = ((code >> (16 * (order - 1 - k))) & 0xFFFF) - 32768
        estimates.append(np.where(step == _NEVER, 0.0, np.exp2(step / _STEPS)))
    estimates, where = np.array(estimates), code >> (16 * order)

    def fit(group: np.ndarray, n_groups: int, prior: np.ndarray, strength: float) -> np.ndarray:
        mixed = np.repeat(prior[None, :], n_groups, axis=0)
        for _ in range(rounds):
            shares = mixed[group].T * estimates
            shares *= times / shares.sum(axis=0)
            mixed = np.stack([np.bincount(group, s, n_groups) for s in shares], axis=1) + strength * prior
            mixed /= mixed.sum(axis=1, keepdims=True)
        return mixed

    even = np.full(order + 1, 1.0 / (order + 1))
    overall = fit(np.zeros(len(code), np.int64), 1, even, 1.0)[0]
    out = fit(where, classes, overall, 1.0)
    # an order whose context training lacks gets no weight
    for c in range(classes):
        for k in range(2, order + 1):
            if (c // _CLASSES ** (order - k)) % _CLASSES == 0:
                out[c, k] = 0.0
    return out / out.sum(axis=1, keepdims=True)


def scores(
    docs: DataFrame, train: Column, deleted: Column, order: int = 2, block_bytes: int = 6 << 20, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score per document.

    Tokens are the words of the text, A-Z lower-cased, and one end; a null text is empty.
    ``base_score`` adds log10((c + 0.5) / (N + 0.5 (V + 1))) over tokens; ``score`` is the
    mixture's log10 probability.  Words are counted by 64-bit digests.  Without training
    documents all scores are 0.  Long texts, repeated rows and ties need no special case.
    """
    table, numbers = counts(docs, train, deleted, order, block_bytes, doc_id, text)
    n, v = numbers["N"], numbers["V"]
    mixed = weights(table, numbers, order) if n else np.eye(1, order + 1).repeat(_CLASSES ** (order - 1), axis=0)

    def score(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for lists in batches:
            found = []
            for part in _parts(list(lists) if isinstance(lists, tuple) else [lists]):
                estimates, context_class, firsts = _estimates(part, n, v)
                logs = np.log10((mixed[context_class].T * estimates).sum(axis=0))
                found.append(np.add.reduceat(logs, firsts))
            yield pa.array(np.concatenate(found) if found else [], pa.float64())

    model = F.arrow_udf(score, "double", F.ArrowUDFType.SCALAR_ITER)(*[F.col(f"c{k}") for k in range(1, order + 1)])
    floor = float(np.log10(n + 0.5 * (v + 1)))
    return table.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_sum") - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        model.alias("score"),
    )
