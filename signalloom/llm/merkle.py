"""A Merkle manifest of a table: one tree per source, and one over the sources' roots.

The leaves of a source are cut into aligned runs of ``fanout ** 3``; a run hashes its own subtree
alone.  Then a butterfly exchange: in round ``r`` the runs that agree in all digits (to the base
of the fanout) of their number but digit ``r`` swap the roots they have, and each of them hashes
the parent.  Every ancestor is hashed by all runs below it, so that after the last round every
run holds its source's root and all upper siblings, and no pass leads back down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.ordering import placed
from ..session import staged

#: Levels of the tree that a run hashes alone.
RUN_LEVELS = 3

_STEP = pa.struct([("before", pa.string()), ("after", pa.string())])
_PATH = "array<struct<before: string, after: string>>"


def framed(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*[framed(c) for c in columns]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a manifest's ``proof`` lead to."""
    return F.aggregate(proof, leaf, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def _sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(digests: list[str], fanout: int, alone: bool) -> list[list[str]]:
    """The levels of a run's subtree; a run that is its whole tree ends as soon as one node is left."""
    levels = [digests]
    while len(levels[-1]) > 1 if alone else len(levels) <= RUN_LEVELS:
        below = levels[-1]
        levels.append([_sha(*below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return levels


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[dict]]]:
    """(first row, rows) per run of rows sorted by queue and run."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["queue"], row["run"]) != key:
                if rows:
                    yield rows[0], rows
                key, rows = (row["queue"], row["run"]), []
            rows.append(row)
    if rows:
        yield rows[0], rows


def _by_run(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("queue", "run").sortWithinPartitions("queue", "run", *order)


def _swap(state: DataFrame, fanout: int, stride: int) -> DataFrame:
    """One round of the exchange, between runs ``stride`` apart.

    A subtree that ends early lacks some of the runs its siblings' runs would swap with; the
    runs it has serve those as well, each in turn.
    """
    ancestor, low = F.expr(f"run div {stride}"), F.col("run") % stride
    last, last_low = F.expr(f"(runs - 1) div {stride}"), (F.col("runs") - 1) % stride
    first = F.expr(f"run div {stride * fanout}") * fanout
    lows = F.when(ancestor == last, F.sequence(low, F.lit(stride - 1).cast("long"), last_low + 1)).otherwise(F.array(low))
    partners = F.flatten(
        F.transform(F.sequence(first, F.least(first + fanout - 1, last)), lambda a: F.transform(lows, lambda x: a * stride + x))
    )
    active = F.col("runs") > stride
    to = F.when(active, F.filter(partners, lambda t: t < F.col("runs"))).otherwise(F.array("run"))
    sent = state.select("queue", "runs", "path", "digest", "run", ancestor.alias("a"), F.explode(to).alias("to"))
    own = F.col("run") == F.col("to")
    met = sent.groupBy("queue", F.col("to").alias("run")).agg(
        F.max("runs").alias("runs"),
        F.max(F.when(own, F.col("path"))).alias("path"),
        F.max(F.when(own, F.col("digest"))).alias("digest"),
        F.sort_array(F.collect_list(F.struct("a", "digest"))).alias("swapped"),  # at most `fanout`
    )

    def joined(side) -> Column:
        return F.array_join(F.transform(F.filter("swapped", lambda s: side(s["a"])), lambda s: s["digest"]), "")

    step = F.struct(joined(lambda a: a < ancestor).alias("before"), joined(lambda a: a > ancestor).alias("after"))
    return met.select(
        "queue",
        "run",
        "runs",
        F.when(active, F.sha2(joined(lambda a: F.lit(True)), 256)).otherwise(F.col("digest")).alias("digest"),
        F.when(active, F.array_append("path", step)).otherwise(F.col("path")).alias("path"),
    )


def _exchanged(leaves: DataFrame, fanout: int) -> DataFrame:
    """queue, run, runs, digest (the root) and path (above the run) of every run."""

    def subtree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {"queue": [], "run": [], "runs": [], "digest": []}
        for first, rows in _runs(batches):
            top = _levels([r["leaf"] for r in rows], fanout, first["runs"] == 1)[-1][0]
            for name, value in zip(found, (first["queue"], first["run"], first["runs"], top)):
                found[name].append(value)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(found.values(), kinds)], names=list(found))

    narrow = leaves.select("queue", "run", "runs", "place", "leaf")
    state = _by_run(narrow, "place").mapInArrow(subtree, "queue string, run long, runs long, digest string")
    state = staged(state.withColumn("path", F.array().cast(_PATH)))
    most = state.agg(F.max("runs")).first()[0] or 0
    stride = 1
    while stride < most:
        state = _swap(state, fanout, stride)
        stride *= fanout
    return staged(state) if stride > 1 else state


def _proved(leaves: DataFrame, runs: DataFrame, fanout: int, id_type: str, proofs: bool) -> DataFrame:
    """id, leaf, proof_sha256, folded_root (from ``claim``) and the runs' ``subroot`` and ``root`` per leaf."""

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "proof"]
        kinds = [id_kind, *[pa.string()] * 5, pa.list_(_STEP)]
        for head, rows in _runs(batches):
            rows, upper = rows[1:], head["path"]
            levels = _levels([r["leaf"] for r in rows], fanout, head["runs"] == 1)
            above = [s["before"] + s["after"] for s in upper]
            found: list[list] = [[] for _ in names]
            for i, row in enumerate(rows):
                path, at = [], i
                for level in levels[:-1]:
                    a = at - at % fanout
                    path.append({"before": "".join(level[a:at]), "after": "".join(level[at + 1 : a + fanout])})
                    at //= fanout
                proof_sha = _sha(*[s["before"] + s["after"] for s in path], *above)
                acc = row["claim"]
                for step in (*path, *upper):
                    acc = _sha(step["before"], acc, step["after"])
                values = (row["id"], row["leaf"], head["leaf"], head["claim"], proof_sha, acc, [*path, *upper] if proofs else None)
                for column, value in zip(found, values):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, kinds)], names=names)

    id_kind = to_arrow_type(leaves.schema["id"].dataType)
    heads = runs.select("queue", "run", "runs", F.lit(-1).cast("long").alias("place"), F.lit(None).cast(id_type).alias("id"),
                        F.col("subroot").alias("leaf"), F.col("root").alias("claim"), "path")
    rows = leaves.select("queue", "run", "runs", "place", "id", "leaf", "claim", F.lit(None).cast(_PATH).alias("path"))
    schema = f"id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, proof {_PATH}"
    return _by_run(heads.unionByName(rows), "place").mapInArrow(prove, schema)


def _in_runs(rows: DataFrame, order: list[str], fanout: int) -> DataFrame:
    size = fanout**RUN_LEVELS
    return placed(rows, "queue", order).select(
        *rows.columns, "place", F.expr(f"place div {size}").alias("run"), F.expr(f"(total - 1) div {size} + 1").alias("runs")
    )


def manifest(
    docs: DataFrame,
    fanout: int = 16,
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    by: str = "source",
    order: str = "doc_id",
    claims: dict[str, Column] | None = None,
    proofs: bool = False,
) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified (and proof) per row of ``docs``.

    A leaf is the digest of ``fields``.  Leaves of equal ``by`` ascend by ``order`` (null first,
    ties by leaf, so that repeated rows are leaves of their own) and become a tree whose root is
    ``subroot``; the subroots in the order of ``by`` (null first, bytewise) become ``root``.  A
    lone leaf is its tree's root; an empty table has no root and gives no row.  Null and empty
    fields differ.  ``claims`` replaces fields by other values, as a receiver might hold: the
    leaf of those and the row's siblings fold to ``folded_root``, which is ``verified`` where it
    is the root.  With ``proofs`` the siblings come along, as :func:`folded` takes them.
    Columns beside ``fields`` are ignored.
    """
    claimed = [(claims or {}).get(f, F.col(f)) for f in fields]
    queue = F.when(F.col(by).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(by).cast("string")))
    leaves = staged(
        docs.select(
            queue.alias("queue"),
            F.col(order).alias("id"),
            leaf_digest(*[F.col(f) for f in fields]).alias("leaf"),
            leaf_digest(*claimed).alias("claim"),
        )
    )
    leaves = staged(_in_runs(leaves, ["id", "leaf", "claim"], fanout))
    runs = _exchanged(leaves, fanout)
    # the sources' roots are the leaves of one more tree
    tops = runs.where("run = 0").select(F.lit("").alias("queue"), F.col("queue").alias("id"), F.col("digest").alias("leaf"))
    tops = staged(_in_runs(tops.withColumn("claim", F.col("leaf")), ["id"], fanout))
    top_runs = _exchanged(tops, fanout).withColumn("subroot", F.col("digest")).withColumnRenamed("digest", "root")
    top = _proved(tops, top_runs, fanout, "string", True).select(F.col("id").alias("queue"), "root", F.col("proof").alias("top"))
    heads = runs.withColumnRenamed("digest", "subroot").join(top, "queue").withColumn("path", F.concat("path", "top"))
    found = _proved(leaves, heads, fanout, leaves.schema["id"].dataType.simpleString(), proofs)
    found = found.withColumn("verified", F.col("folded_root") == F.col("root"))
    return found if proofs else found.drop("proof")
