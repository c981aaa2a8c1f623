"""Events to overlapping, size-bounded text chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.packing import Block, chain
from ..functions.batches import sorted_groups
from ..session import BLOCK_ROWS, NARROW_ROWS, dealt, staged
from .heavy import heavy_keys, spread_join

_EXITS = (
    "testcase_id string, block long, reach_low long, reach_high long, reach_out long, "
    "chunk_count long, carry_from array<long>, carry_to array<long>"
)
_ENTRIES = "testcase_id string, block long, reach long, carried long, chunks_before long"
_BOUNDS = (
    "testcase_id string, chunk_index long, line_start long, line_end long, "
    "event_start long, event_end long"
)


def _printed(name: str, kind: T.DataType) -> str:
    """SQL text of a column as printed: booleans capitalised, clocks with their fraction."""
    if isinstance(kind, T.BooleanType):
        return f"CASE WHEN {name} THEN 'True' WHEN NOT {name} THEN 'False' END"
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        whole = f"date_trunc('second', {name}) = {name}"
        return (f"CASE WHEN {whole} THEN date_format({name}, 'yyyy-MM-dd HH:mm:ss') "
                f"ELSE date_format({name}, 'yyyy-MM-dd HH:mm:ss.SSSSSS') END")
    return f"CAST({name} AS STRING)"


def compact_struct(df: DataFrame, name: str) -> Column:
    """``k=v, k=v`` over a struct's scalar fields in field order, nulls left out."""
    if name not in df.columns:
        return F.lit("")
    parts = []
    for field in df.schema[name].dataType.fields:
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            continue
        shown = _printed(f"{name}.`{field.name}`", field.dataType)
        parts.append(f"CASE WHEN {name}.`{field.name}` IS NOT NULL THEN concat('{field.name}=', {shown}) END")
    return F.expr(f"array_join(array_compact(array({', '.join(parts)})), ', ')")


def compact_map(values: Column) -> Column:
    """``k=v, k=v`` over a map in entry order, null values left out."""
    kept = F.filter(F.map_entries(values), lambda e: e["value"].isNotNull())
    pairs = F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.coalesce(F.array_join(pairs, ", "), F.lit(""))


def event_text(events: DataFrame) -> Column:
    """One event as a line of ``label=value`` parts; absent columns print as ``None``."""

    kinds = {field.name: field.dataType for field in events.schema.fields}

    def part(label: str, name: str) -> str:
        if name not in kinds:
            return f"'{label}=None'"
        return f"concat('{label}=', coalesce({_printed(name, kinds[name])}, 'None'))"

    def listed(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label}=["), value, F.lit("]"))

    tags = F.coalesce(F.array_join("tags", ", "), F.lit("")) if "tags" in kinds else F.lit("")
    values = compact_map(F.col("extracted_values")) if "extracted_values" in kinds else F.lit("")
    # Part labels and their columns, in print order.
    head = [
        ("testcase_id", "testcase_id"), ("event_id", "event_id"), ("timestamp", "timestamp"),
        ("family", "event_family"), ("protocol_layer", "protocol_layer"), ("name", "event_name"),
        ("severity", "severity"), ("result", "result"), ("operator", "operator"),
        ("country", "country"), ("domain", "network_domain"), ("workflow_stage", "workflow_stage"),
        ("direction", "direction"), ("cause", "cause"), ("retry_recommended", "retry_recommended"),
        ("recommendation", "recommendation"), ("message", "normalized_message"),
    ]
    return F.concat_ws(
        " | ",
        F.expr(f"concat_ws(' | ', {', '.join(part(label, name) for label, name in head)})"),
        listed("tags", tags),
        listed("metadata", compact_struct(events, "metadata")),
        listed("extracted_values", values),
        F.expr(part("raw", "raw_message")),
    )


def chunk_bounds(
    lines: DataFrame,
    chunk_size: int = 4000,
    chunk_overlap: int = 400,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Line and event range of every chunk.

    ``lines`` holds ``testcase_id``, ``event_index`` (1-based, gap-free per trace) and
    ``length``.  Only these narrow rows reach Python.  A trace longer than ``block_rows``
    is packed by several tasks (see ``functions.packing``).  ``lines`` is read twice, so it
    should come from a stored table.
    """
    block_of = F.expr(f"(event_index - 1) div {block_rows}")
    rows = lines.select("testcase_id", "event_index", "length", block_of.alias("part"))
    total = lines.count()
    keep = max(chunk_overlap, 0)

    def spread_out(df: DataFrame, *keys: str) -> DataFrame:
        # narrow rows take so little when compressed that Spark would give millions of them to a task
        return dealt(df, total, *keys, task_rows=NARROW_ROWS)

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        """Blocks of one trace, from its parts: a part with less text than a look-back is joined
        with those after it.  A block is called by its first part."""
        pdf = pdf.sort_values("part").reset_index(drop=True)
        blocks, chars, opens = [], 0, True
        for part, size, final in zip(pdf["part"], pdf["chars"], pdf["final"]):
            blocks.append(part if opens else blocks[-1])
            chars = size if opens else chars + size
            opens = chars > chunk_size + keep and chars - final >= keep
        following = {a: b for a, b in zip(sorted(set(blocks)), sorted(set(blocks))[1:])}
        pdf["block"], pdf["next_block"] = blocks, [following.get(b, -1) for b in blocks]
        pdf["after_next"] = [following.get(b, -1) for b in pdf["next_block"]]
        return pdf[["testcase_id", "part", "block", "next_block", "after_next"]]

    parts = rows.groupBy("testcase_id", "part").agg(
        F.sum("length").alias("chars"), F.max_by("length", "event_index").alias("final")
    )
    parts = spread_out(parts, "testcase_id")
    case = rows.schema["testcase_id"].dataType.simpleString()
    parts = parts.withColumn("_most", F.max("part").over(Window.partitionBy("testcase_id")))
    whole = parts.filter("_most = 0").select(
        "testcase_id", "part", F.col("part").alias("block"), *[F.lit(-1).cast("long").alias(c) for c in ("next_block", "after_next")]
    )
    schema = f"testcase_id {case}, part long, block long, next_block long, after_next long"
    blocks = whole.unionByName(parts.filter("_most > 0").drop("_most").groupBy("testcase_id").applyInPandas(unite, schema))
    # nor are they sent to every executor, which Spark would do as they take little on disk
    place = ["testcase_id", "part"]
    rows = spread_out(rows, *place).hint("merge").join(spread_out(blocks, *place), place).drop("part")
    rows = spread_out(rows, "testcase_id", "block")

    # Lines at the end of a block are look-back of the next block as well.
    in_block = Window.partitionBy("testcase_id", "block")
    sofar = in_block.orderBy("event_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (
        rows.withColumn("_sofar", F.sum("length").over(sofar))
        .withColumn("_all", F.sum("length").over(in_block))
        .withColumn("_last", F.max_by("length", "event_index").over(in_block))
    )
    left = F.col("_all") - F.col("_sofar")
    is_tail = (F.col("next_block") >= 0) & (
        (left <= chunk_size + keep) | (left - F.col("_last") < keep)
    )
    own = F.struct("block", "next_block")
    following = F.struct(F.col("next_block").alias("block"), F.col("after_next").alias("next_block"))
    spread = F.when(is_tail, F.array(own, following)).otherwise(F.array(own))
    # Written once: the narrow rows are read by the pass over long traces and by the last pass.
    rows = staged(
        rows.select("testcase_id", "event_index", "length", F.inline(spread))
    )

    def held(group: dict[str, np.ndarray]) -> Block:
        block, index = group["block"][0], group["event_index"]
        lookback = int(np.searchsorted(index, block * block_rows, side="right")) if block else 0
        return Block(int(index[0]), group["length"], lookback, chunk_size, chunk_overlap, group["next_block"][0] < 0)

    runs_of = ["reach_low", "reach_high", "reach_out", "chunk_count", "carry_from", "carry_to"]

    def exits(batches):
        for group in sorted_groups(batches, ["testcase_id", "block"]):
            out = pd.DataFrame(held(group).exits(), columns=runs_of)
            out.insert(0, "block", int(group["next_block"][0]))
            out.insert(0, "testcase_id", group["testcase_id"][0])
            yield out

    def entries(pdf: pd.DataFrame) -> pd.DataFrame:
        # what leaves a block enters the one that the row is called by
        groups = sorted(pdf.groupby("block"), key=lambda g: g[0])
        blocks = [list(g[runs_of].itertuples(index=False, name=None)) for _, g in groups]
        found = pd.DataFrame(chain(blocks), columns=["reach", "carried", "chunks_before"])
        found.insert(0, "block", [b for b, _ in groups])
        found.insert(0, "testcase_id", pdf["testcase_id"].iloc[0])
        return found

    def bounds(batches):
        names = ["testcase_id", "chunk_index", "line_start", "line_end", "event_start", "event_end"]
        rows = []
        for group in sorted_groups(batches, ["testcase_id", "block"]):
            case, number = group["testcase_id"][0], int(group["chunks_before"][0])
            for start, end, first in held(group).chunks(int(group["reach"][0]), int(group["carried"][0])):
                rows.append((case, number, start, end, first, end))
                number += 1
            if len(rows) >= 10_000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    def by_block(df: DataFrame) -> DataFrame:
        """Each block in one task, its rows in order."""
        return spread_out(df, "testcase_id", "block").sortWithinPartitions("testcase_id", "block", "event_index")

    long_traces = rows.filter("next_block >= 0")
    starts = (
        by_block(long_traces).mapInPandas(exits, _EXITS).groupBy("testcase_id").applyInPandas(entries, _ENTRIES)
    )
    placed = rows.join(starts, ["testcase_id", "block"], "left").fillna(
        0, ["reach", "carried", "chunks_before"]
    )
    return by_block(placed).mapInPandas(bounds, _BOUNDS)


def chunk_members(bounds: DataFrame) -> DataFrame:
    """One row per chunk and line or event it holds; bounded by the chunk's own size."""
    first = F.least("line_start", "event_start")
    return bounds.withColumn(
        "event_index", F.explode(F.sequence(first, F.col("event_end")))
    ).select(
        "testcase_id",
        "chunk_index",
        "event_index",
        (F.col("event_index") >= F.col("line_start")).alias("in_text"),
        (F.col("event_index") >= F.col("event_start")).alias("in_events"),
    )


def build_chunks(
    events: DataFrame,
    chunk_size: int = 4000,
    chunk_overlap: int = 400,
    sources: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Chunks of every trace: text, event ids, distinct value sets and flags.

    ``events`` needs ``testcase_id`` and a gap-free ``event_index`` (``with_position``
    gives one).  ``sources`` may name ``trace_path``, ``result_path`` and ``report_path``
    per testcase.  Chunks have a bounded size, so each aggregate group is small.
    """
    text = event_text(events)
    # the printed text is long to make and is only needed for its length here, so that is kept
    lines = staged(events.select("testcase_id", "event_index", F.length(text).alias("length")))
    members = chunk_members(chunk_bounds(lines, chunk_size, chunk_overlap, block_rows))

    flag = F.col("retry_recommended") if "retry_recommended" in events.columns else F.lit(None).cast("boolean")
    origin = F.col("source_trace") if "source_trace" in events.columns else F.lit(None).cast("string")
    # lines are printed where their chunk is put together, and columns sent there, which take less
    wide = events.drop("chunk_index", "in_text", "in_events").withColumns({"__flag": flag, "__origin": origin})
    total = events.count()
    place = ["testcase_id", "event_index"]
    # neither side may be sent to every executor, which Spark would do by their size on disk
    joined = dealt(members, total, *place).hint("merge").join(dealt(wide, total, *place), place)
    joined = dealt(joined, total, "testcase_id", "chunk_index")

    counted = F.col("in_events")

    def values(name: str) -> Column:
        kept = F.when(counted, tx.blank_to_null(F.col(name)))
        return F.array_sort(F.collect_set(kept))

    def in_order(keep: Column, value: Column) -> Column:
        rows = F.array_sort(F.collect_list(F.when(keep, F.struct("event_index", value.alias("v")))))
        return F.transform(rows, lambda r: r["v"])

    tags = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(counted, F.col("tags"))))))
    chunks = (
        joined.groupBy("testcase_id", "chunk_index")
        .agg(
            F.array_join(in_order(F.col("in_text"), text), "\n").alias("text"),
            F.count_if(counted).alias("event_count"),
            in_order(counted & F.col("event_id").isNotNull(), F.col("event_id")).alias("event_ids"),
            values("event_name").alias("event_names"),
            values("event_family").alias("event_families"),
            values("severity").alias("severities"),
            values("cause").alias("causes"),
            values("operator").alias("operators"),
            values("country").alias("countries"),
            values("network_domain").alias("network_domains"),
            F.filter(tags, lambda t: t != "").alias("tags"),
            F.min_by(F.struct("__origin"), F.when(counted, F.col("event_index")))["__origin"]
            .alias("source_trace"),
            F.coalesce(F.bool_or(counted & (F.col("result") == "failed")), F.lit(False)).alias("has_failure"),
            F.coalesce(F.bool_or(counted & F.col("__flag")), F.lit(False))
            .alias("has_retry_recommended"),
        )
    )
    if sources is None:
        chunks = chunks.withColumn("source_result", F.lit(None).cast("string")).withColumn(
            "source_report", F.lit(None).cast("string")
        )
    else:
        paths = sources.select("testcase_id", "trace_path", "result_path", "report_path")
        # a trace has no more chunks than events; those of a busy one go to several tasks
        heavy = heavy_keys(events, "testcase_id")
        chunks = (
            spread_join(chunks, paths, "testcase_id", heavy, "left", F.col("chunk_index"))
            .withColumn("source_trace", F.coalesce(tx.blank_to_null(F.col("trace_path")), F.col("source_trace")))
            .withColumn("source_result", F.col("result_path"))
            .withColumn("source_report", F.col("report_path"))
        )
    return chunks.select(
        F.concat("testcase_id", F.lit("::chunk_"), "chunk_index").alias("chunk_id"),
        F.col("testcase_id").alias("trace_id"),
        "testcase_id",
        "chunk_index",
        "text",
        "event_count",
        "event_ids",
        "event_names",
        "event_families",
        "severities",
        "causes",
        "operators",
        "countries",
        "network_domains",
        "tags",
        "source_trace",
        "source_result",
        "source_report",
        (F.array_contains("severities", "high") | F.array_contains("severities", "critical"))
        .alias("has_high_severity"),
        "has_failure",
        "has_retry_recommended",
    )


def trace_id_of(df: DataFrame) -> Column:
    """Trace id of a nested trace record: its own id, its testcase, its source's, its first event's."""
    events = nested_events(df)
    names = set(df.columns)
    options = [F.col(name) for name in ("trace_id", "testcase_id") if name in names]
    if "source" in names:
        options.append(F.col("source.testcase_id"))
    if events is not None:
        options.append(F.get(events, F.lit(0))["testcase_id"])
    return F.coalesce(*[tx.blank_to_null(o.cast("string")) for o in options], F.lit("unknown_trace"))


def nested_events(df: DataFrame) -> Column | None:
    """Event array of a nested trace record: the first of the accepted columns that is set."""
    # Accepted names, in priority order.
    names = [n for n in ("normalized_events", "events", "operational_events") if n in df.columns]
    return F.coalesce(*[F.col(n) for n in names]) if names else None


def unnest_traces(df: DataFrame) -> DataFrame:
    """Nested trace records to event rows with ``event_index``; the trace id becomes the testcase."""
    listed = df.select(trace_id_of(df).alias("_trace"), F.posexplode(nested_events(df)).alias("_i", "_e"))
    fields = [f.name for f in listed.schema["_e"].dataType.fields if f.name != "testcase_id"]
    return listed.select(
        F.col("_trace").alias("testcase_id"),
        (F.col("_i") + 1).cast("long").alias("event_index"),
        *[F.col("_e")[name].alias(name) for name in fields],
    )
