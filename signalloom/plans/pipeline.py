"""The three stages end to end: files to events, events to neighbours, chunks to reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import build_chunks
from ..operators.events import normalise
from ..operators.evidence import classify, raw_signals, trace_values
from ..operators.health import campaign_health
from ..operators.heavy import heavy_keys, spread_join
from ..operators.neighbours import nearest_chunks
from ..operators.prompts import root_cause_prompts, summary_prompts
from ..operators.retry import reportable, retry_reports
from ..operators.vectors import (
    attach_embeddings, embed, embedding_input, fit_text_vectors, flat_metadata, semantic_text, split_empty,
)
from ..session import stage_scope, staged
from ..sources.stages import read_stage, write_report_bundle, write_stage
from ..sources.traces import one_file_per_testcase


def ingest(
    trace_rows: DataFrame, out: str, mapping: list[dict] | None = None, artifacts: DataFrame | None = None, **options
) -> DataFrame:
    """Trace rows to the stored ``values``, ``raw_signals`` and ``events`` tables; returns events.

    One file counts per testcase: that of ``artifacts`` (``discover``), else the highest path,
    where rows say which file they come from.  ``read_traces`` reads a file that may hold quoted
    line breaks in one task, ``read_traces_any_header`` in splits.
    """
    if "source_trace" in trace_rows.columns:
        trace_rows = one_file_per_testcase(trace_rows, artifacts)
    with stage_scope(trace_rows.sparkSession):
        rows = staged(trace_rows)  # raw text is parsed once
        evidence = staged(classify(rows))  # and classified once
        write_stage(trace_values(rows, mapping, every_trace=True), f"{out}/values")
        write_stage(raw_signals(evidence), f"{out}/raw_signals")
        values = read_stage(rows.sparkSession, f"{out}/values")
        write_stage(normalise(evidence, values, **options), f"{out}/events")
        return read_stage(rows.sparkSession, f"{out}/events")


def analyse(
    events: DataFrame, out: str, chunk_size: int = 2000, chunk_overlap: int = 200, k: int = 5,
    embeddings=None, skip_embedding: bool = False, skip_similarity: bool = False, strict: bool = False, **options,
) -> dict[str, DataFrame]:
    """Events to the stored ``chunks``, ``vectors``, ``rejects`` and ``neighbours`` tables.

    ``embeddings`` maps a table with ``chunk_id`` and ``text`` to one with ``chunk_id`` and
    ``embedding``; by default texts are embedded with a model fitted on them.  Chunks without
    text and chunks that got no vector are written to ``rejects`` with the reason; ``strict``
    makes them an error.
    """
    spark = events.sparkSession
    with stage_scope(spark):
        write_stage(build_chunks(events, chunk_size, chunk_overlap), f"{out}/chunks")
        chunks = read_stage(spark, f"{out}/chunks")
        tables = {"chunks": chunks}
        if skip_embedding:
            return tables
        texts, blank = split_empty(chunks.select("chunk_id", embedding_input(semantic_text(chunks)).alias("text")), "text")
        if embeddings is None:
            found = embed(fit_text_vectors(texts), texts)
        else:
            found = embeddings(texts)
        with_vectors, lost = attach_embeddings(chunks.join(texts.select("chunk_id"), "chunk_id", "left_semi"), found)
        rejects = blank.select("chunk_id", F.lit("empty text").alias("reason")).unionByName(
            lost.select("chunk_id", F.lit("no vector").alias("reason"))
        )
        write_stage(rejects, f"{out}/rejects")
        tables["rejects"] = read_stage(spark, f"{out}/rejects")
        if strict and (bad := tables["rejects"].count()):
            raise ValueError(f"{bad} chunks without text or vector, see {out}/rejects")
        stored = flat_metadata(chunks).join(with_vectors.select("chunk_id", "text", "embedding"), "chunk_id")
        write_stage(stored, f"{out}/vectors")
        tables["vectors"] = read_stage(spark, f"{out}/vectors")
        if skip_similarity:
            return tables
        write_stage(nearest_chunks(tables["vectors"], k=k, **options), f"{out}/neighbours")
        tables["neighbours"] = read_stage(spark, f"{out}/neighbours")
        return tables


def report(
    spark: SparkSession, data: str, out: str, run_id: str, max_chunks: int | None = None,
    decision_col: str = "retry_recommendation", product: str = "roaming", root_causes: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Stored chunks and neighbours to the report bundle: retry advice, health and prompts.

    ``root_causes`` are the answers to root-cause prompts that health counts.  A campaign
    without chunks is an error.
    """
    chunks = read_stage(spark, f"{data}/chunks")
    if chunks.limit(1).count() == 0:
        raise ValueError("no chunks to report on")
    neighbours = read_stage(spark, f"{data}/neighbours")
    picked = staged(reportable(chunks, max_chunks))
    advice = staged(retry_reports(picked, neighbours))
    health = campaign_health(picked, advice, root_causes, decision_col=decision_col)
    meta = flat_metadata(chunks)
    # only what the picked chunks ask for meets the metadata
    asked = picked.select(F.col("chunk_id").alias("query_chunk_id"))
    wanted = neighbours.join(asked, "query_chunk_id", "left_semi")
    found = meta.select("chunk_id", F.struct(*[c for c in meta.columns if c != "chunk_id"]).alias("metadata"))
    # a chunk may be the neighbour of very many
    described = spread_join(wanted, found, "chunk_id", heavy_keys(neighbours, "chunk_id"), "inner", F.xxhash64("query_chunk_id"))
    summaries = summary_prompts(picked, described, product)
    causes = root_cause_prompts(picked, described, product)
    write_report_bundle(out, run_id, health, summaries, causes, advice)
    return {"health": health, "retry_reports": advice, "summary_prompts": summaries, "root_cause_prompts": causes}
