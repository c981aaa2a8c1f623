"""Trace files as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names
from ..functions import text as tx
from ..schemas import TRACE_COLUMNS, TRACE_FILE
from . import splits


def _with_order(df: DataFrame, split_files: bool) -> DataFrame:
    """Add ``file_path`` and ``seq``, an integer that rises in file order.

    The row id counts rows within a task, and a task reads a split front to back.  A file
    read whole is one split.  For split files the offset of the split is added; a row
    takes at least one byte, so offsets plus row numbers never collide or reorder.
    """
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = df.select(
        "*",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        in_task.alias("_row"),
    )
    if not split_files:
        return rows.withColumn("seq", F.col("_row") + 1).drop("_start", "_row")
    firsts = rows.groupBy("file_path", "_start").agg(F.min("_row").alias("_first"))
    return (
        rows.join(firsts, ["file_path", "_start"])
        .withColumn("seq", F.col("_start") + F.col("_row") - F.col("_first") + 1)
        .drop("_start", "_row", "_first")
    )


def _rows(reader, path, split_files: bool) -> DataFrame:
    rows = _with_order(reader.csv(path), split_files)
    name = names.base_name(F.col("file_path"))
    return rows.select(
        names.testcase_id(name).alias("testcase_id"),
        "seq",
        *[c for c in rows.columns if c not in ("file_path", "seq")],
        F.col("file_path").alias("source_trace"),
    )


def read_traces(spark: SparkSession, path, split_files: bool = False, columns: list[str] | None = None) -> DataFrame:
    """``;``-separated trace files with a header and standard quoting, all columns text.

    Quoted fields may span lines, so a file is read by one task.  Where traces have no
    line breaks inside quotes, ``split_files=True`` lets large files be read in parallel;
    ``read_traces_any_header`` does so for all files.  A header in another column order stops
    the read; ``columns`` names the header of files that hold more than the usual columns.
    """
    header = T.StructType([T.StructField(c, T.StringType()) for c in columns]) if columns else TRACE_FILE
    reader = (
        spark.read.schema(header)
        .option("header", True)
        .option("sep", ";")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", not split_files)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
    )
    return _rows(reader, path, split_files)


def _clean(line: str) -> Column:
    """A header line without byte-order mark, quotes and carriage return."""
    return F.regexp_replace(line, '[\r\ufeff"]', "")


def read_traces_any_header(spark: SparkSession, path, max_headers: int = 100, columns: list[str] | None = None) -> DataFrame:
    """``;``-separated traces of any size, whose headers may order the columns differently.

    Files are read in parallel splits, also where quoted fields hold line breaks (``splits``).
    Columns are bound by name through the header of their file; columns a file lacks are null.
    More than ``max_headers`` kinds of header are an error, since such files are no traces.
    """
    columns = columns or TRACE_COLUMNS
    records, headers = splits.quoted_records(spark, path, ";")
    kinds = headers.select("header").distinct().limit(max_headers + 1).collect()
    if len(kinds) > max_headers:
        raise ValueError(f"more than {max_headers} kinds of header under {path}")
    orders = sorted(r["header"].split(";") for r in kinds)
    width = max((len(o) for o in orders), default=1)
    fields = T.StructType([T.StructField(f"_{n}", T.StringType()) for n in range(width)])
    parsed = F.from_csv("text", fields.simpleString()[len("struct<") : -1].replace(":", " "), {"sep": ";", "quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    rows = records.join(headers, "file_path").withColumn("parsed", parsed)
    parts = F.array(*[F.col(f"parsed._{n}") for n in range(width)])

    def named(column: str) -> Column:
        at = F.array_position(F.split("header", ";"), column)
        return F.when(at > 0, F.get(parts, (at - 1).cast("int"))).alias(column)

    return rows.select(
        names.testcase_id(names.base_name(F.col("file_path"))).alias("testcase_id"),
        (F.col("at") + 1).alias("seq"),
        *[named(c) for c in columns],
        F.col("file_path").alias("source_trace"),
    )


def read_plain_traces(spark: SparkSession, path, columns: list[str] | None = None) -> DataFrame:
    """Comma-separated traces split at every comma, no quoting; short rows end in nulls.

    The first line of a file is its header, and columns bind to it by name, whatever their
    order; columns that a file lacks are null.  Large files are read in parallel.
    """
    columns = columns or TRACE_COLUMNS
    lines = _with_order(spark.read.text(path), split_files=True)
    # one row per file: the line that begins at its first byte
    first = lines.filter("seq = 1").select("file_path", F.split(F.trim(_clean("value")), r"\s*,\s*", -1).alias("header"))
    parts = F.split(F.regexp_replace("value", "\r$", ""), ",", -1)
    rows = lines.filter("seq > 1 AND trim(value) != ''").join(first, "file_path").withColumn("parts", parts)

    def named(column: str) -> Column:
        at = F.array_position("header", column)
        return F.when(at > 0, F.get("parts", (at - 1).cast("int"))).alias(column)

    return rows.select(
        names.testcase_id(names.base_name(F.col("file_path"))).alias("testcase_id"),
        "seq",
        *[named(c) for c in columns],
        F.col("file_path").alias("source_trace"),
    )


def one_file_per_testcase(rows: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """Rows of the one trace file that stands for each testcase: that of ``artifacts``
    (``discover``), else the highest path.

    Files number their rows on their own, so rows of two files would share positions.
    """
    if artifacts is None:
        chosen = rows.groupBy("testcase_id").agg(F.max("source_trace").alias("source_trace"))
    else:
        chosen = artifacts.select("testcase_id", F.col("trace_path").alias("source_trace"))
    return rows.join(chosen, ["testcase_id", "source_trace"], "left_semi")


def explode_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Text column to non-blank lines: 1-based line number, stripped text, name, labels."""
    # Fixed value: the fifth ``;`` field names the event.
    lines = df.select(
        *[c for c in df.columns if c != text],
        F.posexplode(F.split(F.col(text), "\r\n|\n|\r")).alias("_i", "_line"),
    ).withColumn("raw", tx.strip(F.col("_line")))
    return (
        lines.filter(F.col("raw") != "")
        .withColumn("line_number", F.col("_i") + 1)
        .withColumn("event_name", F.coalesce(F.get(F.split("raw", ";"), F.lit(4)), F.lit("unknown")))
        .withColumn("signals", tx.signal_labels("raw"))
        .drop("_i", "_line")
    )
