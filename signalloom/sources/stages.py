"""Stage tables: events, chunks, neighbours, summaries and the report bundle."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names
from ..operators.ordering import placed
from ..schemas import CHUNK, EVENT
from ..session import remove_folder, shuffles_freed
from . import manifests, splits


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """A stage as Parquet; partition by campaign at most, never by testcase."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_clustered(df: DataFrame, path: str, by: list[str], blooms: list[str] | None = None, group_rows: int = 100_000, mode: str = "overwrite") -> None:
    """A stage for point lookups: range-clustered by ``by``, with bloom filters of ``blooms``.

    A lookup by the first column of ``by`` reads the row groups whose range holds it; one by
    another column reads those whose bloom filter does not rule it out.  A row group holds
    ``group_rows`` rows, so that a lookup reads as much of a large table as of a small one.  Name
    enough columns in ``by`` that no value of all of them fills a file.
    """
    writer = df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode(mode)
    for column in blooms if blooms is not None else by:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", group_rows)
    writer.option("parquet.block.row.count.limit", group_rows).parquet(path)


def export_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A stage as JSON lines, nulls kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def read_stage(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def read_json(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """JSON lines as ``export_json`` writes them."""
    return spark.read.schema(schema).json(path)


def export_arrays(df: DataFrame, path: str, key: str, order: str, part_rows: int = 10_000, compression: str = "none") -> None:
    """JSON arrays per value of ``key``, in ``order``, under ``path/<key>=<value>/part=<n>``.

    A part holds ``part_rows`` rows, the last one fewer, so that no task meets all rows of a
    key; parts in turn are the key's array.  Ties in ``order`` fall either way.  ``compression``
    is that of the files, which are read in one task each unless it is none.
    """
    fields = [c for c in df.columns if c != order]
    rows = placed(df.withColumn("__at", F.col(order)), key, ["__at"], "__place", "__total")
    rows = rows.withColumn("__part", F.expr(f"__place div {part_rows}"))
    in_turn = F.array_sort(  # rows may hold maps, which have no order of their own
        F.collect_list(F.struct(F.col("__place").alias("at"), F.struct(*fields).alias("row"))),
        lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0),
    )
    arrays = rows.groupBy(F.col(key).alias("__key"), "__part").agg(in_turn.alias("rows"))
    text = F.to_json(F.transform("rows", lambda r: r["row"]), {"ignoreNullFields": "false"})
    named = arrays.select("__key", "__part", text.alias("value")).withColumnsRenamed({"__key": key, "__part": "part"})
    with shuffles_freed(df.sparkSession):
        named.write.partitionBy(key, "part").text(path, compression=compression)


def _parsed(elements: DataFrame, schema: str | T.StructType, *columns: Column) -> DataFrame:
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    named = elements.select(*columns, F.from_json("text", kind).alias("_row"))
    return named.select(*named.columns[:-1], "_row.*")


def read_event_files(spark: SparkSession, path, testcase: Column | None = None) -> DataFrame:
    """Per-testcase JSON arrays of events, in files of any size or in parts.

    The testcase comes from the file name (or ``testcase``, an expression over ``file_path`` and the
    element's ``text``) and the event's place in the array is its index.  A file that names neither
    an event's id nor its name holds no events and is skipped.
    """
    if testcase is None:
        testcase = F.regexp_replace(names.base_name(F.col("file_path")), r"_events\.json$", "")
    fields = [f for f in EVENT.fields if f.name not in ("testcase_id", "seq", "timestamp")]
    schema = T.StructType([*fields, T.StructField("timestamp", T.StringType())])
    elements = splits.array_elements(spark, path, ("event_id", "event_name"))
    return _parsed(elements, schema, testcase.alias("testcase_id"), (F.col("place") + 1).alias("seq"))


def read_chunk_files(spark: SparkSession, path) -> DataFrame:
    """JSON arrays of chunks; their order is ``(testcase_id, chunk_index)``."""
    return _parsed(splits.array_elements(spark, path), CHUNK).filter("chunk_id is not null")


# Rows of a similarity file: a match with the chunk that asked, which the file name alone does not keep.
SIMILARITY = "query_chunk_id string, rank int, chunk_id string, distance double, similarity_score double"
SUMMARY = "chunk_id string, trace_id string, testcase_id string, summary string, similar_incident_count long"


def read_similarity_files(spark: SparkSession, path) -> DataFrame:
    """JSON arrays of matches, one file or many."""
    return _parsed(splits.array_elements(spark, path), SIMILARITY).filter("query_chunk_id is not null")


def read_summary_files(spark: SparkSession, path) -> DataFrame:
    """JSON arrays of chunk summaries."""
    return _parsed(splits.array_elements(spark, path), SUMMARY).filter("chunk_id is not null")


# The tables of a bundle.
BUNDLE = ("campaign_health", "summaries", "root_cause_reports", "retry_reports")


def write_report_bundle(
    path: str,
    run_id: str,
    health: DataFrame,
    summaries: DataFrame,
    root_causes: DataFrame,
    retry_reports: DataFrame,
) -> None:
    """The four report tables under one run id, each in its own folder.

    A manifest under ``path/bundles`` names the run's folders when all four are written.  Until
    then, and if the run ends halfway, readers of ``read_report_bundle`` see the bundles before
    it; a run that is repeated takes the place of its earlier attempts.
    """
    spark = health.sparkSession
    attempt = f"{run_id}-{uuid.uuid4().hex[:12]}"
    for name, df in zip(BUNDLE, (health, summaries, root_causes, retry_reports)):
        stamped = df.withColumn("run_id", F.lit(run_id)).withColumn("generated_at", F.current_timestamp())
        export_json(stamped, f"{path}/{name}/bundle={attempt}")
    known = manifests.committed(spark, f"{path}/bundles")
    content = {"run_id": run_id, "tables": {n: f"{n}/bundle={attempt}" for n in BUNDLE}}
    manifests.commit(spark, f"{path}/bundles", f"{len(known):08d}-{uuid.uuid4().hex[:8]}", content)
    for name in known:
        old = manifests.load(spark, f"{path}/bundles", name)
        if old["run_id"] == run_id:
            for folder in old["tables"].values():
                remove_folder(spark, f"{path}/{folder}")


def read_report_bundle(spark: SparkSession, path: str, run_id: str | None = None) -> dict[str, str]:
    """The folders of a whole bundle by table: that of ``run_id``, else the newest one.

    An error where no such bundle is complete.
    """
    for name in reversed(manifests.committed(spark, f"{path}/bundles")):
        found = manifests.load(spark, f"{path}/bundles", name)
        if run_id in (None, found["run_id"]):
            return {n: f"{path}/{folder}" for n, folder in found["tables"].items()}
    raise FileNotFoundError(f"no complete bundle under {path}")
