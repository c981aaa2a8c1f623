"""Views that give the shared test tables the shape of trace data.

Each view is a narrow projection of one table, so its work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import build_chunks
from ..operators.events import normalise
from ..operators.evidence import classify, trace_values
from ..operators.vectors import flat_metadata
from ..session import staged


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def streamed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of them."""
    schema = table(spark, folder, name).schema
    # as a pattern, since a stream takes a plain path for the folder of its files
    return spark.readStream.schema(schema).parquet(f"{folder}/{{{name}.parquet}}")


def _choice(selector: str, lines: list[str]) -> str:
    """SQL CASE over the values 0, 1, … of a selector; each line is a SQL expression."""
    return f"CASE {selector} " + " ".join(f"WHEN {i} THEN {line}" for i, line in enumerate(lines)) + " END"


def testcase_of(user: Column) -> Column:
    return F.concat(F.when(user % 2 == 0, F.lit("350")).otherwise(F.lit("360")), F.lpad(user.cast("string"), 6, "0"))


def trace_rows(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as trace rows.  Ids rise with time, so ``seq`` is the event id."""
    return as_trace_rows(table(spark, folder, "events"))


def as_trace_rows(events: DataFrame) -> DataFrame:
    """An ``events`` table, stored or streamed, as trace rows."""
    events = events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k, user = F.col("k"), F.col("user_id")
    error = _choice(
        "k % 8",
        [
            "'recv MM reject: PLMN not allowed'",
            "'LocationUpdate failed; Error = 11'",
            "'recv MM Location updating reject'",
            "'Registration denied'",
            "'received RegistrationState NASNotRegistered'",
            "'PSAttachState Detached'",
            r"'TSP_LupErrorVerdict = \'FAIL\''",
            r"'call rejected = \'busy\''",
        ],
    )
    signup = _choice(
        "k % 3",
        ["'send MM Location updating request'", "'RegistrationState NASRegistered'", "'PSAttachState Attached'"],
    )
    purchase = _choice("k % 2", ["'T3210 timeout'", "'SIP retry'"])
    view = _choice(
        "k % 2",
        [
            r"concat('PTC_A.Plmn = \'op', user_id % 7, '\';')",
            r"concat('PTC_A.Country = \'c', user_id % 5, '\';')",
        ],
    )
    line = F.expr(
        f"CASE event_type WHEN 'error' THEN {error} WHEN 'signup' THEN {signup} "
        f"WHEN 'purchase' THEN {purchase} WHEN 'view' THEN {view} ELSE 'idle tick' END"
    )
    stamp = F.when(F.col("event_id") % 97 == 0, F.lit("<null>")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    )
    return events.select(
        testcase_of(user).alias("testcase_id"),
        F.col("event_id").alias("seq"),
        stamp.alias("Timestamp"),
        (F.col("event_id") % 3).cast("string").alias("CallId"),
        F.when(F.col("event_id") % 5 != 0, F.lit("PTC_A")).alias("Ptc"),
        F.col("event_type").alias("Event"),
        F.concat(F.lit("k"), k.cast("string")).alias("Type"),
        line.alias("Information"),
        F.concat(F.lit("trace_"), testcase_of(user), F.lit("_0.csv")).alias("source_trace"),
    )


def clock_rows(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as rows that carry epoch clocks in the accepted spellings."""
    events = table(spark, folder, "events")
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("string")
    events = events.withColumn("ms", ms)
    line = _choice(
        "event_id % 4",
        [
            "concat('PTC_A.StartTime; DATETIME(', ms, ')')",
            "concat('PTC_A.StartTime: DATETIME = ', ms)",
            "concat('PTC_A.EndTime; at ', ms, ' ms')",
            "'PTC_A.StartTime; not set'",
        ],
    )
    shift = _choice("event_id % 5", ["'+02:30'", "'-01:15'", "'3'", "'0'", "'x:10'"])
    fmt = _choice("event_id % 6", ["'hour'", "'min'", "'sec'", "'date'", "'h:m:s'", "'other'"])
    return events.select(
        testcase_of(F.col("user_id")).alias("testcase_id"),
        F.col("event_id").alias("seq"),
        F.expr(line).alias("Information"),
        F.expr(shift).alias("shift"),
        F.expr(fmt).alias("fmt"),
    )


def file_names(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as a listing of trace, result and report files (several per testcase)."""
    name = _choice(
        "event_id % 6",
        [
            "concat('trace_', number, '_', event_id, '.csv')",
            "concat('Result-', number, '_', event_id, '.zip')",
            "concat('kpi_', number, '_v', event_id, '.xlsx')",
            "concat('TRACE-', number, '.csv')",
            "concat('x', number, 'y', event_id, '.zip')",
            "concat('notes_', event_id, '.csv')",
        ],
    )
    numbered = table(spark, folder, "events").withColumn("number", testcase_of(F.col("user_id")))
    return numbered.select("event_id", F.expr(name).alias("file_name"))


def events_of(spark: SparkSession, folder: str, promote_metadata: bool = False) -> DataFrame:
    """Operational events of the trace rows."""
    rows = trace_rows(spark, folder)
    return normalise(classify(rows), trace_values(rows), promote_metadata)


def chunks_of(spark: SparkSession, folder: str, promote_metadata: bool = False) -> DataFrame:
    """Chunks of the events, 2000 characters with 200 overlap."""
    return build_chunks(staged(events_of(spark, folder, promote_metadata)), 2000, 200)


def staged_chunks_of(spark: SparkSession, folder: str, promote_metadata: bool = False) -> DataFrame:
    """The chunks as a written table, for queries that read them more than once."""
    return staged(chunks_of(spark, folder, promote_metadata))


def lines_of(spark: SparkSession, folder: str) -> DataFrame:
    """``conversations`` as lines of a trace per conversation."""
    return table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("testcase_id"),
        (F.col("turn") + 1).alias("event_index"),
        F.length("text").alias("length"),
        "text",
    )


def vectors_of(spark: SparkSession, folder: str) -> DataFrame:
    """``embeddings`` as chunk vectors with a label to filter on."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), "embedding", "label"
    )


def chunk_vectors(spark: SparkSession, folder: str, chunks: DataFrame) -> DataFrame:
    """``chunk_id`` and ``embedding`` of each chunk; chunks share the vectors of ``embeddings``."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    number = F.substring("testcase_id", 4, 20).cast("long") * 31 + F.col("chunk_index")
    placed = chunks.select("chunk_id", F.pmod(number, F.lit(vectors.count())).alias("vec_id"))
    return placed.join(vectors, "vec_id").drop("vec_id")


def following_chunks(chunks: DataFrame, reach: int = 4) -> DataFrame:
    """Neighbours of a chunk: itself and the next chunks of its trace, at made-up distances."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(reach - 1))).alias("step")
    asked = chunks.select("testcase_id", "chunk_index", F.col("chunk_id").alias("query_chunk_id"), steps)
    asked = asked.select(
        "testcase_id",
        (F.col("chunk_index") + F.col("step")).alias("chunk_index"),
        "query_chunk_id",
        (F.col("step") + 1).alias("rank"),
        F.round(F.col("step") * (F.col("chunk_index") % 5) * 0.0035, 6).alias("distance"),
    )
    found = flat_metadata(chunks)
    described = F.struct(*[c for c in found.columns if c != "chunk_id"])
    found = found.select("testcase_id", "chunk_index", "chunk_id", described.alias("metadata"))
    return asked.join(found, ["testcase_id", "chunk_index"]).select(
        "query_chunk_id", "rank", "chunk_id", "distance", "metadata"
    )
