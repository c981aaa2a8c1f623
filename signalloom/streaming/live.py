"""The ingest step, storm counts and vector upserts over streams.

Every function takes a streaming or a batch DataFrame and gives the same rows for both.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..operators.events import event_columns
from ..operators.evidence import classify
from ..operators.investigate import is_failure, is_timeout
from ..operators.ordering import with_position
from ..sources.vector_store import VectorStore


def stream_events(trace_rows: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """Trace rows to events without state.

    The event id is the trace and the row's source offset, since a running number needs state
    per trace (``numbered_events``).  ``values`` is an optional static table of per-trace values.
    """
    evidence = _with_values(classify(trace_rows), values)
    return event_columns(evidence, F.format_string("%s@%d", F.col("testcase_id"), F.col("seq")))


def _with_values(evidence: DataFrame, values: DataFrame | None) -> DataFrame:
    if values is None:
        return evidence.withColumn("extracted_values", F.expr("cast(null as map<string,string>)"))
    return evidence.join(values.select("testcase_id", "extracted_values"), "testcase_id", "left")


#: The state store that ``numbered_events`` needs, for ``spark.sql.streaming.stateStore.providerClass``.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _RunningIndex(StatefulProcessor):
    """Numbers the rows of a testcase from where the micro-batch before left off."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n long")

    def _rewind(self, timers) -> None:
        """One timer per testcase, ``idle_ms`` after its last row."""
        if self.idle_ms is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.seen.get()[0] if self.seen.exists() else 0
        # what a micro-batch holds of one testcase
        own = pd.concat(list(rows)).sort_values("seq", kind="stable")
        self.seen.update((known + len(own),))
        self._rewind(timerValues)
        yield own.assign(event_index=range(known + 1, known + len(own) + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def numbered_events(trace_rows: DataFrame, values: DataFrame | None = None, idle_ms: int | None = None) -> DataFrame:
    """Trace rows, streamed in file order, to events with the ids that a batch gives them.

    The evidence of a testcase is numbered on over micro-batches; its state is one number, and
    is dropped ``idle_ms`` after the testcase's last row (never by default), after which numbers
    begin anew.  Only evidence is shuffled, by testcase; a micro-batch bounds what a task gets.
    The session's state store must be ``STATE_STORE``.  ``values`` is as in ``stream_events``.
    """
    evidence = classify(trace_rows)
    if not trace_rows.isStreaming:
        numbered = with_position(evidence)
    else:
        schema = T.StructType([*evidence.schema.fields, T.StructField("event_index", T.LongType())])
        numbered = evidence.groupBy("testcase_id").transformWithStateInPandas(
            _RunningIndex(idle_ms), schema, "Append", "None" if idle_ms is None else "ProcessingTime"
        )
    return event_columns(_with_values(numbered, values), F.format_string("%s-%04d", F.col("testcase_id"), F.col("event_index")))


def _timed(events: DataFrame, delay: str) -> DataFrame:
    """Events with a usable clock, rows later than ``delay`` behind the newest dropped."""
    timed = events.withColumn("event_time", F.col("timestamp").cast("timestamp")).filter("event_time is not null")
    return timed.withWatermark("event_time", delay)


def without_clock(events: DataFrame) -> DataFrame:
    """The events that windows and sessions cannot place, so that sums add up."""
    return events.filter("timestamp is null")


def unique_events(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each event id once, however often its source row is replayed within ``delay``.

    Events without a clock know no delay; a stream remembers their ids for good.
    """
    if not events.isStreaming:
        return events.dropDuplicates(["event_id"])
    timed = _timed(events, delay).dropDuplicatesWithinWatermark(["event_id"]).drop("event_time")
    return timed.unionByName(without_clock(events).dropDuplicates(["event_id"]))


def storm_counts(
    events: DataFrame, width: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes"
) -> DataFrame:
    """Events, timeouts and failures per operator and time window (tumbling, or sliding)."""
    window = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    counts = _timed(events, delay).groupBy(
        window.alias("w"), F.coalesce("operator", F.lit("unknown")).alias("operator")
    ).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(is_timeout()).alias("timeouts"),
        F.count_if(is_failure()).alias("failures"),
    )
    return counts.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "operator", "events", "timeouts", "failures",
    )


def activity_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Bursts of events per testcase, ended by a silence of ``gap``.

    A table is first counted by time slots as long as the gap, in each of which a testcase has
    one session at most; only slots are then put in order, so that no task gets all events of
    a busy testcase.  A stream merges the sessions of each task before they are shuffled, for
    which its session's setting ``..sessionWindow.merge.sessions.in.local.partition`` is turned on.
    """
    if not events.isStreaming:
        return _slot_sessions(events, gap)
    # sessions are merged where the rows are read, and only those of a task leave it
    events.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    sessions = _timed(events, delay).groupBy(
        F.session_window("event_time", gap).alias("w"), "testcase_id"
    ).agg(F.count(F.lit(1)).alias("events"))
    return sessions.select(
        "testcase_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events"
    )


def _slot_sessions(events: DataFrame, gap: str) -> DataFrame:
    timed = events.withColumn("event_time", F.col("timestamp").cast("timestamp")).filter("event_time is not null")
    micros = F.unix_micros("event_time")
    width = F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {gap}"))
    slots = (
        timed.groupBy("testcase_id", F.floor(micros / width).alias("slot"))
        .agg(F.min("event_time").alias("first"), F.max("event_time").alias("last"), F.count(F.lit(1)).alias("n"))
    )
    in_turn = Window.partitionBy("testcase_id").orderBy("slot")
    pause = F.unix_micros("first") - F.unix_micros(F.lag("last").over(in_turn))
    opened = slots.withColumn("opens", F.coalesce((pause > width).cast("int"), F.lit(1)))
    numbered = opened.withColumn("session", F.sum("opens").over(in_turn))
    joined = numbered.groupBy("testcase_id", "session").agg(
        F.min("first").alias("session_start"), F.max("last").alias("last"), F.sum("n").alias("events")
    )
    return joined.select(
        "testcase_id", "session_start", (F.col("last") + F.expr(f"interval {gap}")).alias("session_end"), "events"
    )


def upsert_vectors(stream: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> DataStreamWriter:
    """Each micro-batch merged into the vector store at ``path``; a replayed batch changes nothing.

    A batch reads and rewrites the buckets it touches, however many came before.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            VectorStore(batch.sparkSession, path, buckets).upsert(batch, batch_id)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The vector table after all batches: per chunk the row of the latest one."""
    return VectorStore(spark, path).read()


def drain(df: DataFrame, folder: str) -> DataFrame:
    """Run a stream over everything available now and return what it wrote, as a batch.

    Aggregates need append mode, which holds back windows the watermark has not passed.
    """
    query = (
        df.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")
