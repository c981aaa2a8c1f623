"""Column types of the stage tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()
_STRINGS = T.ArrayType(_S)

# Columns of a trace file, in the usual header order.
TRACE_COLUMNS = ["Timestamp", "CallId", "Ptc", "Event", "Type", "Information"]

TRACE_FILE = T.StructType([T.StructField(name, _S) for name in TRACE_COLUMNS])

EVENT_METADATA = T.StructType(
    [
        T.StructField("evidence_type", _S),
        T.StructField("evidence_category", _S),
        T.StructField("evidence_value", _S),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("metric_name", _S),
        T.StructField("event_code", _S),
        T.StructField("source_event", _S),
        T.StructField("source_type", _S),
        T.StructField("recommendation", _S),
        T.StructField("retry_recommended", T.BooleanType()),
    ]
)

EVENT = T.StructType(
    [
        T.StructField("testcase_id", _S),
        T.StructField("event_id", _S),
        T.StructField("seq", T.LongType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("event_family", _S),
        T.StructField("protocol_layer", _S),
        T.StructField("event_name", _S),
        T.StructField("severity", _S),
        T.StructField("raw_message", _S),
        T.StructField("normalized_message", _S),
        T.StructField("direction", _S),
        T.StructField("workflow_stage", _S),
        T.StructField("network_domain", _S),
        T.StructField("operator", _S),
        T.StructField("country", _S),
        T.StructField("result", _S),
        T.StructField("cause", _S),
        T.StructField("source_trace", _S),
        T.StructField("extracted_values", T.MapType(_S, _S)),
        T.StructField("tags", _STRINGS),
        T.StructField("evidences", _STRINGS),
        T.StructField("metadata", EVENT_METADATA),
    ]
)

CHUNK_SETS = [
    "event_names",
    "event_families",
    "severities",
    "causes",
    "operators",
    "countries",
    "network_domains",
    "tags",
]

CHUNK = T.StructType(
    [
        T.StructField("chunk_id", _S),
        T.StructField("trace_id", _S),
        T.StructField("testcase_id", _S),
        T.StructField("chunk_index", T.LongType()),
        T.StructField("text", _S),
        T.StructField("event_count", T.LongType()),
        T.StructField("event_ids", _STRINGS),
        *[T.StructField(name, _STRINGS) for name in CHUNK_SETS],
        T.StructField("source_trace", _S),
        T.StructField("source_result", _S),
        T.StructField("source_report", _S),
        T.StructField("has_high_severity", T.BooleanType()),
        T.StructField("has_failure", T.BooleanType()),
        T.StructField("has_retry_recommended", T.BooleanType()),
    ]
)
