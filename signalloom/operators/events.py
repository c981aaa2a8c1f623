"""Evidence to operational events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as tx
from ..session import BLOCK_ROWS
from .ordering import with_position


def event_name(category: str) -> Column:
    renamed = {new: (old,) for old, new in rules.RENAMED_EVENTS.items()}
    return tx.pick(category, renamed, f"upper({category})")


def event_family(evidence_type: str) -> Column:
    groups: dict = {}
    for kind, family in rules.FAMILY_OF_TYPE.items():
        groups.setdefault(family, []).append(kind)
    return tx.pick(evidence_type, groups, "'generic'")


def event_severity(category: str, own: str) -> Column:
    return tx.pick(category, rules.SEVERITY_OF_CATEGORY, f"coalesce(nullif({own}, ''), 'info')")


def event_cause(category: str) -> Column:
    return tx.pick(category, {cause: (cat,) for cat, cause in rules.CAUSE_OF_CATEGORY.items()})


def workflow_stage(category: str) -> Column:
    return tx.pick(category, rules.STAGE_OF_CATEGORY, "'trace_analysis'")


def network_domain(evidence_type: str, category: str) -> Column:
    roaming = F.col(evidence_type).isin(*rules.ROAMING_TYPES)
    connectivity = F.col(category).isin(*rules.CONNECTIVITY_CATEGORIES)
    return F.when(roaming, "roaming").when(connectivity, "connectivity").otherwise("unknown")


def direction(line: str) -> Column:
    sent = tx.contains_any(f"lower({line})", ("send", "-->"))
    received = tx.contains_any(f"lower({line})", ("recv", "<--", "received"))
    return F.expr(f"CASE WHEN {sent} THEN 'send' WHEN {received} THEN 'receive' END")


def event_result(category: str) -> Column:
    return tx.pick(category, rules.RESULT_OF_CATEGORY)


def event_tags(evidence_type: str, category: str, layer: str, severity: str) -> Column:
    """Sorted distinct labels; the severity is the evidence's own, before any override."""
    labels = f"array({evidence_type}, {category}, lower(nullif({layer}, '')), nullif({severity}, ''))"
    return F.expr(f"array_sort(array_distinct(array_compact({labels})))")


def recommendation(category: str) -> Column:
    return tx.pick(category, rules.RECOMMENDATION_OF_CATEGORY)


def retry_recommended(category: str) -> Column:
    return F.col(category).isin(*rules.RETRYABLE_CATEGORIES)


def event_message(name: str, cause: str, value: str, operator: str, country: str) -> Column:
    return F.expr(
        f"concat({name}, ' detected for operator=', coalesce({operator}, 'unknown_operator'), "
        f"', country=', coalesce({country}, 'unknown_country'), "
        f"CASE WHEN {cause} IS NULL THEN '' ELSE concat(', cause=', {cause}) END, "
        f"', value=', coalesce(nullif({value}, ''), 'unknown'))"
    )


def normalise(
    evidence: DataFrame,
    values: DataFrame,
    promote_metadata: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Operational events: evidence numbered within its trace, with trace values joined on.

    ``promote_metadata`` also puts the recommendation and the retry flag at the event's
    top level; by default they stay in ``metadata`` only, where later stages ignore them.
    """
    per_trace = values.select("testcase_id", "extracted_values")
    numbered = with_position(
        evidence, "testcase_id", "seq", "event_index", per_key=per_trace, block_rows=block_rows
    )
    event_id = F.format_string("%s-%04d", F.col("testcase_id"), F.col("event_index"))
    events = event_columns(numbered, event_id)
    return promote(events) if promote_metadata else events


def event_columns(evidence: DataFrame, event_id: Column) -> DataFrame:
    """Events from evidence that carries ``extracted_values``; a projection, no shuffle."""
    category, kind = "category", "evidence_type"
    found = F.coalesce(F.col("extracted_values"), F.expr("cast(map() as map<string,string>)"))
    staged = (
        evidence.withColumn("extracted_values", found)
        .withColumn("operator", F.try_element_at(F.col("extracted_values"), F.lit("operator")))
        .withColumn("country", F.try_element_at(F.col("extracted_values"), F.lit("country")))
        .withColumn("event_name", event_name(category))
        .withColumn("cause", event_cause(category))
    )
    advice, again = recommendation(category), retry_recommended(category)
    return staged.select(
        "testcase_id",
        event_id.alias("event_id"),
        "seq",
        *(["event_index"] if "event_index" in evidence.columns else []),
        "timestamp",
        event_family(kind).alias("event_family"),
        F.expr("coalesce(nullif(protocol_layer, ''), 'unknown')").alias("protocol_layer"),
        "event_name",
        event_severity(category, "severity").alias("severity"),
        F.col("source_line").alias("raw_message"),
        event_message("event_name", "cause", "value", "operator", "country").alias("normalized_message"),
        direction("source_line").alias("direction"),
        workflow_stage(category).alias("workflow_stage"),
        network_domain(kind, category).alias("network_domain"),
        "operator",
        "country",
        event_result(category).alias("result"),
        "cause",
        "source_trace",
        "extracted_values",
        event_tags(kind, category, "protocol_layer", "severity").alias("tags"),
        F.array("source_line").alias("evidences"),
        F.struct(
            kind,
            F.col(category).alias("evidence_category"),
            F.col("value").alias("evidence_value"),
            "confidence",
            "metric_name",
            "event_code",
            "source_event",
            "source_type",
            advice.alias("recommendation"),
            again.alias("retry_recommended"),
        ).alias("metadata"),
    )


def promote(events: DataFrame) -> DataFrame:
    """Copy the recommendation and retry flag from ``metadata`` to the top level."""
    return events.withColumn("recommendation", F.col("metadata.recommendation")).withColumn(
        "retry_recommended", F.col("metadata.retry_recommended")
    )
