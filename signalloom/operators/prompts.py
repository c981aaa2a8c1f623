"""Prompt tables for downstream language models, and the join of their answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

CUT_MARK = "\n...[truncated]"

# Chunk fields shown in a prompt, in order.
CHUNK_FIELDS = ["chunk_id", "trace_id", "testcase_id", "event_count", "event_names", "event_families",
                "severities", "causes", "operators", "countries", "network_domains", "tags",
                "has_failure", "has_high_severity", "has_retry_recommended"]

# Neighbour metadata shown in a summary prompt, in order.
NEIGHBOUR_FIELDS = ["event_names", "event_families", "causes", "countries", "operators", "network_domains",
                    "has_failure", "has_high_severity", "has_retry_recommended"]

# Prompt texts.  ``{product}`` is the caller's product name.
NO_NEIGHBOURS = {"summary": "No similar historical chunks provided.",
                 "root_cause": "No similar historical incidents provided."}
OPENING = "Analyze this {product} telecom operational chunk.\n\nChunk metadata:\n"
EVIDENCE_TITLE = {"summary": "\n\nChunk evidence:\n", "root_cause": "\n\nTrace evidence:\n"}
NEIGHBOUR_TITLE = {"summary": "\n\nSimilar historical chunks:\n",
                   "root_cause": "\n\nSimilar historical incidents:\n"}
CLOSING = {
    "summary": (
        "\n\nReturn only this structure:\n\nOperational summary:\n- \n\nFailure indicators:\n- \n\n"
        "Retry relevance:\n- \n\nSimilarity observations:\n- \n\nRecommended next checks:\n- \n\n"
        "Confidence:\n- high / medium / low with short reason"
    ),
    "root_cause": (
        "\n\nReturn the analysis with these sections:\n\n1. Probable root cause\n2. Evidence from trace\n"
        "3. Similar historical patterns\n4. Confidence level: low / medium / high\n"
        "5. What to inspect next\n6. Retry recommendation: retry / wait / do not retry / escalate"
    ),
}


def json_number(value: Column) -> Column:
    """A double in shortest decimal form, with an exponent only outside 1e-4 .. 1e16."""
    text = value.cast("string")
    mantissa, power = F.substring_index(text, "E", 1), F.substring_index(text, "E", -1).try_cast("int")
    sign = F.when(mantissa.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    plain = F.regexp_replace(mantissa, r"^-|\.0$", "")
    digits = F.replace(plain, F.lit("."), F.lit(""))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    whole = F.rpad(digits, power + 1, F.lit("0"))
    fraction = F.substr(digits, power + 2)
    large = F.concat(
        sign, F.substr(whole, F.lit(1), power + 1), F.lit("."),
        F.when(F.length(digits) > power + 1, fraction).otherwise(F.lit("0")),
    )
    far = F.concat(
        sign, plain, F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.lpad(F.abs(power).cast("string"), 2, "0"),
    )
    return (
        F.when(~text.contains("E"), text)
        .when(power.between(-4, -1), small)
        .when(power.between(7, 15), large)
        .otherwise(far)
    )


def _json_string(value: Column) -> Column:
    quoted = F.to_json(F.array(value))
    return F.substr(quoted, F.lit(2), F.length(quoted) - 2)


def json_value(value: Column, kind: T.DataType, indent: str | None = None) -> Column:
    """A column as JSON text; ``indent`` spreads arrays over lines."""
    if isinstance(kind, T.ArrayType):
        opening, comma, end = ("[", ", ", "]") if indent is None else (
            f"[\n{indent}  ", f",\n{indent}  ", f"\n{indent}]"
        )
        items = F.array_join(F.transform(value, _json_string), comma)
        shown = F.when(F.size(value) == 0, F.lit("[]")).otherwise(F.concat(F.lit(opening), items, F.lit(end)))
    elif isinstance(kind, T.StringType):
        shown = _json_string(value)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        shown = json_number(value.cast("double"))
    else:
        shown = value.cast("string")
    return F.when(value.isNull(), F.lit("null")).otherwise(shown)


def json_object(parts: list[tuple[str, Column]], indent: bool = False) -> Column:
    """Key and JSON-text pairs as one object."""
    opening, comma, end = ("{\n  ", ",\n  ", "\n}") if indent else ("{", ", ", "}")
    pairs = [F.concat(F.lit(f'"{name}": '), text) for name, text in parts]
    return F.concat(F.lit(opening), F.concat_ws(comma, *pairs), F.lit(end))


def chunk_metadata(chunks: DataFrame) -> Column:
    kinds = {f.name: f.dataType for f in chunks.schema.fields}
    return json_object(
        [(name, json_value(F.col(name), kinds[name], indent="  ")) for name in CHUNK_FIELDS], indent=True
    )


def neighbour_context(neighbours: DataFrame, style: str = "summary", most: int | None = None) -> DataFrame:
    """The neighbours of each chunk as JSON lines, nearest first, and how many there are.

    ``neighbours`` carries ``query_chunk_id``, ``rank``, ``chunk_id``, ``distance`` and a
    ``metadata`` struct; a chunk has as many as the search was asked for.  ``most`` shows the
    nearest ones only.
    """
    fields = neighbours.schema["metadata"].dataType
    meta = F.col("metadata")
    if style == "summary":
        known = {f.name: f.dataType for f in fields.fields}
        tail = [
            (name, json_value(meta[name], known[name]) if name in known else F.lit("null"))
            for name in NEIGHBOUR_FIELDS
        ]
    else:
        inner = json_object([(f.name, json_value(meta[f.name], f.dataType)) for f in fields.fields])
        tail = [("metadata", inner)]
    kind = neighbours.schema["chunk_id"].dataType
    line = json_object(
        [
            ("rank", F.col("rank").cast("string")),
            ("chunk_id", json_value(F.col("chunk_id"), kind)),
            ("distance", json_value(F.col("distance"), T.DoubleType())),
            *tail,
        ]
    )
    shown = F.struct("rank", line.alias("line"))
    if most is not None:
        shown = F.when(F.col("rank") <= most, shown)
    return neighbours.groupBy(F.col("query_chunk_id").alias("chunk_id")).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(shown)), lambda r: r["line"]), "\n"
        ).alias("neighbour_text"),
        F.count(F.lit(1)).alias("similar_incident_count"),
    )


def _prompts(
    chunks: DataFrame, neighbours: DataFrame, style: str, limit: int | None, product: str, max_chunks: int | None,
    max_neighbours: int | None,
) -> DataFrame:
    picked = chunks.orderBy("testcase_id", "chunk_index").limit(max_chunks) if max_chunks else chunks
    joined = picked.join(neighbour_context(neighbours, style, max_neighbours), "chunk_id", "left")
    return joined.select(
        *picked.columns,
        F.coalesce("similar_incident_count", F.lit(0)).alias("similar_incident_count"),
        F.concat(
            F.lit(OPENING.replace("{product}", product)),
            chunk_metadata(picked),
            F.lit(EVIDENCE_TITLE[style]),
            tx.cut_text(F.col("text"), limit, CUT_MARK, trim=style == "summary"),
            F.lit(NEIGHBOUR_TITLE[style]),
            F.coalesce(tx.blank_to_null(F.col("neighbour_text")), F.lit(NO_NEIGHBOURS[style])),
            F.lit(CLOSING[style]),
        ).alias("prompt"),
    )


def summary_prompts(
    chunks: DataFrame, neighbours: DataFrame, product: str = "roaming",
    max_chunks: int | None = None, max_chars: int | None = None, max_neighbours: int | None = None,
) -> DataFrame:
    """Chunks with the prompt that asks for an operational summary."""
    return _prompts(chunks, neighbours, "summary", max_chars, product, max_chunks, max_neighbours)


def root_cause_prompts(
    chunks: DataFrame, neighbours: DataFrame, product: str = "roaming",
    max_chunks: int | None = None, max_chars: int | None = None, max_neighbours: int | None = None,
) -> DataFrame:
    """Chunks with the prompt that asks for a root-cause hypothesis."""
    return _prompts(chunks, neighbours, "root_cause", max_chars, product, max_chunks, max_neighbours)


# Chunk fields kept next to an answer, in order.
ANSWER_FIELDS = {
    "summary": ["event_count", "event_names", "event_families", "severities", "causes", "operators",
                "countries", "network_domains", "has_failure", "has_high_severity",
                "has_retry_recommended"],
    "root_cause_analysis": ["event_names", "event_families", "causes", "operators", "countries",
                            "network_domains", "severities", "tags"],
}


def answered(prompts: DataFrame, answers: DataFrame, kind: str = "summary") -> DataFrame:
    """Prompted chunks with the model's text: ``answers`` holds ``chunk_id`` and ``answer``."""
    joined = prompts.join(answers.select("chunk_id", tx.strip(F.col("answer")).alias(kind)), "chunk_id")
    return joined.select(
        "chunk_id", "trace_id", "testcase_id", kind, *ANSWER_FIELDS[kind], "similar_incident_count"
    )
