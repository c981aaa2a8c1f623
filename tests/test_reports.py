"""Retry, health, prompt and investigation branches on hand-made chunks and events."""

import json

import pytest
from pyspark.sql import functions as F

from signalloom.operators import health, investigate as inv, prompts, retry
from signalloom.schemas import CHUNK, CHUNK_SETS


def chunk(i, **over):
    row = {f.name: None for f in CHUNK.fields}
    row.update({name: [] for name in CHUNK_SETS})
    row.update(chunk_id=f"t::chunk_{i}", trace_id="t", testcase_id="t", chunk_index=i, text="x", event_count=1,
               event_ids=[], has_failure=False, has_high_severity=False, has_retry_recommended=False)
    row.update(over)
    return tuple(row[f.name] for f in CHUNK.fields)


def chunks_of(spark, rows):
    return spark.createDataFrame(rows, CHUNK)


NEAR = "query_chunk_id string, rank int, chunk_id string, distance double"


def test_every_retry_outcome(spark):
    chunks = chunks_of(spark, [
        chunk(0, has_high_severity=True, has_failure=True),
        chunk(1, has_failure=True, causes=["TIMEOUT"]),
        chunk(2, has_failure=True, causes=["TIMEOUT"]),
        chunk(3, tags=["timeout"]),
        chunk(4, tags=["REJECT_SIGNAL"], has_failure=True),
        chunk(5, event_families=["registration"]),
        chunk(6, has_failure=True),
        chunk(7),
    ])
    near = [("t::chunk_1", r, "n", d) for r, d in ((1, 0.0), (2, 0.01), (3, 0.02), (4, None))]
    near += [("t::chunk_2", r, "n", 0.5) for r in (1, 2, 3)]
    rows = retry.retry_reports(chunks, spark.createDataFrame(near, NEAR)).orderBy("chunk_id").collect()
    assert [(r["retry_decision"], r["risk_level"], r["cooldown_minutes"]) for r in rows] == [
        ("escalate", "critical", None), ("do_not_retry", "high", None), ("retry_after_cooldown", "medium", 30),
        ("retry_after_cooldown", "medium", 30), ("escalate", "high", None), ("escalate", "high", None),
        ("retry", "low", 5), ("no_retry_needed", "none", None)]
    assert (rows[1]["historical_match_count"], rows[1]["average_distance"]) == (4, 0.01)
    assert (rows[7]["historical_match_count"], rows[7]["average_distance"]) == (0, 0.0)


def test_reportable_falls_back_to_all(spark):
    plain = chunks_of(spark, [chunk(0), chunk(1)])
    assert retry.reportable(plain).count() == 2
    mixed = chunks_of(spark, [chunk(0), chunk(1, has_failure=True), chunk(2, has_retry_recommended=True)])
    assert [r["chunk_index"] for r in retry.reportable(mixed).orderBy("chunk_index").collect()] == [1, 2]
    assert [r["chunk_index"] for r in retry.reportable(mixed, limit=1).collect()] == [1]


@pytest.mark.parametrize("sets,cluster", [
    ({"causes": ["PLMN_NOT_ALLOWED"]}, "Roaming registration rejection pattern"),
    ({"event_names": ["REJECT_SIGNAL"]}, "Roaming registration rejection pattern"),
    ({"event_families": ["timing"]}, "Timeout / instability pattern"),
    ({"event_names": ["DETACHED"]}, "Registration instability pattern"),
    ({"event_families": ["failure"], "severities": ["critical"]}, "Critical failure-heavy operational pattern"),
    ({"event_families": ["retry"]}, "Transient retry-heavy pattern"),
    ({}, "No dominant operational issue cluster detected"),
])
def test_every_issue_cluster(spark, sets, cluster):
    assert health.scored(chunks_of(spark, [chunk(0, **sets)])).first()["main_issue_cluster"] == cluster


def test_health_score_status_and_actions(spark):
    bad = chunks_of(spark, [chunk(0, has_failure=True, has_high_severity=True, has_retry_recommended=True)])
    row = health.scored(bad).first()
    assert (row["campaign_health_score"], row["campaign_status"]) == (0.4, "CRITICAL")
    assert row["recommended_action"].startswith("Stop automated retries")
    weak = chunks_of(spark, [chunk(0, has_high_severity=True)])
    row = health.scored(weak).first()
    assert (row["campaign_health_score"], row["campaign_status"]) == (0.7, "DEGRADED")
    assert row["recommended_action"].startswith("Continue monitoring")
    plmn = health.scored(chunks_of(spark, [chunk(0, causes=["PLMN_NOT_ALLOWED"])])).first()
    assert plmn["recommended_action"].startswith("Escalate to roaming")
    fine = chunks_of(spark, [chunk(0)])
    assert health.scored(fine).first()["recommended_action"].startswith("No immediate")
    for decision, text in (("do_not_retry", "Avoid repeated"), ("retry_after_cooldown", "Retry after cooldown")):
        reports = spark.createDataFrame([(decision,)], "retry_decision string")
        assert health.scored(fine, reports, "retry_decision").first()["recommended_action"].startswith(text)
        assert health.scored(fine, reports).first()["recommended_action"].startswith("No immediate")
    assert health.scored(fine.limit(0)).count() == 0


def test_dominant_values_break_ties_by_first_appearance(spark):
    chunks = chunks_of(spark, [chunk(0, operators=["z", "a"], severities=["low"]), chunk(1, operators=["a", "b"]),
                               chunk(2, operators=["b"])])
    row = health.campaign_health(chunks).first()
    assert [(p["value"], p["n"]) for p in row["dominant_operators"]] == [("a", 2), ("b", 2), ("z", 1)]
    assert row["severity_distribution"] == {"low": 1} and row["retry_decision_distribution"] == {}
    many = chunks_of(spark, [chunk(0, tags=[f"t{i:02d}" for i in range(30)], causes=[f"c{i:02d}" for i in range(30)])])
    row = health.campaign_health(many).first()
    assert (len(row["dominant_tags"]), len(row["dominant_causes"])) == (20, 10)


def test_prompt_metadata_is_json_and_neighbours_stop_where_asked(spark):
    chunks = chunks_of(spark, [chunk(0, text='say "hi"\n', event_names=["A", 'B"q'], has_failure=True), chunk(1)])
    near = spark.range(7).select(
        F.lit("t::chunk_0").alias("query_chunk_id"), (F.col("id") + 1).cast("int").alias("rank"),
        F.concat(F.lit("n"), "id").alias("chunk_id"),
        F.when(F.col("id") != 2, F.col("id") * F.lit(0.00005)).alias("distance"),
        F.struct(F.lit("A,B").alias("event_names"), F.lit(True).alias("has_failure")).alias("metadata"))
    every = prompts.summary_prompts(chunks, near, "Acme").orderBy("chunk_id").first()["prompt"]
    assert len(every.split("Similar historical chunks:\n")[1].split("\n\nReturn only")[0].splitlines()) == 7
    made = prompts.summary_prompts(chunks, near, "Acme", max_neighbours=5).orderBy("chunk_id").collect()
    first = made[0]["prompt"]
    assert first.startswith("Analyze this Acme telecom operational chunk.")
    payload = first.split("Chunk metadata:\n")[1].split("\n\nChunk evidence:")[0]
    expected = {name: made[0][name] for name in prompts.CHUNK_FIELDS}
    assert payload == json.dumps(expected, indent=2, ensure_ascii=False)
    lines = first.split("Similar historical chunks:\n")[1].split("\n\nReturn only")[0].splitlines()
    assert len(lines) == 5 and made[0]["similar_incident_count"] == 7
    for i, line in enumerate(lines):
        item = {"rank": i + 1, "chunk_id": f"n{i}", "distance": None if i == 2 else i * 0.00005, "event_names": "A,B"}
        item.update({name: None for name in prompts.NEIGHBOUR_FIELDS if name != "event_names"})
        item["has_failure"] = True
        assert line == json.dumps(item)
    assert prompts.NO_NEIGHBOURS["summary"] in made[1]["prompt"]
    assert prompts.NO_NEIGHBOURS["root_cause"] in prompts.root_cause_prompts(chunks, near).filter(
        "chunk_id = 't::chunk_1'").first()["prompt"]


def test_numbers_print_as_json(spark):
    values = [0.0, 0.5, 1e-4, 1.25e-4, 3e-7, 12345678.5, 1e7, 1.5e20, -2.5e-4, 123.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", prompts.json_number(F.col("v")).alias("s")).collect()
    assert {r["v"]: r["s"] for r in rows} == {v: json.dumps(v) for v in values}


EVENT = ("testcase_id string, seq long, operator string, country string, severity string, result string, "
         "event_family string, event_name string, cause string, raw_message string")


def test_investigation_fallbacks(spark):
    events = spark.createDataFrame(
        [("a", 1, "", None, "info", None, "generic", "X", None, "quiet")]
        + [("b", i, "op", "c", "medium", "failed", "timing", "TIMEOUT", "TIMEOUT", f"timeout {i}") for i in range(300)]
        + [("c", i, None, None, "info", None, "generic", "X", None, f"line {i}") for i in range(80)], EVENT)
    chunks = chunks_of(spark, [chunk(0, testcase_id="a", operators=[]), chunk(1, testcase_id="a", operators=["late"])])
    header = {r["testcase_id"]: r for r in inv.investigation_header(events, chunks).collect()}
    assert header["a"]["operator"] == "late" and header["b"]["operator"] == "op" and header["c"]["chunks"] == 0
    texts = {r["testcase_id"]: r for r in inv.diagnosis(inv.investigation_header(events, chunks)).collect()}
    assert texts["a"]["action"] == inv.ADVICE["chunks"] and texts["c"]["action"] == inv.ADVICE["none"]
    assert texts["b"]["action"] == inv.ADVICE["timeout"]
    assert texts["b"]["likely_cause"] == "Main detected cause: TIMEOUT"
    lines = inv.raw_evidence(events).groupBy("testcase_id").count().collect()
    assert {r["testcase_id"]: r["count"] for r in lines} == {"a": 1, "b": 300, "c": 80}
    lines = inv.raw_evidence(events, most=200, fallback=50).groupBy("testcase_id").count().collect()
    assert {r["testcase_id"]: r["count"] for r in lines} == {"a": 1, "b": 200, "c": 50}
    assert inv.raw_evidence(events, important_only=False).count() == 1 + 300 + 80
    assert inv.raw_evidence(events, important_only=False, most=70).count() == 1 + 70 + 70
    overview = {r["testcase_id"]: r for r in inv.testcase_overview(events).collect()}
    assert overview["b"]["failures"] == 300 and overview["a"]["operator"] == ""
    assert inv.of_testcase(events, "a").count() == 1


def test_a_bundle_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    from signalloom.sources import stages

    path = str(tmp_path / "out")
    tables = [spark.createDataFrame([(n,)], "v int") for n in range(4)]

    def values(run_id=None):
        found = stages.read_report_bundle(spark, path, run_id)
        return {n: [r["v"] for r in spark.read.json(folder).collect()] for n, folder in found.items()}

    with pytest.raises(FileNotFoundError):
        stages.read_report_bundle(spark, path)
    stages.write_report_bundle(path, "a", *tables)
    first = values()
    assert list(first) == list(stages.BUNDLE) and first == {n: [i] for i, n in enumerate(stages.BUNDLE)}
    # a run that ends after two tables
    whole = stages.export_json

    def halfway(df, where, **how):
        if "root_cause" in where:
            raise RuntimeError("lost")
        whole(df, where, **how)

    for run in ("b", "a"):
        with monkeypatch.context() as m:
            m.setattr(stages, "export_json", halfway)
            with pytest.raises(RuntimeError):
                stages.write_report_bundle(path, run, *tables[::-1])
        assert values() == values("a") == first
    stages.write_report_bundle(path, "b", *tables[::-1])
    stages.write_report_bundle(path, "a", *tables[1:], tables[0])
    assert values("b")["summaries"] == [2] and values()["summaries"] == values("a")["summaries"] == [2]
    assert values("a")["campaign_health"] == [1]
