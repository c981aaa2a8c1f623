"""Catalogue queries against their SQL.  SIGNALLOOM_ALL=1 runs every one of them."""

import os

import pytest
from compare import connect, difference

import __spark_entry__ as contract
from signalloom.plans import pipeline
from signalloom.plans import fixtures as fx
from signalloom.session import stage_folder

SF = "/root/testdata/sf0.001"
QUICK = ["testcase_id", "artifact_join", "line_explode", "signal_tags", "evidence_classify", "base_values",
         "mapping_regex", "mapping_time", "parser_errors", "event_normalize", "event_text_promoted",
         "chunk_bounds", "chunk_aggregate", "knn_self", "knn_join_filtered", "retry_report", "health_topk",
         "rca_prompt", "testcase_overview", "raw_evidence", "diagnosis_text", "storm_counts", "trace_csv_scan"]
KEYS = sorted(contract.oracle_sql()) if os.environ.get("SIGNALLOOM_ALL") else QUICK


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_sql(spark, duck, key):
    assert difference(contract.queries()[key](spark, SF), duck, contract.oracle_sql()[key]) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_pipeline_end_to_end(spark, tmp_path):
    data, out = str(tmp_path / "data"), str(tmp_path / "out")
    rows = fx.trace_rows(spark, SF)
    shared = os.path.dirname(stage_folder(spark)).removeprefix("file:")
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    events = pipeline.ingest(rows, data)
    tables = pipeline.analyse(events, data, k=3)
    # nothing staged on the way is left
    assert not {f for f in set(os.listdir(shared)) - before if f.startswith("stage-")}
    assert tables["neighbours"].count() == 3 * tables["chunks"].count()
    made = pipeline.report(spark, data, out, "run-1", decision_col="retry_decision")
    row = made["health"].first()
    assert row["total_chunks"] == made["retry_reports"].count() > 0
    assert sum(row["retry_decision_distribution"].values()) == row["total_chunks"]
    assert spark.read.json(f"{out}/summaries").filter("run_id = 'run-1'").count() == row["total_chunks"]
