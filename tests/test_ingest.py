"""Trace files to events on small hand-written traces."""

import pytest
from pyspark.sql import functions as F

from signalloom.functions import text as tx
from signalloom.functions.rules import EVIDENCE_RULES
from signalloom.operators import evidence as evd
from signalloom.operators.events import normalise
from signalloom.operators.ordering import with_position
from signalloom.sources import artifacts, stages, traces

HEADER = "Timestamp;CallId;Ptc;Event;Type;Information\n"


def rows_of(spark, infos, case="350000001"):
    data = [(case, i + 1, "2026-06-26 04:57:28.413", "0", "PTC_A", "PRS", "T", info) for i, info in enumerate(infos)]
    return spark.createDataFrame(
        data, "testcase_id string, seq long, Timestamp string, CallId string, Ptc string, Event string, "
        "Type string, Information string")


def test_trace_file_gives_evidence_in_file_order(spark, tmp_path):
    (tmp_path / "Trace-360000777_b.csv").write_text(
        HEADER
        + "2025-01-31 23:59:59.000001;7;PTC_B;SMS;kind;Delivery Error: 'expired' (failed)\n"
        + "2025-01-31 23:59:59.5;8;PTC_B;SMS;kind;nothing to see\n"
        + "2025-02-01 00:00:01.25;8;PTC_B;SMS;kind;second retransmission\n"
        + "2025-02-01 00:00:02.75;9;;SMS;;modem says nasnotregistered\n"
    )
    rows = traces.read_traces(spark, str(tmp_path))
    found = evd.classify(rows).orderBy("seq").collect()
    assert [r["category"] for r in found] == ["failure_signal", "retry_detected", "nas_not_registered"]
    assert found[0]["value"] == "expired' (failed)"
    assert found[2]["source_line"] == "2025-02-01 00:00:02.75;9;;SMS;;modem says nasnotregistered"
    assert {r["testcase_id"] for r in found} == {"360000777"}
    assert evd.raw_signals(evd.classify(rows)).count() == 3


def test_quoted_fields_keep_separators_and_line_breaks(spark, tmp_path):
    (tmp_path / "trace_350000123_0.csv").write_text(
        HEADER + '<null>;;PTC_A;E;T;"a ""timeout""; b\nsecond line"\n2026-6-1 4:5:6.7;1;P;E\n'
    )
    rows = traces.read_traces(spark, str(tmp_path)).orderBy("seq").collect()
    assert rows[0]["Information"] == 'a "timeout"; b\nsecond line'
    assert rows[1]["Information"] is None
    shown = traces.read_traces(spark, str(tmp_path)).select(tx.clock(F.col("Timestamp")).alias("t"), "seq")
    clocks = [r["t"] for r in shown.orderBy("seq").collect()]
    assert clocks[0] is None and clocks[1].isoformat() == "2026-06-01T04:05:06.700000"


def test_split_reading_keeps_file_order(spark, tmp_path):
    lines = [f"2026-06-26 04:57:28.413;{i};P;E;T;row {i}" for i in range(5000)]
    (tmp_path / "trace_350000123_0.csv").write_text(HEADER + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        rows = traces.read_traces(spark, str(tmp_path), split_files=True).select("seq", "CallId").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 5000 and len({r["seq"] for r in rows}) == 5000
    assert [int(r["CallId"]) for r in sorted(rows, key=lambda r: r["seq"])] == list(range(5000))


def test_columns_bind_by_name_when_headers_differ(spark, tmp_path):
    (tmp_path / "trace_350000001_0.csv").write_text(HEADER + "t;0;P;E;T;timeout\n")
    (tmp_path / "trace_350000002_0.csv").write_text(
        "Information;Timestamp;CallId;Ptc;Event;Type\ntimeout;t;0;P;E;T\n"
    )
    rows = traces.read_traces_any_header(spark, str(tmp_path)).collect()
    assert {(r["testcase_id"], r["Information"], r["Timestamp"]) for r in rows} == {
        ("350000001", "timeout", "t"), ("350000002", "timeout", "t")
    }


def test_plain_comma_traces(spark, tmp_path):
    (tmp_path / "trace_350000001_0.csv").write_text('A,B,C\n1,"x,y\n2\nA,B,C\n')
    rows = traces.read_plain_traces(spark, str(tmp_path), ["A", "B", "C"]).orderBy("seq").collect()
    # only the first line is a header; a later line like it is a row
    assert [(r["A"], r["B"], r["C"]) for r in rows] == [("1", '"x', "y"), ("2", None, None), ("A", "B", "C")]


def test_plain_columns_bind_by_name(spark, tmp_path):
    (tmp_path / "trace_350000001_0.csv").write_text("C, A\nc1,a1\n")
    rows = traces.read_plain_traces(spark, str(tmp_path), ["A", "B", "C"]).collect()
    assert [(r["A"], r["B"], r["C"]) for r in rows] == [("a1", None, "c1")]


def test_split_plain_files_keep_positions_apart(spark, tmp_path):
    lines = [f"{i},row {i}" for i in range(20_000)]
    (tmp_path / "trace_350000001_0.csv").write_text("n,text\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        rows = traces.read_plain_traces(spark, str(tmp_path), ["n", "text"]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({r["seq"] for r in rows}) == 20_000
    assert [int(r["n"]) for r in sorted(rows, key=lambda r: r["seq"])] == list(range(20_000))


def test_one_file_counts_per_testcase(spark, tmp_path):
    for name, text in (("trace_350000001_0.csv", "old"), ("trace_350000001_1.csv", "new"), ("trace_350000002_0.csv", "only")):
        (tmp_path / name).write_text(HEADER + "".join(f"t;{i};P;E;T;{text} timeout\n" for i in range(3)))
    rows = traces.read_traces(spark, str(tmp_path))
    one = traces.one_file_per_testcase(rows)
    assert {r["Information"] for r in one.collect()} == {"new timeout", "only timeout"}
    assert one.select("testcase_id", "seq").distinct().count() == one.count() == 6
    picked = artifacts.discover(spark, str(tmp_path), *[str(tmp_path)] * 3).select("testcase_id", F.regexp_replace("trace_path", "_1.csv", "_0.csv").alias("trace_path"))
    assert {r["Information"] for r in traces.one_file_per_testcase(rows, picked).collect()} == {"old timeout", "only timeout"}


def test_too_many_kinds_of_header_are_an_error(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"trace_35000000{i}_0.csv").write_text(f"junk{i};x\na;b\n")
    with pytest.raises(ValueError):
        traces.read_traces_any_header(spark, str(tmp_path), max_headers=3)


def test_mapping_keeps_traces_without_lines(spark):
    rows = rows_of(spark, ["ab; c"]).unionByName(rows_of(spark, [None, ""], "350000002"))
    values = evd.trace_values(rows, [{"value": "ab"}], every_trace=True).collect()
    assert {r["testcase_id"]: r["extracted_values"] for r in values} == {"350000001": {"ab": "ab; c"}, "350000002": {}}


def test_clock_rules():
    rule = evd.MappingEntry("time( PTC_A.Start , h:m:s)")
    assert (rule.param, rule.fmt) == ("PTC_A.Start", "h:m:s")
    for wrong in ("time(PTC_A.Start", "time(PTC_A.Start)", "(;"):
        with pytest.raises(Exception):
            evd.MappingEntry(wrong)


def test_every_rule_and_its_priority(spark):
    infos = [rule.keywords[0].upper() for rule in EVIDENCE_RULES] + ["plmn not allowed, timeout, fail", "nothing", None]
    found = evd.classify(rows_of(spark, infos)).orderBy("seq").collect()
    assert [r["category"] for r in found][:13] == [
        "plmn_not_allowed", "location_update_failed", "location_update_reject", "location_update_request",
        "registration_denied", "nas_registered", "nas_not_registered", "ps_attached", "detached", "timeout",
        "retry_detected", "failure_signal", "reject_signal",
    ]
    assert [r["category"] for r in found][13:] == ["plmn_not_allowed"]


def test_base_values_take_the_first_assignment_in_row_order(spark):
    rows = rows_of(spark, ["PTC_A.Plmn", "PTC_A.Plmn = 'one';x", "PTC_A.Country = \"sa\"", "PTC_A.Plmn = two",
                           "PTC_A.Imsi=PTC_A.Msisdn"])
    values = evd.base_values(rows).select(F.explode("extracted_values")).collect()
    assert [tuple(r) for r in values] == [("operator", "one"), ("country", "sa"), ("imsi", "PTC_A.Msisdn"),
                                          ("msisdn", "PTC_A.Msisdn")]


def test_mapping_overrides_extends_and_reports_errors(spark):
    rows = rows_of(spark, ["PTC_A.Plmn = 'one'", "Start; DATETIME(9999999999999999)", "ab; c"])
    mapping = [{"value": "ab"}, {"value": "time(Start,hour)"}, {"value": "("}, {"value": None}]
    row = evd.trace_values(rows, mapping).first()
    assert row["extracted_values"] == {"operator": "one", "ab": "ab; c"}
    assert row["time_values"] == {}
    assert sorted(e.split(":")[1] for e in row["parser_errors"]) == ["(", "time(Start,hour)"]


def test_event_from_one_evidence(spark):
    rows = rows_of(spark, ["PTC_A.Plmn = 'mobily'", "PTC_A.Country = 'sa'", "TSP_Verdict = 'FAIL'"], "123")
    event = normalise(evd.classify(rows), evd.trace_values(rows)).first()
    assert (event["event_id"], event["event_name"], event["event_family"], event["result"]) == (
        "123-0001", "FAILURE_SIGNAL", "failure", "failed")
    assert (event["operator"], event["country"]) == ("mobily", "sa")
    assert "failure_signal" in event["tags"]
    assert event["normalized_message"] == (
        "FAILURE_SIGNAL detected for operator=mobily, country=sa, value=FAIL")


def test_event_ids_beyond_four_digits_and_across_blocks(spark):
    rows = spark.range(10_050).select(F.lit("t").alias("testcase_id"), (F.col("id") * 3).alias("seq"))
    placed = with_position(rows, block_rows=1000)
    assert placed.filter("event_index != seq / 3 + 1").count() == 0
    ids = placed.select(F.format_string("%s-%04d", "testcase_id", "event_index").alias("e"))
    assert ids.filter("e in ('t-0001', 't-9999', 't-10000', 't-10050')").count() == 4


def test_discovery(spark, tmp_path):
    for name in ("traces/trace_350000001_0.csv", "traces/trace_350000001_1.csv", "traces/trace_999000001.csv",
                 "results/Result-350000001.zip", "reports/r_350000001_x.xlsx", "templates/b.xlsx", "templates/a.xlsx"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    found = {
        r["testcase_id"]: r
        for r in artifacts.discover(spark, *[str(tmp_path / d) for d in ("traces", "results", "reports", "templates")])
        .collect()
    }
    assert set(found) == {"350000001", "999000001"}
    one = found["350000001"]
    assert one["trace_path"].endswith("trace_350000001_1.csv") and one["result_path"].endswith(".zip")
    assert one["template_path"].endswith("a.xlsx") and one["campaign_name"] == "GSMA_IR38"
    assert found["999000001"]["result_path"] is None and found["999000001"]["template_name"] == "UNKNOWN"


def test_event_array_files(spark, tmp_path):
    (tmp_path / "42_events.json").write_text(
        '[{"event_id": "42-0001", "event_name": "A", "timestamp": "x"},\n {"event_id": "42-0002", "event_name": "B"}]')
    (tmp_path / "43_events.json").write_text('{"other": 1}')
    rows = stages.read_event_files(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r["testcase_id"], r["event_id"]) for r in rows] == [("42", "42-0001"), ("42", "42-0002")]


def _values(rows, mapping, **how):
    found = evd.trace_values(rows, mapping, **how).collect()
    return sorted(
        (r["testcase_id"], list((r["extracted_values"] or {}).items()), [(k, list(v.items())) for k, v in r["time_values"].items()], r["parser_errors"])
        for r in found
    )


def test_large_mappings_equal_one_by_one(spark, monkeypatch):
    lines = [
        "PTC_A.Plmn = 'one'", "Start; DATETIME(1750000000000)", "ab; c", "xab; d = 'e,f';g", "Start: DATETIME(9999999999999999)",
        "a.b;c", "aXb;no", "End: DATETIME = 1750000001234", "End; nothing", "", None, "abc;", "abbc; x", "q; 1", "time", "é; ü",
    ]
    rows = rows_of(spark, lines).unionByName(rows_of(spark, lines[::-1], "350000002")).unionByName(rows_of(spark, [None], "350000003"))
    mapping = [{"value": v} for v in (
        "ab", "a.b", "time(Start,hour)", "time(Start, h:m:s)", "time(End,min)", "(", None, "ab+c;", "^q;\\s*(.+)", "x?ab;.*", "é", "nothing|time;", "ab", "time(", "abc?;",
    )]
    want = _values(rows, mapping)
    monkeypatch.setattr(evd, "MANY_ENTRIES", 0)
    assert _values(rows, mapping) == want
    assert want[0][1] and want[0][2] and want[0][3]
    assert _values(rows, mapping, time_change="+02:30") != want


def test_required_text_is_required():
    for spec, text in [("a.b", "a.b"), ("ab+c;", "a"), ("x?ab;", None), ("ab*", "a"), ("(a)b;", None), ("^q;", None), ("a|b;", None), ("PTC_A.X y;z", "PTC_A"), ("X y", "X y")]:
        assert evd.MappingEntry(spec).required() == (text if text != "" else None), spec


def test_a_thousand_entries(spark):
    rows = rows_of(spark, [f"name{i % 1500}x; value {i}" for i in range(3000)])
    values = evd.trace_values(rows, [{"value": f"name{i}x"} for i in range(1000)]).first()["extracted_values"]
    assert values == {f"name{i}x": f"name{i}x; value {i}" for i in range(1000)}
