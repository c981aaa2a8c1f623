"""Records that byte splits cut in two: equal to what one task reads."""

import csv
import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.schemas import TRACE_COLUMNS
from signalloom.sources import splits, stages, traces

HEADER = ";".join(TRACE_COLUMNS)


@pytest.fixture
def small_splits(spark):
    """Splits of a few hundred bytes, so that short files have many and records span several."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def trace_text(rng, n, newline):
    out = io.StringIO()
    writer = csv.writer(out, delimiter=";", lineterminator=newline)
    bits = ["plain", "", 'a "quoted" word', "semi;colon", f"line{newline}break", f'"{newline}"', f"{newline}{newline}", "x" * 90, "é日本", '";']
    for i in range(n):
        writer.writerow([str(i), *["".join(rng.choice(bits, rng.integers(0, 4))) for _ in range(5)]])
    # quotes inside of a field that does not begin with one, and text after a closing quote
    out.write(f'{n};a"b;c"{newline}')
    out.write(f'{n + 1};"a"b;"x"" y";;;end{newline}')
    out.write(newline)
    out.write(f'{n + 2};"{"long " * 400}{newline}{"and longer " * 200}";z{newline}')
    return out.getvalue()


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_quoted_files_equal_the_one_task_reader(spark, tmp_path, small_splits, newline):
    rng = np.random.default_rng(4)
    for i in range(3):
        (tmp_path / f"trace_35000000{i}_0.csv").write_text(HEADER + newline + trace_text(rng, 60 + i, newline), newline="")
    (tmp_path / "trace_350000009_0.csv").write_text(HEADER + newline, newline="")
    lines = splits._segments(spark, str(tmp_path), "\n")
    assert lines.select("file_path", "start").distinct().count() > 60
    columns = ["testcase_id", *TRACE_COLUMNS, "source_trace"]
    want = traces.read_traces(spark, str(tmp_path)).orderBy("source_trace", "seq").select(*columns).collect()
    got = traces.read_traces_any_header(spark, str(tmp_path)).orderBy("source_trace", "seq").select(*columns).collect()
    assert got == want and len(got) == 3 * 60 + 3 + 9


def test_an_open_quote_runs_to_the_end_of_its_file(spark, tmp_path, small_splits):
    (tmp_path / "trace_350000001_0.csv").write_text(HEADER + '\n1;a\n2;"never closed\n' + "3;b\n" * 200)
    (tmp_path / "trace_350000002_0.csv").write_text(HEADER + "\n4;c")
    rows = traces.read_traces_any_header(spark, str(tmp_path)).orderBy("source_trace", "seq").collect()
    assert [r["Timestamp"] for r in rows] == ["1", "2", "4"]
    assert rows[1]["CallId"].startswith("never closed\n3;b\n3;b")


def test_lines_and_their_states():
    lines = splits.QuotedLines(";")
    for line, outside, inside in [
        ("a;b", False, True), ('a;"b', True, False), ('"a";"b"', False, False), ('"a""', True, False), ('a"b', False, False),
        ('";', True, False), ('x";"y', True, True), ('"a"b"c;"d', True, True), ("", False, True), ('"', True, False), ('""', False, True),
    ]:
        assert lines.after(line, False) == outside, line
        # a line that begins in quotes goes on as if the field had begun at its start
        assert lines.after(line, True) == lines.after('"' + line, False) == inside, line


def nested(rng, i):
    value = rng.choice(['x,"y"', "a\\", '\\"', "[{", "}]", "é,", "", "long, " * 60])
    return {"event_id": f"e-{i}", "event_name": str(value), "tags": [str(value), "b"][: int(rng.integers(0, 3))], "extracted_values": {"k,": str(value)}}


@pytest.mark.parametrize("layout", [{}, {"indent": 2}, {"separators": (",", ":")}])
def test_arrays_equal_a_json_parser(spark, tmp_path, small_splits, layout):
    rng = np.random.default_rng(9)
    files = {str(n): [nested(rng, i) for i in range(n)] for n in (0, 1, 2, 150)}
    for name, rows in files.items():
        (tmp_path / f"{name}_events.json").write_text(" " + json.dumps(rows, ensure_ascii=False, **layout) + "\n")
    got = {}
    for r in stages.read_event_files(spark, str(tmp_path)).orderBy("testcase_id", "seq").collect():
        got.setdefault(r["testcase_id"], []).append(r)
    assert got.keys() == {"1", "2", "150"}
    for name, rows in got.items():
        assert [r["seq"] for r in rows] == list(range(1, int(name) + 1))
        for r, w in zip(rows, files[name]):
            assert (r["event_id"], r["event_name"], r["tags"], r["extracted_values"]) == (w["event_id"], w["event_name"], w["tags"], w["extracted_values"])


def test_objects_and_foreign_files(spark, tmp_path, small_splits):
    (tmp_path / "1_events.json").write_text('{"event_id": "1-0001", "tags": ["a", "b"], "event_name": "A"}')
    (tmp_path / "2_events.json").write_text(json.dumps([{"other": "x" * 40, "n": [1, 2]}] * 30))
    rows = stages.read_event_files(spark, str(tmp_path)).collect()
    assert [(r["testcase_id"], r["seq"], r["event_id"], r["tags"]) for r in rows] == [("1", 1, "1-0001", ["a", "b"])]


def test_a_hot_key_is_exported_in_parts(spark, tmp_path):
    # half of all rows have one key
    n = 3000
    rows = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("testcase_id"),
        F.concat(F.lit("e"), "id").alias("event_id"), F.lit("a, [b").alias("event_name"), (F.col("id") * 7 % n).alias("seq"),
    )
    stages.export_arrays(rows.repartition(5), str(tmp_path / "out"), "testcase_id", "seq", part_rows=100)
    case = F.regexp_extract("file_path", r"testcase_id=(\w+)", 1)
    read = stages.read_event_files(spark, str(tmp_path / "out"), case).select("testcase_id", "seq", "event_id").collect()
    want = {}
    for i in sorted(range(n), key=lambda i: i * 7 % n):
        want.setdefault("hot" if i % 2 == 0 else str(i % 50), []).append(f"e{i}")
    got = {k: [e for _, e in sorted((r["seq"], r["event_id"]) for r in read if r["testcase_id"] == k)] for k in want}
    assert got == want and len(read) == n
    sizes = [len(json.loads(p.read_text())) for p in (tmp_path / "out" / "testcase_id=hot").rglob("part-*.txt")]
    assert sizes == [100] * 15
    assert {r["seq"] for r in read if r["testcase_id"] == "hot"} == set(range(1, 1501))
