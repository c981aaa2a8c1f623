import hashlib
from collections import defaultdict

import pytest
from compare import connect, difference

from signalloom.llm import line_runs
from signalloom.llm.catalogue import ORACLE, QUERIES


def by_hand(rows, min_chars=20, min_docs=3):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    held = defaultdict(set)
    low = -(1 << 63)
    for i, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(low if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and max(held[key(x)]) != (low if i is None else i))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    rows = df.select("doc_id", "__n_lines", "__n_dropped", "__kept").collect()
    return sorted(((r[0], r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest()) for r in rows), key=repr)


def test_query_equals_sql(spark, small):
    assert difference(QUERIES["op3_line_dedup"](spark, small), connect(small), ORACLE["op3_line_dedup"]) is None


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_batches_and_levels_change_nothing(spark, batches):
    shared = ["A Line that Several documents share", "  another shared line of enough length\t", "short", "ünïcode lïne that is shared by some"]
    rows = [(i, "\n".join([f"own line number {i} is here once", *shared[: i % 5], shared[i % 4].upper(), ""])) for i in range(40)]
    rows += [(3, "A line that several documents share"), (None, "a line that several documents share\nx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(line_runs.dedup(docs, batches=batches)) == by_hand(rows)


def test_all_lines_of_a_text_may_go(spark):
    line = "the very same line in all of them"
    rows = [(i, "\n".join([line] * i)) for i in range(1, 6)]
    out = {r["doc_id"]: r for r in line_runs.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1]["__kept"] == "" and out[4]["__n_dropped"] == 4 and out[5]["__n_dropped"] == 0


def test_odd_rows(odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(line_runs.dedup(odd)) == by_hand(rows)
    clean = line_runs.without_repeats(odd)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    assert clean.where("doc_id = 3 AND text IS NULL").count() == 1
    assert line_runs.dedup(nothing).count() == 0


def test_only_dataframe_functions(spark, small):
    plan = line_runs.dedup(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
