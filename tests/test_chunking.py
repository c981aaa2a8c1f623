"""Chunk packing against sums of line lengths, and chunk contents."""

import random
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.functions.packing import Block, chain
from signalloom.operators import chunking


def by_sums(lengths, size, overlap):
    """1-based (line start, line end, event start) of each chunk, from sums of line lengths.

    A chunk takes new lines up to the last whose sum from the chunk's start fits, and one at
    least.  The next starts at the last line from which the overlap is full, and its events at
    a tenth of this chunk's events before its end.
    """
    upto = [0, *accumulate(lengths)]
    start, first_event, new, out = 1, 1, 1, []
    while new <= len(lengths):
        end = max(new, bisect_right(upto, upto[start - 1] + size) - 1)
        out.append((start, end, first_event))
        first_event = end + 1 - max(1, (end - first_event + 1) // 10)
        full = bisect_right(upto, upto[end] - overlap)
        start = max(start, full) if overlap > 0 else end + 1
        new = end + 1
    return out


def block_by_block(lengths, size, overlap, rows):
    lengths = np.array(lengths)
    last = (len(lengths) - 1) // rows
    blocks = []
    for k in range(last + 1):
        own, tail = lengths[k * rows:(k + 1) * rows], lengths[:0]
        if k:
            before = lengths[(k - 1) * rows:k * rows]
            left = before.sum() - np.cumsum(before)
            keep = max(overlap, 0)
            tail = before[int(np.argmax((left <= size + keep) | (left - before[-1] < keep))):]
        blocks.append(Block(k * rows - len(tail) + 1, np.concatenate([tail, own]), len(tail), size, overlap, k == last))
    starts = [(0, 0, 0)] + (chain([b.exits() for b in blocks[:-1]]) if last else [])
    return [c for block, (reach, carried, _) in zip(blocks, starts) for c in block.chunks(reach, carried)]


def random_case(rng):
    top = rng.choice([3, 10, 50, 300])
    lengths = [rng.randint(1, top * (20 if rng.random() < 0.05 else 1)) for _ in range(rng.randint(1, 200))]
    return lengths, rng.choice([1, 5, 20, 100, 400]), rng.choice([-1, 0, 1, 5, 20, 100, 500])


def test_packing_matches_by_sums():
    rng = random.Random(7)
    compared = 0
    for _ in range(3000):
        lengths, size, overlap = random_case(rng)
        expected = by_sums(lengths, size, overlap)
        assert block_by_block(lengths, size, overlap, 10**6) == expected
        try:
            assert block_by_block(lengths, size, overlap, 40) == expected
            compared += 1
        except ValueError:
            pass  # a block too short for the look-back is refused, never packed wrongly
    assert compared > 1000


def test_every_event_is_new_in_one_chunk():
    lengths, size, overlap = [7] * 500, 60, 15
    ends = [end for _, end, _ in by_sums(lengths, size, overlap)]
    assert ends == sorted(set(ends)) and ends[-1] == 500


@pytest.mark.parametrize("block_rows", [10**6, 50])
def test_bounds_on_spark_with_a_hot_trace(spark, block_rows):
    rng = random.Random(3)
    lengths = {"hot": [rng.randint(1, 40) for _ in range(900)], "a": [30] * 7, "b": [500], "c": [1, 900, 1],
               "thin": [1 if i % 100 else 60 for i in range(1500)], "tiny": [1] * 400}
    rows = [(case, i + 1, n) for case, all_ in lengths.items() for i, n in enumerate(all_)]
    lines = spark.createDataFrame(rows, "testcase_id string, event_index long, length int").repartition(5)
    found = chunking.chunk_bounds(lines, 200, 50, block_rows=block_rows).orderBy("testcase_id", "chunk_index").collect()
    for case, all_ in lengths.items():
        mine = [r for r in found if r["testcase_id"] == case]
        assert [(r["line_start"], r["line_end"], r["event_start"]) for r in mine] == by_sums(all_, 200, 50)
        assert [r["chunk_index"] for r in mine] == list(range(len(mine)))


def test_one_event_makes_one_chunk(spark):
    event = spark.createDataFrame(
        [("123", 1, "123-0001", "2026-06-26 04:57:28.413000", "failure", "FAILURE_SIGNAL", "medium", "failed", "mobily",
          "sa", "unknown", "trace_analysis", None, False, None, "FAILURE_SIGNAL detected",
          ["failure", "failure_signal", "medium"], ("FAIL",), "raw line")],
        "testcase_id string, event_index long, event_id string, timestamp string, event_family string, "
        "event_name string, severity string, result string, operator string, country string, network_domain string, "
        "workflow_stage string, cause string, retry_recommended boolean, recommendation string, "
        "normalized_message string, tags array<string>, metadata struct<evidence_value:string>, raw_message string")
    chunk = chunking.build_chunks(event, 2000, 200).collect()
    assert len(chunk) == 1
    chunk = chunk[0]
    assert (chunk["testcase_id"], chunk["event_count"], chunk["has_failure"]) == ("123", 1, True)
    assert chunk["event_names"] == ["FAILURE_SIGNAL"] and chunk["causes"] == []
    assert chunk["text"] == (
        "testcase_id=123 | event_id=123-0001 | timestamp=2026-06-26 04:57:28.413000 | family=failure | "
        "protocol_layer=None | name=FAILURE_SIGNAL | severity=medium | result=failed | operator=mobily | country=sa | "
        "domain=unknown | workflow_stage=trace_analysis | direction=None | cause=None | retry_recommended=False | "
        "recommendation=None | message=FAILURE_SIGNAL detected | tags=[failure, failure_signal, medium] | "
        "metadata=[evidence_value=FAIL] | extracted_values=[] | raw=raw line")


def test_nested_traces(spark):
    nested = spark.sql(
        "select cast(null as string) trace_id, 'c1' testcase_id, array(named_struct('testcase_id', 'x', 'event_name', 'A'),"
        " named_struct('testcase_id', 'x', 'event_name', 'B')) events")
    rows = chunking.unnest_traces(nested).orderBy("event_index").collect()
    assert [(r["testcase_id"], r["event_index"], r["event_name"]) for r in rows] == [("c1", 1, "A"), ("c1", 2, "B")]
    assert nested.select(F.size(chunking.nested_events(nested))).first()[0] == 2
