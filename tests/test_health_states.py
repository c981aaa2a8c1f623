"""Health that accumulates: states of loads add up to one pass."""

import random

import pytest
from pyspark.sql import functions as F

from signalloom.operators import health, health_states as hs
from signalloom.schemas import CHUNK, CHUNK_SETS


def chunks(spark, n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        row = {f.name: None for f in CHUNK.fields}
        row.update({c: [rng.choice(["critical", "timing", "failure", "TIMEOUT", f"v{rng.randrange(30)}"]) for _ in range(rng.randrange(4))] for c in CHUNK_SETS})
        case = rng.choice(["", None, *[f"t{k}" for k in range(12)]])
        row.update(chunk_id=f"c{i}", trace_id=case, testcase_id=case, chunk_index=i, text="x", event_count=1, event_ids=[],
                   has_failure=rng.random() < 0.4, has_high_severity=rng.random() < 0.2, has_retry_recommended=rng.random() < 0.3)
        rows.append((*[row[f.name] for f in CHUNK.fields], f"camp{i % 3}", i % 5))
    schema = CHUNK.fieldNames()
    made = spark.createDataFrame([r[: len(schema)] for r in rows], CHUNK)
    marks = spark.createDataFrame([(f"c{i}", r[-2], r[-1]) for i, r in enumerate(rows)], "chunk_id string, campaign string, load int")
    return made.join(marks, "chunk_id")


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("exact", [True, False])
def test_loads_add_up_to_one_pass(spark, tmp_path, exact):
    all_chunks = chunks(spark, 240).cache()
    reports = all_chunks.select("campaign", "load", F.when(F.col("chunk_index") % 4 == 0, "do_not_retry").otherwise("retry_after_cooldown").alias("retry_decision"))
    causes = all_chunks.where("chunk_index % 7 = 0").select("campaign", "load", "chunk_id")
    path = str(tmp_path / "states")
    for load in range(5):
        one = F.col("load") == load
        if load == 2:  # what a run that is repeated had left
            hs.write_load(path, "2", hs.load_state(all_chunks.where("load = 1"), exact=exact))
        hs.write_load(path, str(load), hs.load_state(all_chunks.where(one), reports.where(one), causes.where(one), exact=exact))
    found = hs.merged_health(hs.read_states(spark, path, exact))
    want = health.campaign_health(all_chunks, reports, causes, "retry_decision", "campaign")
    assert found.count() == 3
    # few distinct ids are counted exactly by a sketch as well
    assert rows(found) == rows(want.select(*found.columns))


def test_the_error_of_sketches(spark):
    n = 60_000
    many = spark.range(n).select(
        F.lit("a").alias("campaign"), F.concat(F.lit("t"), "id").alias("trace_id"), F.concat(F.lit("c"), (F.col("id") % 9000)).alias("testcase_id"),
        F.col("id").alias("chunk_index"), *[F.array().cast("array<string>").alias(d) for d in health.DIMENSIONS],
        *[F.lit(False).alias(f) for f in ("has_failure", "has_high_severity", "has_retry_recommended")], (F.col("id") % 4).alias("load"),
    )
    states = [hs.load_state(many.where(F.col("load") == k), exact=False) for k in range(4)]
    merged = {name: states[0][name] for name in states[0]}
    for state in states[1:]:
        merged = {name: merged[name].unionByName(state[name]) for name in merged}
    row = hs.merged_health(merged).first()
    assert abs(row["unique_trace_count"] / n - 1) < 0.03 and abs(row["unique_testcase_count"] / 9000 - 1) < 0.03
    assert row["total_chunks"] == n


def test_empty_loads(spark, tmp_path):
    none = chunks(spark, 4).limit(0)
    hs.write_load(str(tmp_path), "0", hs.load_state(none))
    assert hs.merged_health(hs.read_states(spark, str(tmp_path))).count() == 0
