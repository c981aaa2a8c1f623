"""Operators that give documents back keep all of their columns, however these are called."""

import pytest
from pyspark.sql import functions as F

from signalloom.llm import chunk_dedup, decontaminate, fair_mix, language_id, line_runs, simhash

#: Names the operators use inside.
NAMES = [
    "__t", "__doc", "__drops", "__kept", "__n_lines", "__n_dropped", "__id", "__hash", "__turn", "__leak_marks", "__verdict",
    "__place", "__text", "__spans", "taken", "place", "queue", "root", "block", "rank", "print", "text_hash", "line", "pos",
]


def operators(spark):
    known = {"en": b" the cat sat on the mat and looked" * 20, "de": b" der hund und die katze sind nicht" * 20}
    items = spark.createDataFrame([("q", "dog jumps over the lazy")], "item_id string, text string")
    return {
        "language": lambda d: language_id.drop_rejected(d, known),
        "lines": lambda d: line_runs.without_repeats(d, min_docs=2),
        "simhash": simhash.keep_one,
        "benchmark": lambda d: decontaminate.remove(d, items, max_coverage=1.0),
        "mix": fair_mix.mixed,
        "passages": lambda d: chunk_dedup.without_passages(d, min_bytes=20),
    }


@pytest.mark.parametrize("name", ["language", "lines", "simhash", "benchmark", "mix", "passages"])
def test_own_columns_stay(spark, odd, name):
    run = operators(spark)[name]
    # ids must be unique for the passages
    docs = odd.dropDuplicates(["doc_id"])
    named = docs.withColumns({n: F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in NAMES})
    plain, clashing = run(docs), run(named)
    extra = [c for c in plain.columns if c not in docs.columns]
    assert clashing.columns == [*named.columns, *extra]
    rows = {r["doc_id"]: r for r in clashing.collect()}
    want = {r["doc_id"]: r for r in plain.collect()}
    assert rows.keys() == want.keys()
    for i, r in rows.items():
        assert all(r[c] == want[i][c] for c in [*docs.columns, *extra])
        assert all(r[n] == f"{n} of {'none' if i is None else i}" for n in NAMES)
