"""The stages one after another, each against a plain version of its decision."""

import corpus_pipeline
from pyspark.sql import functions as F
from test_decontaminate import by_hand as leaks_by_hand
from test_line_runs import by_hand as lines_by_hand
from test_simhash import groups_by_hand, print_by_hand

from signalloom.llm import language_id
from signalloom.llm.decontaminate import words_of
from signalloom.session import staged

import hashlib
import os


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_dedup", "decontamination", "source_mix"]
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(staged(stage(spark, tables[-1], small)))
    assert all(t.columns == docs.columns for t in tables[:-1])
    before, clear, lines, single, clean, mixed = [rows(t) for t in tables]

    rejected = {r["doc_id"] for r in language_id.predict(docs, language_id.learn(docs)).where("__verdict.rejected").collect()}
    assert set(clear) == set(before) - rejected and len(rejected) < 0.03 * len(before)
    assert all(clear[i] == before[i] for i in clear)

    want = {i: (n, d, k) for i, n, d, k in lines_by_hand([(i, r["text"]) for i, r in clear.items()])}
    assert {i: hashlib.sha256(r["text"].encode()).hexdigest() for i, r in lines.items()} == {i: w[2] for i, w in want.items()}
    assert all(r["n_chars"] == (len(r["text"]) if want[i][1] else before[i]["n_chars"]) for i, r in lines.items())

    groups = groups_by_hand({i: print_by_hand(r["text"]) for i, r in lines.items()})
    assert set(single) == set(groups.values()) and all(single[i] == lines[i] for i in single)

    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    windows = {}
    for item, text in items:
        own = words_of(text)
        for w in [own[i : i + 10] for i in range(len(own) - 9)] or ([own] if own else []):
            windows.setdefault(tuple(w), set()).add(item)
    sizes = {len(w) for w in windows}

    def found(text):
        own = words_of(text)
        return [i for n in sizes for i in range(len(own) - n + 1) if tuple(own[i : i + n]) in windows]

    touched = {i for i, r in single.items() if found(r["text"])}
    assert touched and all(clean[i] == single[i] for i in single if i not in touched)
    assert not any(found(clean[i]["text"]) for i in touched if i in clean)
    one = next(iter(touched))
    assert any(leaks_by_hand(items, words_of(single[one]["text"]), 10)[0])

    assert set(mixed) <= set(clean) and all(r["taken_words"] > 0 for r in mixed.values())
    total = sum(len(r["text"].split()) for r in clean.values())
    assert abs(sum(r["taken_words"] for r in mixed.values()) - total) <= 0.01 * total


def test_run_and_entry(spark, small):
    import __spark_entry__

    again = __spark_entry__.queries()["pipeline"](spark, small).agg(F.sum("taken_words"), F.count("*")).first()
    assert again == corpus_pipeline.run(spark, small).agg(F.sum("taken_words"), F.count("*")).first()
    assert "pipeline" not in __spark_entry__.oracle_sql()


def test_odd_tables(spark, odd, nothing, small):
    for table in (odd, nothing):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = staged(stage(spark, docs, small))
        assert docs.columns == [*odd.columns, "taken_words"]
    assert docs.count() == 0


def test_operators_import_without_the_guard():
    folder = os.path.dirname(corpus_pipeline.__file__)
    for path in [f"{folder}/corpus_pipeline.py", *[f"{folder}/signalloom/llm/{f}" for f in os.listdir(f"{folder}/signalloom/llm") if f.endswith(".py")]]:
        with open(path) as file:
            assert "except ImportError" not in file.read()
