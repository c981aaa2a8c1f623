import random

import pytest
from compare import connect, difference

from signalloom.llm import decontaminate
from signalloom.llm.catalogue import ORACLE, QUERIES
from signalloom.llm.decontaminate import Automaton, cut_words, words_of


def test_query_equals_sql(spark, small):
    assert difference(QUERIES["op9_decontaminate"](spark, small), connect(small), ORACLE["op9_decontaminate"]) is None


def by_hand(items, words, size):
    hit, found = [False] * len(words), set()
    for item, text in items:
        own = words_of(text)
        for window in [own[i : i + size] for i in range(len(own) - size + 1)] or ([own] if own else []):
            for i in range(len(words) - len(window) + 1):
                if words[i : i + len(window)] == window:
                    found.add(item)
                    hit[i : i + len(window)] = [True] * len(window)
    return hit, found


def test_automaton_equals_search():
    rng = random.Random(9)
    letters = ["a", "b", "c", "d"]
    for _ in range(1500):
        size = rng.randint(1, 4)
        items = [(str(i), " ".join(rng.choices(letters[: rng.randint(1, 4)], k=rng.randint(0, 7)))) for i in range(rng.randint(0, 4))]
        words = [w.encode() for w in rng.choices([*letters, "z"], k=rng.randint(0, 14))]
        hit, found = Automaton(items, size).hits(words)
        assert (hit.tolist(), found) == by_hand(items, words, size)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short Item!"), (3, None), (4, "  ..  "), (None, "alpha beta gamma")]


@pytest.mark.parametrize("max_words", [4_000_000, 5])
def test_shards_change_nothing(spark, odd, nothing, max_words):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    texts = ["zero one two THREE four five six seven, eight nine ten end", "a short item and alpha-beta gamma", "one two three four five", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in decontaminate.report(docs, items, max_words=max_words).collect()}
    assert (rows[0]["n_words"], rows[0]["n_hit"], rows[0]["n_items"]) == (12, 10, 1)
    assert (rows[1]["n_hit"], rows[1]["n_items"]) == (5, 1)
    assert not rows[2]["contaminated"] and rows[3]["n_words"] == rows[4]["n_words"] == 0
    kept = {r["doc_id"]: r["text"] for r in decontaminate.remove(docs, items, max_coverage=0.8, max_words=max_words).collect()}
    assert kept == {1: "a  and ", 2: texts[2], 3: None, 4: ""}
    assert decontaminate.report(odd, items).count() == odd.count()
    clean = decontaminate.remove(odd, items)
    assert clean.columns == odd.columns and sorted(clean.collect(), key=repr) == sorted(odd.collect(), key=repr)
    assert decontaminate.report(nothing, items).count() == 0
    assert decontaminate.report(odd, items.where("item_id = 99")).where("contaminated").count() == 0


def test_cut_takes_the_text_between_words_along():
    assert cut_words("Äb one, two; three four".encode(), [1, 3]).decode() == "Äb ; three four"
    assert cut_words(b"one two", [0, 2]) == b""


def test_parts_that_meet_after_a_cut_are_cut_too(spark):
    items = spark.createDataFrame([(1, "a b c"), (2, "x y")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "p x a b c y q r s t u v w")], "doc_id long, text string")
    assert decontaminate.remove(docs, items).first()["text"].split() == list("pqrstuvw")
