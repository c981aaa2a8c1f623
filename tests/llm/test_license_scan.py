import random
import re

from signalloom.llm import license_scan
from signalloom.llm.catalogue import QUERIES
from signalloom.llm.license_scan import TEMPLATES, bands_for
from signalloom.llm.license_texts import WHOLE_TEXTS


def shingles(text, size=5):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text)
    return words, size


def by_hand(docs, templates, containment=0.8):
    """Best containment of any run of W shingles that begins at a template's shingle."""
    out = set()
    for name, template in templates.items():
        words, _ = shingles(template)
        size = min(5, len(words))
        own = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
        wide = 1 << (len(own) - 1).bit_length()
        for doc, text in docs:
            words, _ = shingles(text)
            at = [i for i in range(len(words) - size + 1) if tuple(words[i : i + size]) in own]
            if any(len({tuple(words[j : j + size]) for j in at if i <= j < i + wide}) >= containment * len(own) for i in at):
                out.add((doc, name))
    return out


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op8_license_scan"](spark, folder).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = by_hand(docs, TEMPLATES)
    assert {(r["doc_id"], r["license"]) for r in rows} == want and len(rows) == len(want) > 20
    assert all(0.8 <= r["containment"] <= 1 for r in rows)


def test_bands_meet_with_the_wanted_chance():
    for s in (0.15, 0.4, 0.9):
        b = bands_for(s, 0.999)
        assert 1 - (1 - s) ** b >= 0.999 > 1 - (1 - s) ** (b - 1)


def test_edited_templates_and_borders(spark):
    long = TEMPLATES["MIT permission"]
    words = long.split()
    edited = " ".join([*words[:20], "surprising", *words[21:]])
    halves = [" ".join(words[:14]), " ".join(words[14:])]
    docs = [(1, f"foo bar {edited} baz"), (2, halves[0]), (3, halves[1]), (4, "x " * 37 + long + " and " + long), (5, None), (6, "")]
    own = {n: t for n, t in TEMPLATES.items() if n not in WHOLE_TEXTS}
    rows = {(r["doc_id"], r["license"]): r for r in license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), own).collect()}
    assert set(rows) == {(1, "MIT permission"), (4, "MIT permission")} | {k for k in rows if k[1] == "MIT permission" and k[0] == 1}
    assert 0.8 <= rows[1, "MIT permission"]["containment"] < 1 and rows[1, "MIT permission"]["first_word"] == 2
    assert rows[4, "MIT permission"]["first_word"] == 37 and rows[4, "MIT permission"]["n_places"] >= 2


def test_whole_texts_full_and_edited(spark):
    """Each text in prose, as it is, with one word in fifty changed, and with its second half gone."""
    rng = random.Random(3)
    docs, whole, edited, halved = [], set(), set(), set()
    for n, (name, text) in enumerate(WHOLE_TEXTS.items()):
        words = text.split()
        prose = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        changed = ["changed" if i % 50 == 25 else w for i, w in enumerate(words)]
        for kind, body in ((0, words), (1, changed), (2, words[: len(words) // 2])):
            at = rng.randrange(400)
            docs.append((10 * n + kind, " ".join([*prose[:at], *body, *prose[at:]])))
        whole.add((10 * n, name))
        if len(words) >= 20:
            edited.add((10 * n + 1, name))
        halved.add((10 * n + 2, name))
    found = {(r["doc_id"], r["license"]) for r in license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert whole | edited <= found and not halved & found
    assert {f for f in found if f[1] in WHOLE_TEXTS} == {f for f in by_hand(docs, WHOLE_TEXTS)}


def test_odd_rows(odd, nothing):
    own = {"cat": "the cat sat on the mat and looked", "fox": "quick brown fox"}
    rows = license_scan.scan(odd, own).collect()
    assert sorted((r["doc_id"], r["license"]) for r in rows) == [(1, "cat"), (6, "cat"), (6, "cat"), (7, "fox")]
    assert license_scan.scan(nothing, own).count() == 0
    assert license_scan.scan(odd, {}).count() == 0 and license_scan.scan(odd, {"none": "..."}).count() == 0
