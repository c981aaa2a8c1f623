import zlib

import zstandard
from pyspark.sql import functions as F

from signalloom.llm import language_id
from signalloom.llm.catalogue import QUERIES
from signalloom.llm.language_id import Compressors, normalised, windows


def test_query_learns_and_keeps_to_its_rows(spark, small):
    rows = QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = rows.merge(lang, on="doc_id")
    assert len(rows) == len(lang) == len(both)
    assert (rows["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in rows["doc_id"]]).all()
    held = both[both["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.98
    assert rows["score"].between(0, 1).all()


def test_only_labelled_training_rows_teach(spark):
    rows = [(1, "aaaa bbbb cccc dddd", "x"), (2, "eeee ffff gggg", None), (3, None, "y"), (4, "", "z")]
    assert list(language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))) == ["x"]


def test_windows_hold_the_whole_text():
    text = normalised("Über " + "ab cd ½ " * 3000 + "x" * 2000)
    pieces = list(windows(text, 512))
    assert b"".join(pieces).decode() == text and {len(p) for p in pieces[:-1]} == {512}


def test_numerals_and_marks_are_no_letters():
    for text in (None, "", "½", "²³", "Ⅷ", "12 _ %", "\u0301"):
        assert normalised(text) == ""
    assert normalised("½Tasse²  MIT") == "tasse mit"


def test_query_equals_brute_force(spark, small):
    """Every prediction again, with dictionaries and plain loops."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    known = language_id.learn(docs.where(~held))
    params = zstandard.ZstdCompressionParameters.from_level(
        3, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS
    )
    want = {}
    for r in docs.select("doc_id", "text").collect():
        letters = "".join(c if c.isalpha() else " " for c in (r["text"] or "").lower())
        data = " ".join(letters.split()).encode()
        sizes = {}
        for name, content in known.items():
            tool = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
            sizes[name] = sum(len(tool.compress(data[a : a + 512])) for a in range(0, len(data), 512))
        want[r["doc_id"]] = min(known, key=lambda n: sizes[n]) if data else "und"
    got = {r["doc_id"]: r["lang_pred"] for r in QUERIES["op1_language_id"](spark, small).collect()}
    assert got == want


def test_odd_rows(spark, odd, nothing):
    known = language_id.learn(odd)
    assert set(known) == {"en", "de"}
    out = language_id.predict(odd, known)
    assert out.columns == [*odd.columns, "__verdict"] and out.count() == odd.count()
    rows = out.select("doc_id", "text", "__verdict.*").withColumnRenamed("lang", "pred").collect()
    for r in rows:
        if r["text"] is None or not normalised(r["text"]):
            assert (r["pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        else:
            assert r["pred"] in known
    assert {r["pred"] for r in rows if r["doc_id"] == 2} == {"de"}
    assert language_id.drop_rejected(nothing, known).count() == 0
    assert language_id.learn(nothing) == {}
    # nothing learned: everything is unknown
    assert language_id.predict(odd, {}).where("__verdict.lang != 'und'").count() == 0
    assert language_id.drop_rejected(odd, known).columns == odd.columns


def test_long_text_is_judged_whole():
    known = {"en": b" the and with that from this have" * 40, "de": b" der und mit dass von diese haben" * 40}
    tools = Compressors(known, 512, 4.0)
    # most of the text is German, however often it repeats itself
    for n in (40, 400, 4000):
        assert tools.judge("the and with that from this have the and with " + "der und mit dass von diese haben " * n)[0] == "de"
    distinct = " ".join(f"mit dass von diese {chr(97 + i % 26) * 3}{chr(97 + i // 26 % 26) * 3}" for i in range(600))
    assert tools.judge("the and with that from " + distinct)[0] == "de"


def test_ties_go_to_the_more_frequent_language(spark):
    known = language_id.learn(spark.createDataFrame([("q", "b"), ("q", "b"), ("q", "a")], "text string, lang string").withColumn("doc_id", F.lit(1)))
    assert list(known)[0] == "b"
    assert Compressors({"b": b" same", "a": b" same"}, 64, 4.0).judge("something")[0] == "b"


def test_copies_and_short_texts_fill_their_dictionaries(spark):
    """A language of copies of one long text and one of short texts starve no more than another."""
    long_text = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}ing" for i in range(3000))
    copies = spark.range(4000).select(F.lit(long_text).alias("text"), F.lit("copies").alias("lang"))
    letters = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    short = spark.range(9000).select(F.concat(letters, F.lit(" kort")).alias("text"), F.lit("short").alias("lang"))
    full = 16 << 10
    known = language_id.learn(copies.unionByName(short), dictionary_bytes=full)
    assert list(known) == ["short", "copies"]  # by rows, copies included
    assert len(known["short"]) >= 0.99 * full
    assert len(known["copies"]) >= 0.9 * full
