import pytest

#: What every operator must stand: nulls in each column, empty and blank texts, repeated rows,
#: equal ids, ties, a long text, and columns that operators also use as names.
LONG = ("the quick brown fox jumps over the lazy dog again\n" * 3000) + "end of the long text"
ROWS = [
    (1, "the cat sat on the mat and looked at the moon for a while", "en", "a", 10, "x"),
    (2, "der hund und die katze sind nicht hier aber das haus ist alt", "de", "b", 10, "x"),
    (3, None, None, None, None, None),
    (4, "", "en", "a", 0, "x"),
    (5, " \n\t ", "en", None, 4, "x"),
    (6, "the cat sat on the mat and looked at the moon for a while", "en", "a", 10, "x"),
    (6, "the cat sat on the mat and looked at the moon for a while", "en", "a", 10, "x"),
    (7, LONG, "en", "hot", len(LONG), "x"),
    (None, "a text without an id that has some words in it", "en", "b", 10, "x"),
    (8, "123 456 !!", None, "c", 10, "x"),
    (9, "one", "en", "c", 3, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"


@pytest.fixture(scope="session")
def odd(spark):
    """Awkward rows; ``size`` also names a result column."""
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
