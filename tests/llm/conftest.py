import pytest

#: Nulls everywhere, empty and very long texts, ties, repeated rows, and columns whose names clash with helpers.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, id long, fp long, Shard int, score double, i string"
LONG = "the long words of one very long text go on and on " * 20_000
ROWS = [
    (1, "The first text of the table has a few words in it.", "en", "a", 50),
    (2, "The first text of the table has a few words in it.", "en", "a", 50),
    (2, "The first text of the table has a few words in it.", "en", "a", 50),
    (3, None, "en", "b", None),
    (4, "", None, "b", 0),
    (None, "Ein Text ohne Kennung, aber mit einigen Worten darin.", "de", None, 52),
    (None, None, None, None, None),
    (5, LONG, "en", "c", len(LONG)),
    (6, "   \t\n ", "fr", "c", 6),
    (7, "\U0001f600 123 \x00 é<|endoftext|>", "fr", None, 10),
    (8, "Une phrase en français avec quelques mots dedans, voilà.", "fr", "b", 55),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 0.5, "x") for r in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
