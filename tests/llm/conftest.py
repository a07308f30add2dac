import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score int, n_words string"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ids that tie, clashing extra columns."""
    long = " ".join(f"wort{i % 977}" for i in range(40_000))
    rows = [
        (None, None, None, None, None, None, None),
        (1, None, "en", None, 0, 1, "x"),
        (2, "", "en", "a", 0, 1, "x"),
        (3, "one two three four five six seven", "en", "a", 3, 1, "x"),
        (3, "one two three four five six seven", "en", "a", 3, 1, "x"),
        (4, "one two three four five six seven", "en", "b", 3, 1, "x"),
        (5, long, "de", "b", 1, 1, "x"),
        (6, "x" * 200_000, "de", "b", 1, 1, "x"),
        (7, "12 34 ... \u00a0\u2003 !!", "de", "b", 1, 1, "x"),
        (8, "\x00 nul und \U0001f600 <|endoftext|> ende", "de", "c", 1, 1, "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")
