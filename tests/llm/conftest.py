import pytest


@pytest.fixture(scope="session")
def small():
    """Tables small enough for brute force."""
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and blank texts, repeated rows and keys, ties, a very long text, clashing columns."""
    long_text = " ".join(f"w{i % 977}x{i % 1013}" for i in range(60_000))
    rows = [
        (1, "one two three four five six seven eight nine ten eleven twelve", "en"),
        (1, "one two three four five six seven eight nine ten eleven twelve", "en"),
        (2, "ONE two three four five six seven eight nine ten eleven twelve", "en"),
        (3, None, "en"), (4, "", None), (5, " \t\n ", "de"), (6, "word", "en"), (7, "word", "en"),
        (8, long_text, "en"), (9, long_text + " tail", "en"), (None, "one two three", "fr"), (None, None, None),
        (10, "Ünï çödé — \u2581mark\u2581 \U0001f600 <|endoftext|> a  b\u00a0c\r\nd", "fr"),
        (11, "same line here\nsame line here\nother line\nsame line here", "en"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_words long, kept boolean, shard int, word string"
    return spark.createDataFrame([(*r, "s", -1, None, 99, "clash") for r in rows], schema)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
