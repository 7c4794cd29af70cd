import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, _d int"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, repeated ids."""
    words = [f"word{i % 97}" for i in range(400)]
    long = " ".join(words)
    lines = "A first line of text\nshort\n\tA FIRST line of text \n\n" + long
    return [
        (1, lines, "en", "s", 5, "x", 1), (2, lines, "en", "s", 5, None, None), (2, lines, "en", "s", 5, None, None), (3, "", None, None, None, "y", 2), (4, None, "de", "s", 0, "x", 3),
        (None, lines, "en", None, 1, "x", 4), (None, "a text of its own, without an id", "en", "s", 1, "x", 5), (5, "one", "en", "s", 3, "x", 6), (6, " \t\n ", "en", "s", 3, "x", 7),
        (7, long + " and more", "en", "s", 9, "x", 8), (8, "In. " * 120, "en", "s", 9, "x", 9), (9, "In. " * 60, "en", "s", 9, "x", 9), (1, "another text under the same id", "fr", "t", 2, "z", 10),
        (10, "é  É ß 数 \x1c <|endoftext|> 12,5kg 😀" * 3, "fr", "t", 2, "z", 11), (-3, lines + "\nlast", "en", "s", 5, "x", 12),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
