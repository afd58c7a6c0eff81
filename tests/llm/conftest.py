import pytest

#: (doc_id, text, lang, source, n_chars, extra columns whose names clash with the operators' own)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, size long, sha1 string, n_words long, key string"


def row(doc_id, text, source="a"):
    return (doc_id, text, "en", source, None if text is None else len(text), 1, 2, "x", 3, "k")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, odd white space, clashing columns."""
    base = "The quick brown fox jumps over the lazy dog while seven wizards brew strong potions in a quiet valley tonight."
    rows = [
        row(1, base),
        row(2, base),
        row(3, base.replace("quick", "quiet")),
        row(4, None, None),
        row(5, ""),
        row(6, " \t\n\x0b\f\r "),
        row(None, base, "b"),
        row(None, None, None),
        row(7, "Ünïcode ÉÀ straße 😀 words\x00with NUL and nbsp   sep", "é"),
        row(8, "word " * 30_000, "b"),
        row(9, "a b"),
        row(9, "a b"),
        row(10, "<|endoftext|> special string inside"),
        row(11, "\n".join(["same line here again"] * 12), "b"),
        row(12, "one two three four five six seven eight " * 3, "c"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
