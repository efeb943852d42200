from __future__ import annotations

import pytest

#: Columns that operators use inside must not clash with a table's own.
EXTRA = ("row", "hash", "part", "fp", "bucket", "kind", "score", "block", "offset")
LONG = "the long word of a very long text " * 4000


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and blank texts, one very long, repeats, ties, odd characters."""
    texts = [
        None, "", " \t\n\x0b", LONG, "one", "one two three", "A b c d e", "a B C d E", "same text of five words here", "same text of five words here",
        "naïve ÉCOLE straße Привет мир 漢字 🙂 z̈ \xa0x\x85y \x1c z", "<|endoftext|> it's I'll 12 3.5% foo--bar", "x" * 5000, "a. b! c? d.\n" * 30, "\x00\x01 nul",
    ]
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    rows += [(8, texts[8], "en", "src", 28), (None, "null id", None, None, None), (None, None, None, None, None), (-5, "negative id", "fr", "s", 11)]
    fields = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, fields)
    return df.selectExpr("*", *[f"'{c}' AS {c}" for c in EXTRA])


@pytest.fixture(scope="session")
def empty_docs(edge_docs):
    return edge_docs.where("false")
