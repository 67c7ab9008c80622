import pytest

EDGE_TEXTS = [
    None,
    "",
    " ",
    "\n\n\n",
    "a",
    "word " * 30_000,
    "x" * 50_000,
    "tab\tand\r\nreturn\x1cfs\x85nel nbsp",
    "naïve café 東京 😀 \U0001f600x ½",
    "same words again and again and again",
    "same words again and again and again",
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Null ids and texts, empty and very long texts, repeated rows, and columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "s", 0, f"extra{i}", i) for i, t in enumerate(EDGE_TEXTS)]
    rows += [(None, "no id here at all", None, None, None, None, None), (4, "a", "en", "s", 1, "extra4", 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, uid string, bin long")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
