import pytest

#: Names that operators use inside, as columns of the input.
CLASHING = ["k", "h", "node", "score", "words", "same", "start", "bin", "shard", "ids", "media", "list", "token", "spot", "label"]


@pytest.fixture(scope="session")
def documents(spark):
    """Make documents of ``(doc_id, text)`` with the other columns null, and columns of clashing names."""

    def make(rows):
        filled = [(i, t, None, None, None, *[7] * len(CLASHING)) for i, t in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHING)
        return spark.createDataFrame(filled, schema)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, repeated rows, a key given twice."""
    long = " ".join(f"word{i % 997} ünder{i % 13}" for i in range(30_000))
    return [(1, None), (2, ""), (3, " "), (None, "no key at all"), (None, None), (4, long), (5, long + " end"), (6, "same"), (6, "same"), (7, "one"), (7, "two"), (8, "a\x00b\n\t한글 🙂")]
