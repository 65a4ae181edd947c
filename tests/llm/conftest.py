import pytest


@pytest.fixture
def documents(spark):
    """Build ``documents`` rows from texts, with a clashing extra column."""

    def build(rows, extra="hash string"):
        name, kind = extra.split()
        return spark.createDataFrame(
            [(i, t, "en", f"s{(i or 0) % 3}" if i != 7 else None, None if t is None else len(t), "x") for i, t in rows],
            f"doc_id long, text string, lang string, source string, n_chars long, {name} {kind}")

    return build


ODD = [(1, None), (2, ""), (3, "one"), (4, " \t\n"), (5, "one"), (None, "one two"), (None, "one two"), (7, "a b c d e"),
       (7, "a b c d e"), (8, "é ü Word word 12 " * 3000)]


@pytest.fixture
def odd(documents):
    """Nulls, blanks, repeats, a null id, a repeated row and a long text."""
    return documents(ODD)


@pytest.fixture
def empty(documents):
    return documents([(1, "x")]).limit(0)
