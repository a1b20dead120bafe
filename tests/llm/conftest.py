import pytest

ODD = [
    (0, None, "en", "b", 0),
    (1, "", None, "a", 0),
    (2, " \t\n", "en", None, 3),
    (3, "one two three four five six seven eight", "en", "b", 39),
    (3, "one two three four five six seven eight", "en", "b", 39),
    (4, "One two  three four five six seven eight", "de", "b", 40),
    (5, "word", "de", "a", 4),
    (None, "no id here but several words anyway", "en", "a", 35),
    (6, "x" * 5000 + " é ü 漢字 🔍 " + "long text " * 20000, "fr", "b", 1),
    (7, "İstanbul ΣΑΣ don't I'LL 1234 %%% ---", "de", "a", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and blank texts, repeats, ties, a very long text, and columns named like results."""
    rows = [(*r, 9, "x", 1.0, "y", 2) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, score string, start double, fp string, component_id int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
