import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, sources=None, ids=None, langs=None):
        rows = [((ids[i] if ids else i), t, langs[i] if langs else "en", sources[i] if sources else "s", len(t) if t is not None else 0) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank, long, repeated rows and clashing column names."""
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, "   \t\n", "en", "a"), (4, "one", "en", None),
        (5, "w" + " word" * 40_000, "en", "b"), (6, "Same Text here, you see.", "en", "b"), (6, "Same Text here, you see.", "en", "b"),
        (7, "same text HERE, you see.", "en", "c"), (None, "no id at all", "de", "c"), (8, "été \U0001f600 é", "fr", "c"), (9, "12345 67 !!", "fr", "c"),
    ]
    wide = [(*r, "x", 1, 2.0, "y") for r in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, id string, digest int, size double, shard string")


@pytest.fixture
def rng():
    return random.Random(7)
