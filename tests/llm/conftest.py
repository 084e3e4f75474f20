"""Tables with odd rows and with none."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, t string, k int"
ODD = [None, "", " ", "a", "A b  c", "\n\n", "naïve <s> </s> ▁x", "日本語 🙂", "word " * 3000, "same text here for all of us", "same text here for all of us"]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, x, "en" if i % 3 else None, None, None, 1.0, "z", 7) for i, x in enumerate(ODD)]
    return spark.createDataFrame([*rows, (None, "no id", "en", "s", 1, 0.0, "z", 7), (3, "a", "en", "s", 1, 0.0, "z", 7)], DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
