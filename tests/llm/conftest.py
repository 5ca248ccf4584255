"""Tables with everything that may be odd about documents."""

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept int, print string, digest string"


@pytest.fixture
def docs(spark):
    """A frame of (id, text) pairs among columns whose names the operators might use themselves."""

    def make(rows, langs=None):
        langs = langs or [None] * len(rows)
        return spark.createDataFrame(
            [(i, t, lang, None, 7, 1, "p", None) for (i, t), lang in zip(rows, langs)], COLUMNS)

    return make
