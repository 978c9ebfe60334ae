import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from odd_rows import ODD  # noqa: E402


@pytest.fixture
def frame(spark):
    """A documents frame from (doc_id, text[, lang, source]) rows, with a column whose name operators use inside."""
    def make(rows):
        full = [(*r, "en", "s") if len(r) == 2 else tuple(r) for r in rows]
        return spark.createDataFrame([(*r, 7, "x") for r in full], "doc_id bigint, text string, lang string, source string, kept int, _n string")
    return make


@pytest.fixture
def odd(frame):
    return frame(ODD)


@pytest.fixture
def empty(frame):
    return frame(ODD).limit(0)
