from __future__ import annotations

import os

import pytest

from ledgerloom.llm.frames import prepared

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def corpus(spark):
    if not os.path.isdir(SF):
        pytest.skip("test tables not present")
    return prepared(spark)


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) rows, with a column whose name clashes with inner ones."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, score string, hash string, key string"
        return prepared(spark).createDataFrame([(i, t, "en", "s", None, "x", "x", "x") for i, t in rows], schema)

    return make
