import os

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def data_dir():
    return os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture
def make_docs(spark):
    def make(rows):
        """rows: (doc_id, text) or full rows."""
        return spark.createDataFrame([(*r, None, None, None)[:5] if len(r) == 2 else r for r in rows], DOCS)

    return make
