import os

import pytest

pytest.importorskip("khata.llm.queries")

TOKENIZERS = os.environ.get("KHATA_TOKENIZERS", "/opt/tokenizers")


@pytest.fixture
def documents(spark):
    """A table of texts, with further columns whose names clash with those that operators use."""

    def make(texts, **more):
        rows = [(i + 1, t, "x", -1, "id", "t") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, n_tokens INT, id STRING, t STRING")

    return make
