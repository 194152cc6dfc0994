import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_helpers import prose  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long, shard string, key long, score string"
@pytest.fixture(scope="session")
def documents(spark):
    """A documents table of (doc_id, text) pairs with clashing extra columns, all null."""

    def make(*rows):
        return spark.createDataFrame([(i, t, None, None, None, None, None, None) for i, t in rows], DOC)

    return make


@pytest.fixture(scope="session")
def awkward(documents):
    """Nulls, empty and long texts, ties and repeated rows."""
    return documents(
        (None, "no id at all"), (None, None), (1, None), (2, ""), (3, "  \n "), (4, "one"), (5, prose(5, 60)), (5, prose(5, 60)),
        (6, prose(5, 60)), (7, prose(7, 9000)), (8, "é日\U0001f600 x" * 30), (9, "x" * 400),
    )


@pytest.fixture(scope="session")
def nothing(documents):
    return documents()
