import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from llm_words import words  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, n string, comp string, kind string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    long = words(99, 40_000)
    texts = [
        (1, words(1, 120)), (2, words(1, 120)), (3, words(1, 120) + " more words"), (4, None), (5, ""), (6, "   \n\t "), (None, words(2, 60)),
        (None, None), (7, "one two"), (8, "One  TWO"), (9, long), (10, long), (20, "é ü 日本 ▁ x" * 3), (20, "é ü 日本 ▁ x" * 3), (40, "a"), (60, words(1, 119)),
    ]
    rows = [(d, t, None if i % 3 else "en", None if i % 4 else "s", None, None, "n", None, "k") for i, (d, t) in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
