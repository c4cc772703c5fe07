import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_llm import ODD_TEXTS  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with repeated and missing ids, null columns and names that clash with operators' own."""
    rows = [(i if i != 3 else None, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", "x", 7, "y") for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[-1], rows[-1], (1, "another text under an old id", "fr", "s1", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, rest string, key int, queue string").cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").cache()
