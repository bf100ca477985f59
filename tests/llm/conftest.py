from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    from cellpath.llm.queries import table

    return [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def rows(spark):
    """A function that collects a DataFrame as sorted tuples."""
    return lambda df: sorted(map(tuple, df.collect()), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))
