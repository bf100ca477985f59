"""Every registered query against its SQL oracle on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from cellpath.plans import catalog, oracles
from oracle_check import compare, connect


def test_every_query_has_an_oracle():
    assert contract.oracle_sql().keys() <= contract.queries().keys()
    assert catalog.queries().keys() == oracles.oracle_sql().keys()


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["user_id", "year", "month", "day", "slot", "cell_id"]
    assert df.count() % 24 == 0


@pytest.fixture(scope="session")
def con(sf_dir):
    return connect(sf_dir)


# The SQL of each takes long, and the query differs little from one that is tested here.
# ``CELLPATH_SLOW=1`` and ``python tests/oracle_check.py`` run them too.
SLOW = {
    "kmodes_centres_hamming", "model_kmodes", "model_kmodes_hamming", "model_store_roundtrip_pooled", "rank_hits_pooled",
}


@pytest.mark.parametrize("name", sorted(catalog.queries().keys() - (set() if os.environ.get("CELLPATH_SLOW") else SLOW)))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, name)[0] == ""
