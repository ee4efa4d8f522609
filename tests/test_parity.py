"""Every registered query agrees with its DuckDB oracle (sf0.001 for speed; the
driver checks sf0.01 with the same code)."""

import os

import pytest

from tests.parity import compare, duck
from txrisk.plans.catalog import QUERIES

SF = os.environ.get("TXRISK_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


#: A query of two names is compared once: e11_..._full and e13_..._full are e11_... and e13_....
NAMES = [n for n, (_f, s) in QUERIES.items() if s is not None and not (n.endswith("_full") and QUERIES[n[:-5]][1] == s)]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    fn, sql = QUERIES[name]
    r = compare(spark, con, name, fn, sql, SF)
    assert r["ok"], r["problems"]
