"""Every registered query against its DuckDB SQL twin (the driver's gate),
plus the entry() smoke check."""

import pytest
from conftest import SF01
from oracle_util import compare, duck

import __spark_entry__ as E

from chatlake.plans import registry

NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_query_has_oracle():
    missing = set(NAMES) - set(E.oracle_sql())
    assert not missing, missing


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "session_id" in df.columns


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(E.queries()[name](spark, SF01), con, E.oracle_sql()[name])
    assert r["ok"], r
