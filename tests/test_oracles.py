"""Every query over the market tables against its SQL, and the entry contract."""

import pytest

import __spark_entry__ as entry_module
from oddsmill.plans.catalog import ORACLES, QUERIES

from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_meets_its_sql(spark, sf_dir, duck, name):
    assert_same(QUERIES[name](spark, sf_dir), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).columns


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and df.columns == ["market_id", "yes", "no", "pair_cost", "margin", "liquidity"]
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
