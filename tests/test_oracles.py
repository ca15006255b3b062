"""Every query with a stated SQL twin gives what DuckDB makes of that SQL on the same files."""

import pytest
from lodestrata import plans
from oracle import compare, connect


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    compare(plans.QUERIES[name](spark, sf_dir), duck.execute(plans.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0
