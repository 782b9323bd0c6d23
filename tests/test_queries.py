"""Every query with SQL against DuckDB, and the others for running at all."""

import pytest
from same import rows
from veilframe.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, data, duck, name):
    assert rows(QUERIES[name](spark, data).toPandas()) == rows(duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    frame = QUERIES[name](spark, data)
    frame.write.format("noop").mode("overwrite").save()
    assert frame.columns
