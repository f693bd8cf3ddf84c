import pytest

from tests.compare import duck, rows
from tracelens.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, sf_dir, con):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_queries_without_sql_are_known():
    """They are held against plain versions in test_plain.py."""
    assert set(QUERIES) - set(ORACLES) == {"mod_02_forest", "mod_15_calibrated", "str_05_prequential", "str_06_adwin_replay", "str_12_covariate_scan"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
