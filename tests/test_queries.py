"""Every library query against its SQL, or at least that it runs."""

import pytest

from strandbase import registry
from tests.parity import database, rows_of, rows_of_sql

registry.load()


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, sf_dir, con, name):
    assert rows_of(registry.QUERIES[name](spark, sf_dir)) == rows_of_sql(con, registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_corruption_is_never_silent(spark, sf_dir):
    rows = registry.QUERIES["m22_corruption_cases"](spark, sf_dir).collect()
    assert {r.verdict for r in rows} <= {"rejected", "differs"}


def test_best_cost_is_least(spark, sf_dir):
    rows = registry.QUERIES["x8_stop_at_best_cost"](spark, sf_dir).collect()
    assert [r.cost for r in rows if r.best] == [min(r.cost for r in rows)]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
