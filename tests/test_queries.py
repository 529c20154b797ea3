"""Every registered query against its SQL on DuckDB; queries without SQL must run and give rows."""

import pytest

from pairloom.plans.registry import Tables, load_all

from .compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
QUERIES = load_all()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_matches_sql(spark, con, name):
    assert differences(QUERIES[name].run(Tables(spark, FOLDER)), con, QUERIES[name].sql) is None


# Model searches take long on a laptop and are covered on small tables in test_models.py.
SLOW = {"model_logreg", "model_trees", "model_margins", "model_knn"}


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql and n not in SLOW])
def test_gives_rows(spark, name):
    assert QUERIES[name].run(Tables(spark, FOLDER)).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
