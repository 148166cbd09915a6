"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__
from benefica.checking import compare, oracle_connection
from benefica.plans import load

FOLDER = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"  # for queries that find nothing in the smallest tables: an empty result checks nothing
# Model training takes long; tests/test_learning.py covers it.
SLOW = {"k04_logistic_regression", "k05_random_forest", "k06_gradient_boosting", "k07_isolation_forest",
        "k08_hybrid_model_scores", "k13_model_scan", "f05_top_importances", "k11_coefficients"}


@pytest.fixture(scope="module")
def con():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", [n for n in load() if n not in SLOW])
def test_query(name, spark, con):
    verdict = compare(load()[name], spark, con, FOLDER)
    if verdict.startswith("EMPTY"):
        verdict = compare(load()[name], spark, oracle_connection(LARGER), LARGER)
    assert verdict.startswith("ok"), verdict


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
