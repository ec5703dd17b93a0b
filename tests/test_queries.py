"""Every registered query at the smallest scale, against its SQL where there is one."""

import os

import pytest

from tidemark.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# Trained elsewhere on small rows; here they would only repeat minutes of fitting.
FITTED = {"rf_per_symbol", "rf_multi", "predict_direction", "clf_random_forest", "clf_mlp", "clf_svm", "experiment_machines", "experiment_grid"}


@pytest.fixture(scope="module")
def con():
    from compare import database

    return database(SF)


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in FITTED])
def test_query(spark, con, name):
    from compare import compare

    message, good = compare(spark, con, name, catalog.QUERIES[name], catalog.ORACLES.get(name), SF)
    assert good, message
