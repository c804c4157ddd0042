"""Every registered query against its SQL twin, and the ones without a twin for rows."""

import pytest
import twins

from tablemend import catalog

FOLDER = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()
HEAVY = {"model_compare_regression", "tuned_tree", "model_versions", "repair_model_ready", "tomek_removal", "feature_importance"}


@pytest.fixture(scope="module")
def con():
    return twins.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, con, name):
    assert twins.differences(spark, con, catalog.queries()[name], SQL[name], FOLDER) is None


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL) - HEAVY))
def test_rows(spark, name):
    assert catalog.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["type", "severity", "score"]
