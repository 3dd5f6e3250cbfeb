"""Every registered query outside the optional subpackage against its SQL."""

import pytest

from tests.compare import check, connect
from tidewater import plans


@pytest.fixture(scope="module")
def con():
    return connect()


#: Trained models, which SQL can't give; test_models.py holds them.
MODELS = {"model_comparison", "feature_importances", "parameter_search", "learning_curve", "matrix_factors", "saved_model_scores", "approximate_neighbours"}


def test_every_query_has_sql():
    assert set(plans.QUERIES) - MODELS == set(plans.ORACLE)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query(spark, con, name):
    check(spark, con, plans.QUERIES[name], plans.ORACLE[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["dt", "total", "mean20", "pct", "cum"]
    assert set(plans.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
