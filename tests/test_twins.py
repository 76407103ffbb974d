"""Every registered query with a SQL twin gives the same rows as the twin."""

import pytest
from compare import connect, difference

from tabloom.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(ORACLES))
def test_twin(spark, sf_dir, con, name):
    assert difference(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


def test_entry_contract(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    frame = contract.entry(spark)
    assert frame.columns == ["rank", "points", "code", "detail", "measure"]
    assert frame.count() > 0


@pytest.mark.parametrize(
    "name", ["n_unique_sketched", "kmeans", "bisecting_kmeans", "silhouette", "isolation_forest", "anomaly_summary"]
)
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
