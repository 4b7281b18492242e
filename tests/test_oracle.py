"""Every registered query equals its SQL on the smallest scale."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference

SF = "/root/testdata/sf0.001"
#: Trained with all trees; held against their SQL with few trees in test_stats.
SLOW = {"model_predictions", "model_importance_sums", "model_final_scores", "model_attribution"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n not in SLOW])
def test_query_equals_oracle(spark, con, name):
    problem, _ = difference(spark, con, name, SF)
    assert problem is None, problem


def test_entry_has_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["cik", "ticker"]
    assert 0 < df.count() <= 25
