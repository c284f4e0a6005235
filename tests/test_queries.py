"""Every retail query with SQL against DuckDB; the others by invariants."""

import pytest

from granary.operators.customers import LABELS
from granary.plans.queries import QUERIES
from granary.plans.sql import ORACLES
from tests.duck import TESTDATA, compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert compare(spark, QUERIES[name], ORACLES[name])


def test_k_means_segments(spark):
    rows = QUERIES["k_means_segments"](spark, TESTDATA).collect()
    assert len(rows) == QUERIES["rfm"](spark, TESTDATA).count()
    means = {label: [r.monetary for r in rows if r.segment_label == label] for label in LABELS}
    means = [sum(v) / len(v) for v in means.values()]
    assert means == sorted(means)


def test_models(spark):
    parts = QUERIES["train_test_split"](spark, TESTDATA)
    tests = parts.where("part = 'test'").count()
    for name in ("sarima_forecast", "yearly_forecast"):
        rows = QUERIES[name](spark, TESTDATA).collect()
        assert len(rows) == tests and all(abs(r.prediction) < 1e4 for r in rows)
    rows = QUERIES["model_comparison"](spark, TESTDATA).collect()
    assert sorted(r.run_name for r in rows) == ["Boosted_Trees", "SARIMA_Baseline", "Yearly_Trend"]
    assert all(0 <= r.mape < 100 and r.rmse >= 0 for r in rows)
    assert len(QUERIES["gbt_forecast"](spark, TESTDATA).collect()) == tests
    runs = QUERIES["saved_model_runs"](spark, TESTDATA).collect()
    assert {r.kind for r in runs} == {"param", "metric", "artifact"}


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() == 2024
