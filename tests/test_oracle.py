"""Every query of the plans beside its SQL on the smallest tables."""

import pytest

from oracle import SF, connect, differences

import __spark_entry__
from argusframe.plans.tables import FLOWS

SQL = {name: sql for plan in __spark_entry__.PLANS for name, sql in plan.ORACLE_SQL.items()}
QUERIES = {name: f for plan in __spark_entry__.PLANS for name, f in plan.QUERIES.items()}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, SQL[name]) == []


def test_every_query_without_sql_has_its_invariants():
    assert set(QUERIES) - set(SQL) == {"m01_calibrated_scores", "m02_model_evaluation", "m03_pe_features", "m05_trained_scan", "m06_sequence_scores", "q81_approx_distinct"}


def test_calibrated_scores(spark):
    rows = QUERIES["m01_calibrated_scores"](spark, SF).toPandas()
    assert rows.score.between(0, 1).all() and len(rows) == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    by_margin = rows.sort_values("margin").score  # labels of the smallest table may be noise, so the slope's sign is open
    assert by_margin.is_monotonic_increasing or by_margin.is_monotonic_decreasing
    cal = rows[rows.split == "cal"]
    assert abs(cal.score.mean() - cal.label.mean()) < 0.02  # a logistic fit with an intercept keeps the mean


def test_model_evaluation(spark):
    rows = QUERIES["m02_model_evaluation"](spark, SF).toPandas().sort_values("target")
    assert list(rows.target) == [0.01, 0.05, 0.1] and rows.n.nunique() == 1
    assert rows.fp.is_monotonic_increasing and rows.tp.is_monotonic_increasing and rows.threshold.is_monotonic_decreasing
    assert (rows.fp + rows.tp <= rows.n).all()


def test_vectors_of_other_files(spark):
    rows = QUERIES["m03_pe_features"](spark, SF).toPandas()
    assert not rows.is_pe.any() and (rows.n_features == 2568).all() and (rows.degraded == "").all() and rows.histogram_sum.isin([0.0, 1.0]).all()


def test_trained_scan(spark):
    rows = QUERIES["m05_trained_scan"](spark, SF).toPandas()
    scored = rows[rows.static_score.notna()]
    assert len(rows) == 200 and len(scored) > 50 and scored.static_score.between(0, 1).all()
    assert scored.static.isin(["ALLOW", "ALERT", "BLOCK"]).all() and (rows[rows.static == "ERROR"].reason_codes.str.contains("path_not_found|invalid_or_non_pe_file|file_too_large")).all()


def test_sequence_scores(spark):
    rows = QUERIES["m06_sequence_scores"](spark, SF).toPandas()
    assert rows.score.between(0, 1).all() and rows.sort_values("margin").score.is_monotonic_increasing and not rows.user_id.duplicated().any()


def test_approximate_distinct_is_near(spark, con):
    about = QUERIES["q81_approx_distinct"](spark, SF).first().n_about
    exact = con.execute(f"WITH {FLOWS} SELECT count(DISTINCT vec) FROM flows").fetchone()[0]
    assert abs(about - exact) <= 4 * 0.02 * exact  # four standard errors


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 200
