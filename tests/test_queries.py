"""Registered queries: entry smoke run and DuckDB oracle parity on the smallest data."""

import math

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]
SAMPLE = ["A3_sparsity", "J2_daily_grid_observed", "Q1_autocorr", "Q3_naive_forecasts", "Q5_event_analysis",
          "B5_tune_thresholds", "A24_transition_matrix", "Q7_user_entropy", "L16_weekly_features_31",
          "L18_category_regression_frame", "A9_user_coverage", "L17_card_features_21", "Q9_ks_statistic",
          "M11_fold_metrics", "M16_leaderboard", "M8_regression_baselines", "Q17_observed_vs_dense"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "active_days_pct" in df.columns


def test_every_query_has_a_callable_and_oracles_are_subset():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 100


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle_parity(spark, duck, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert _canon(rows, df.columns) == _canon(orows, ocols)
