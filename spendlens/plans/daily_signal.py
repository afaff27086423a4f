"""Signal validation over the dense daily grid (stages 0-10) on ``tx_daily`` (events)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import MANUAL_CATEGORY_RULES
from ..functions.expr import count_if, median, share
from ..operators import profile, stats
from ..operators.categories import collapse_categories, top_labels
from ..operators.grid import daily_grid_full, daily_grid_observed
from ..sources.tables import oracle_with, table, tx_daily
from . import shared
from .registry import register, rounded
from .sqlfmt import corr_sql, select_rounded

TOP_N = 20
FOCUS = ["click", "purchase", "view"]
LAGS = (1, 7, 30)

_TX_SQL = oracle_with("tx_daily") + f""",
keep AS (SELECT raw_category FROM tx_daily GROUP BY raw_category
         ORDER BY count(*) DESC, raw_category LIMIT {TOP_N}),
tx AS (SELECT t.user_id, t.event_date, t.amount, t.raw_category,
              CASE WHEN k.raw_category IS NULL THEN 'other' ELSE t.raw_category END AS category
       FROM tx_daily t LEFT JOIN keep k ON t.raw_category = k.raw_category)"""
_GRID_SQL = _TX_SQL + """,
daily AS (SELECT user_id, category, event_date, sum(amount) AS amount FROM tx GROUP BY ALL),
bounds AS (SELECT min(event_date) AS d0, max(event_date) AS d1 FROM daily),
pairs AS (SELECT DISTINCT user_id, category FROM daily),
days AS (SELECT CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS event_date FROM bounds),
grid AS (SELECT p.user_id, p.category, d.event_date, coalesce(x.amount, 0.0) AS amount
         FROM pairs p CROSS JOIN days d
         LEFT JOIN daily x ON x.user_id = p.user_id AND x.category = p.category AND x.event_date = d.event_date)
"""
_SP_SQL = _GRID_SQL + """,
sp AS (SELECT user_id, category, avg(CASE WHEN amount > 0 THEN 1.0 ELSE 0.0 END) * 100.0 AS active_days_pct
       FROM grid GROUP BY user_id, category)
"""
_AC_SQL = _SP_SQL + """,
lg AS (SELECT user_id, category, amount AS x, lag(amount, 1) OVER w AS l1, lag(amount, 7) OVER w AS l7,
              lag(amount, 30) OVER w AS l30
       FROM grid WINDOW w AS (PARTITION BY user_id, category ORDER BY event_date)),
ac AS (SELECT user_id, category,
  """ + ",\n  ".join(
    f"CASE WHEN count(*) > {k + 1} AND var_samp(x) > 1e-8 AND stddev_samp(x) > 1e-8 THEN {corr_sql('x', f'l{k}')} END AS corr_lag{k}"
    for k in LAGS) + """
  FROM lg GROUP BY user_id, category)
"""
_FC_SQL = _GRID_SQL + """,
fc AS (SELECT user_id, category, event_date, amount,
         CASE WHEN count(amount) OVER f7 = 7 THEN sum(amount) OVER f7 END AS y,
         avg(amount) OVER (PARTITION BY user_id, category) * 7.0 AS pred_mean,
         avg(amount) OVER (PARTITION BY user_id, category ORDER BY event_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) * 7.0 AS pred_roll7,
         amount * 7.0 AS pred_last
       FROM grid WINDOW f7 AS (PARTITION BY user_id, category ORDER BY event_date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)),
lf AS (SELECT user_id, category, y, 'mean_predictor' AS baseline, pred_mean AS pred FROM fc WHERE y IS NOT NULL
       UNION ALL SELECT user_id, category, y, 'rolling_mean_7', pred_roll7 FROM fc WHERE y IS NOT NULL
       UNION ALL SELECT user_id, category, y, 'last_value', pred_last FROM fc WHERE y IS NOT NULL),
nf AS (SELECT user_id, category, baseline, count(*) AS n_points, avg(abs(pred - y)) AS mae,
              sqrt(avg((pred - y) * (pred - y))) AS rmse FROM lf GROUP BY ALL)
"""
_EV_SQL = _GRID_SQL + """,
e AS (SELECT user_id, category, CAST(amount > 0 AS DOUBLE) AS y,
             lag(CAST(amount > 0 AS DOUBLE)) OVER w AS p, lag(CAST(amount > 0 AS DOUBLE), 7) OVER w AS p7
      FROM grid WINDOW w AS (PARTITION BY user_id, category ORDER BY event_date)),
eb AS (SELECT user_id, category, avg(y) AS event_rate,
         CASE WHEN count(*) > 2 AND var_samp(y) > 1e-8 AND stddev_samp(y) > 1e-8 THEN """ + corr_sql("y", "p") + """ END AS corr_lag1,
         CASE WHEN count(*) > 8 AND var_samp(y) > 1e-8 AND stddev_samp(y) > 1e-8 THEN """ + corr_sql("y", "p7") + """ END AS corr_lag7,
         avg(CASE WHEN p = 0 THEN y END) AS p_event_given_prev0, avg(CASE WHEN p = 1 THEN y END) AS p_event_given_prev1,
         count(p) AS n_points,
         CAST(sum(CASE WHEN p IS NOT NULL AND y = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS n1,
         CAST(sum(CASE WHEN p IS NOT NULL AND y = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS n0
       FROM e GROUP BY user_id, category),
ev AS (SELECT user_id, category, event_rate, corr_lag1, corr_lag7, p_event_given_prev0, p_event_given_prev1,
         CASE WHEN n_points > 0 THEN n_points END AS n_points,
         CASE WHEN n_points > 0 THEN n0 / n_points END AS always_0_accuracy,
         CASE WHEN n_points > 0 THEN (CASE WHEN event_rate >= 0.5 THEN n1 / n_points ELSE n0 / n_points END) END AS frequency_accuracy,
         CASE WHEN n_points > 0 THEN 0.5 * ((CASE WHEN event_rate >= 0.5 THEN n1 ELSE 0.0 END) / greatest(n1, 1.0)
                                        + (CASE WHEN event_rate >= 0.5 THEN 0.0 ELSE n0 END) / greatest(n0, 1.0)) END AS frequency_balanced_accuracy
       FROM eb)
"""


def tx_of(spark, sf_dir) -> DataFrame:
    return collapse_categories(tx_daily(spark, sf_dir), mode="top", top_n=TOP_N)


def grid_of(spark, sf_dir) -> DataFrame:
    return shared.frame(spark, "daily_grid", sf_dir, lambda: daily_grid_observed(tx_of(spark, sf_dir)))


@register("A1_sanity_profile", oracle_with("tx_daily") + """,
per AS (SELECT user_id, count(*) AS n FROM tx_daily GROUP BY user_id)
SELECT (SELECT count(*) FROM tx_daily) AS rows, (SELECT count(DISTINCT user_id) FROM tx_daily) AS users,
       (SELECT min(event_date) FROM tx_daily) AS min_date, (SELECT max(event_date) FROM tx_daily) AS max_date,
       round(avg(n), 4) AS avg_tx_per_user, round(quantile_cont(n, 0.5), 4) AS median_tx_per_user,
       CAST(sum(CASE WHEN n >= 200 THEN 1 ELSE 0 END) AS BIGINT) AS users_with_200plus_tx,
       round(avg(CASE WHEN n >= 200 THEN 1.0 ELSE 0.0 END), 6) AS share_users_with_200plus_tx FROM per""")
def a1(spark, sf_dir):
    return rounded(profile.sanity_profile(tx_daily(spark, sf_dir)), overrides={"share_users_with_200plus_tx": 6})


@register("A2_category_profile", _TX_SQL + """
SELECT count(DISTINCT raw_category) AS raw_unique_categories, count(DISTINCT category) AS collapsed_unique_categories FROM tx""")
def a2(spark, sf_dir):
    return profile.category_profile(tx_of(spark, sf_dir))


@register("A2_top_collapsed", _TX_SQL + """
SELECT category, count(*) AS n FROM tx GROUP BY category ORDER BY n DESC, category LIMIT 10""")
def a2t(spark, sf_dir):
    return top_labels(tx_of(spark, sf_dir), "category", 10)


@register("K1_top_categories", oracle_with("tx_daily") + """
SELECT raw_category, count(*) AS n FROM tx_daily GROUP BY raw_category ORDER BY n DESC, raw_category LIMIT 10""")
def k1(spark, sf_dir):
    return top_labels(tx_daily(spark, sf_dir), "raw_category", 10)


def _manual_sql(c: str) -> str:
    parts = []
    for label, keys in MANUAL_CATEGORY_RULES:
        cond = " OR ".join(f"contains(lower({c}), '{k}')" for k in keys)
        parts.append(f"WHEN {cond} THEN '{label}'")
    return "CASE " + " ".join(parts) + " ELSE 'other' END"


@register("P8_collapse_manual", "SELECT p_partkey, p_name, " + _manual_sql("p_name") + " AS category FROM part")
def p8(spark, sf_dir):
    part = table(spark, sf_dir, "part", ["p_partkey", "p_name"])
    return collapse_categories(part, "manual", src="p_name")


@register("P9_collapse_top_n", """
WITH keep AS (SELECT p_type FROM part GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 3)
SELECT p.p_partkey, CASE WHEN k.p_type IS NULL THEN 'other' ELSE p.p_type END AS category
FROM part p LEFT JOIN keep k ON p.p_type = k.p_type""")
def p9(spark, sf_dir):
    part = table(spark, sf_dir, "part", ["p_partkey", "p_type"])
    return collapse_categories(part, "top", top_n=3, src="p_type").select("p_partkey", "category")


@register("J1_daily_grid_full", _TX_SQL + """,
daily AS (SELECT user_id, category, event_date, sum(amount) AS amount FROM tx GROUP BY ALL),
bounds AS (SELECT min(event_date) AS d0, max(event_date) AS d1 FROM daily),
users AS (SELECT DISTINCT user_id FROM daily), cats AS (SELECT DISTINCT category FROM daily),
days AS (SELECT CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS event_date FROM bounds)
SELECT u.user_id, c.category, d.event_date, round(coalesce(x.amount, 0.0), 4) AS amount
FROM users u CROSS JOIN cats c CROSS JOIN days d
LEFT JOIN daily x ON x.user_id = u.user_id AND x.category = c.category AND x.event_date = d.event_date""")
def j1(spark, sf_dir):
    return rounded(daily_grid_full(tx_of(spark, sf_dir)))


@register("J2_daily_grid_observed", _GRID_SQL + "SELECT user_id, category, event_date, round(amount, 4) AS amount FROM grid")
def j2(spark, sf_dir):
    return rounded(grid_of(spark, sf_dir))


@register("A3_sparsity", _SP_SQL + "SELECT user_id, category, round(active_days_pct, 4) AS active_days_pct FROM sp")
def a3_sparsity(spark, sf_dir):
    return rounded(profile.sparsity(grid_of(spark, sf_dir)))


@register("A3_sparsity_summary", _SP_SQL + """
SELECT round(quantile_cont(active_days_pct, 0.5), 4) AS median_active_days_pct,
       round(avg(CASE WHEN active_days_pct < 20 THEN 1.0 ELSE 0.0 END), 6) AS share_pairs_below_20pct,
       round(avg(CASE WHEN active_days_pct >= 20 AND active_days_pct < 50 THEN 1.0 ELSE 0.0 END), 6) AS share_pairs_20_to_50pct,
       round(avg(CASE WHEN active_days_pct >= 50 THEN 1.0 ELSE 0.0 END), 6) AS share_pairs_50plus_pct FROM sp""")
def a3_summary(spark, sf_dir):
    s = profile.sparsity_summary(profile.sparsity(grid_of(spark, sf_dir)))
    return rounded(s, 6, {"median_active_days_pct": 4})


@register("A4_distribution", _GRID_SQL + """
SELECT round(avg(CASE WHEN amount = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share, round(avg(amount), 4) AS mean,
       round(quantile_cont(amount, 0.5), 4) AS median, round(quantile_cont(amount, 0.95), 4) AS p95,
       round(quantile_cont(amount, 0.99), 4) AS p99, round(skewness(amount), 4) AS skewness FROM grid""")
def a4(spark, sf_dir):
    return rounded(stats.distribution(grid_of(spark, sf_dir)), overrides={"zero_share": 6})


def _hist_sql(expr: str, label: str, bins: int = 80) -> str:
    return _GRID_SQL + f""",
hx AS (SELECT {expr} AS x FROM grid WHERE amount IS NOT NULL),
mm AS (SELECT min(x) AS lo, max(x) AS hi FROM hx),
hb AS (SELECT CAST(least({bins - 1}, floor((x - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END) * {bins})) AS INT) AS bin,
              lo, (CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END) AS width FROM hx, mm)
SELECT '{label}' AS series, bin, round(any_value(lo) + bin * (any_value(width) / {bins}), 4) AS bin_lo, count(*) AS n
FROM hb GROUP BY bin"""


@register("A5_histogram", _hist_sql("amount", "amount"))
def a5(spark, sf_dir):
    return rounded(stats.histogram(grid_of(spark, sf_dir), "amount", 80, label="amount"))


@register("A5_histogram_log1p", _hist_sql("ln(1 + amount)", "log1p_amount"))
def a5_log(spark, sf_dir):
    return rounded(stats.histogram(grid_of(spark, sf_dir), "amount", 80, log1p=True, label="log1p_amount"))


@register("Q1_autocorr", _AC_SQL + select_rounded("ac", [f"corr_lag{k}" for k in LAGS], ["user_id", "category"], 6))
def q1(spark, sf_dir):
    return rounded(stats.autocorr(grid_of(spark, sf_dir), lags=LAGS), 6)


@register("Q2_autocorr_summary", _AC_SQL + """
SELECT """ + ", ".join(f"round(quantile_cont(corr_lag{k}, 0.5), 6) AS median_corr_lag{k}" for k in LAGS) + """,
  round(avg(CASE WHEN corr_lag7 IS NOT NULL THEN (CASE WHEN corr_lag7 < 0.1 THEN 1.0 ELSE 0.0 END) END), 6) AS share_lag7_below_0_1,
  round(avg(CASE WHEN corr_lag7 IS NOT NULL THEN (CASE WHEN corr_lag7 >= 0.1 AND corr_lag7 < 0.3 THEN 1.0 ELSE 0.0 END) END), 6) AS share_lag7_0_1_to_0_3,
  round(avg(CASE WHEN corr_lag7 IS NOT NULL THEN (CASE WHEN corr_lag7 >= 0.3 THEN 1.0 ELSE 0.0 END) END), 6) AS share_lag7_0_3_plus
FROM ac""")
def q2(spark, sf_dir):
    return rounded(stats.autocorr_summary(stats.autocorr(grid_of(spark, sf_dir), lags=LAGS), LAGS), 6)


@register("Q3_naive_forecasts", _FC_SQL + select_rounded("nf", ["mae", "rmse"], ["user_id", "category", "baseline", "n_points"]))
def q3(spark, sf_dir):
    return rounded(stats.naive_forecasts(grid_of(spark, sf_dir)))


@register("A13_baseline_summary", _FC_SQL + """
SELECT baseline, round(avg(mae), 4) AS mae, round(avg(rmse), 4) AS rmse, count(*) AS n_series FROM nf GROUP BY baseline""")
def a13(spark, sf_dir):
    return rounded(stats.baseline_summary(stats.naive_forecasts(grid_of(spark, sf_dir))))


_TV_SQL = _FC_SQL + """,
tv AS (SELECT user_id, category, CASE WHEN count(y) >= 3 THEN """ + corr_sql("y", "(CASE WHEN y IS NOT NULL THEN pred_roll7 END)") + """ END AS corr_target_vs_roll7
       FROM fc GROUP BY user_id, category)
"""


@register("Q4_target_vs_rolling_corr", _TV_SQL + select_rounded("tv", ["corr_target_vs_roll7"], ["user_id", "category"], 6))
def q4(spark, sf_dir):
    return rounded(stats.target_vs_rolling_corr(grid_of(spark, sf_dir)), 6)


@register("Q4_target_corr_summary", _TV_SQL + """
SELECT round(quantile_cont(corr_target_vs_roll7, 0.5), 6) AS median_corr,
       round(avg(CASE WHEN corr_target_vs_roll7 IS NOT NULL THEN (CASE WHEN corr_target_vs_roll7 >= 0.9 THEN 1.0 ELSE 0.0 END) END), 6) AS share_corr_0_9_plus
FROM tv""")
def q4s(spark, sf_dir):
    return rounded(stats.target_corr_summary(stats.target_vs_rolling_corr(grid_of(spark, sf_dir))), 6)


_UV_SQL = _GRID_SQL + """,
ud AS (SELECT user_id, event_date, sum(amount) AS d FROM grid GROUP BY ALL),
us AS (SELECT user_id, avg(d) AS daily_mean, stddev_samp(d) AS daily_std, quantile_cont(d, 0.5) AS daily_median
       FROM ud GROUP BY user_id)
"""


@register("A14_user_variance", _UV_SQL + select_rounded("us", ["daily_mean", "daily_std", "daily_median"], ["user_id"]))
def a14(spark, sf_dir):
    return rounded(stats.user_variance(grid_of(spark, sf_dir)))


@register("A14_user_variance_summary", _UV_SQL + """,
prof AS (SELECT user_id, category, avg(amount) AS m FROM grid GROUP BY ALL),
pc AS (SELECT category, sum(m) AS s1, sum(m * m) AS s2 FROM prof GROUP BY category),
nu AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM us)
SELECT round((SELECT stddev_samp(daily_mean) / (avg(daily_mean) + 1e-9) FROM us), 4) AS cv_daily_mean_spend,
       round(avg(CASE WHEN n > 1 THEN (s2 - s1 * s1 / n) / (n - 1) END), 4) AS between_user_category_variance
FROM pc, nu""")
def a14s(spark, sf_dir):
    grid = grid_of(spark, sf_dir)
    return rounded(stats.user_variance_summary(grid, stats.user_variance(grid)))


@register("A15_category_signal", _AC_SQL + """,
a AS (SELECT category, quantile_cont(active_days_pct, 0.5) AS active_days_pct FROM sp GROUP BY category),
b AS (SELECT category, quantile_cont(corr_lag7, 0.5) AS corr_lag7 FROM ac GROUP BY category)
SELECT coalesce(a.category, b.category) AS category, round(a.active_days_pct, 4) AS active_days_pct,
       round(b.corr_lag7, 6) AS corr_lag7
FROM a FULL OUTER JOIN b ON a.category = b.category
WHERE coalesce(a.category, b.category) IN (""" + ", ".join(f"'{c}'" for c in FOCUS) + ")")
def a15(spark, sf_dir):
    grid = grid_of(spark, sf_dir)
    out = stats.category_signal(profile.sparsity(grid), stats.autocorr(grid, lags=LAGS), FOCUS)
    return rounded(out, 4, {"corr_lag7": 6})


@register("Q5_event_analysis", _EV_SQL + select_rounded(
    "ev", ["event_rate", "corr_lag1", "corr_lag7", "p_event_given_prev0", "p_event_given_prev1", "always_0_accuracy",
           "frequency_accuracy", "frequency_balanced_accuracy"], ["user_id", "category", "n_points"], 6))
def q5(spark, sf_dir):
    return rounded(stats.event_analysis(grid_of(spark, sf_dir)), 6)


@register("Q5_event_summary", _EV_SQL + """
SELECT count(*) AS pairs, round(quantile_cont(event_rate, 0.5), 6) AS median_event_rate,
       round(quantile_cont(corr_lag1, 0.5), 6) AS median_corr_lag1, round(quantile_cont(corr_lag7, 0.5), 6) AS median_corr_lag7,
       round(quantile_cont(p_event_given_prev0, 0.5), 6) AS median_p_event_given_prev0,
       round(quantile_cont(p_event_given_prev1, 0.5), 6) AS median_p_event_given_prev1,
       round(avg(always_0_accuracy), 6) AS always_0_accuracy, round(avg(frequency_accuracy), 6) AS frequency_accuracy,
       round(avg(frequency_balanced_accuracy), 6) AS frequency_balanced_accuracy FROM ev""")
def q5s(spark, sf_dir):
    return rounded(stats.event_summary(stats.event_analysis(grid_of(spark, sf_dir))), 6)


@register("Q13_signal_decision", _AC_SQL + """,
s AS (SELECT (SELECT avg(CASE WHEN active_days_pct < 20 THEN 1.0 ELSE 0.0 END) FROM sp) AS sparse_bad,
             (SELECT avg(CASE WHEN corr_lag7 IS NOT NULL THEN (CASE WHEN corr_lag7 < 0.1 THEN 1.0 ELSE 0.0 END) END) FROM ac) AS lag7_bad,
             (SELECT avg(CASE WHEN amount = 0 THEN 1.0 ELSE 0.0 END) FROM grid) AS zero_share)
SELECT CASE WHEN lag7_bad > 0.7 OR sparse_bad > 0.7 THEN 'CASE 1: no_signal'
            WHEN lag7_bad > 0.4 THEN 'CASE 2: weak_signal' ELSE 'CASE 3: good_signal' END AS decision,
       CASE WHEN zero_share >= 0.95 THEN true ELSE false END AS mostly_zero_note,
       round(sparse_bad, 6) AS share_pairs_below_20pct, round(lag7_bad, 6) AS share_lag7_below_0_1,
       round(zero_share, 6) AS zero_share FROM s""")
def q13(spark, sf_dir):
    grid = grid_of(spark, sf_dir)
    sp = profile.sparsity_summary(profile.sparsity(grid)).first()
    ac = stats.autocorr_summary(stats.autocorr(grid, lags=LAGS), LAGS).first()
    return rounded(profile.signal_decision(grid, sp["share_pairs_below_20pct"], ac["share_lag7_below_0_1"]), 6)
