"""Signed-flow weekly data (ingestion -> weekly flows -> 31 features -> regression rows)
on ``tx_flow`` (lineitem mapped to account transactions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import count_if, median, share
from ..operators import flow_features as ff
from ..sources.tables import oracle_with, tx_flow
from . import shared
from .registry import register, rounded
from .sqlfmt import corr_sql, rolling_std_sql, select_rounded

TEST_WEEKS = 12

_WEEKLY_SQL = oracle_with("tx_flow") + """,
txw AS (SELECT *, CAST(date_trunc('week', transaction_date) AS DATE) AS week_start FROM tx_flow),
txw2 AS (SELECT *, CAST(isoyear(week_start) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(week_start) AS VARCHAR), 2, '0') AS week_t,
                CASE WHEN flow_direction = 'inflow' THEN abs(amount_abs) ELSE 0.0 END AS inflow,
                CASE WHEN flow_direction = 'inflow' THEN 0.0 ELSE abs(amount_abs) END AS outflow
         FROM txw),
weekly AS (SELECT user_id, week_start, week_t, sum(inflow) AS weekly_inflow_t, sum(outflow) AS weekly_outflow_t,
                  count(*) AS txn_count_t, count(DISTINCT category) AS category_diversity_t,
                  sum(inflow) - sum(outflow) AS weekly_net_t
           FROM txw2 GROUP BY user_id, week_start, week_t),
sp AS (SELECT week_start AS split_week FROM (SELECT DISTINCT week_start FROM weekly)
       ORDER BY week_start DESC LIMIT 1 OFFSET """ + str(TEST_WEEKS) + """),
thr AS (SELECT quantile_cont(weekly_outflow_t, 0.25) AS s25, quantile_cont(weekly_outflow_t, 0.75) AS s75,
               quantile_cont(weekly_net_t, 0.25) AS n25, quantile_cont(weekly_net_t, 0.75) AS n75
        FROM weekly, sp WHERE week_start <= split_week)
"""

_FEATURES_SQL = _WEEKLY_SQL + """,
b AS (SELECT weekly.*,
        CASE WHEN weekly_outflow_t = 0 THEN 0 WHEN weekly_outflow_t <= s25 THEN 1 WHEN weekly_outflow_t <= s75 THEN 2 ELSE 3 END AS bucket_spend_t,
        CASE WHEN weekly_net_t = 0 THEN 0 WHEN weekly_net_t <= n25 THEN 1 WHEN weekly_net_t <= n75 THEN 2 ELSE 3 END AS bucket_net_t,
        CAST(weekofyear(week_start) AS INT) AS week_of_year, CAST(month(week_start) AS INT) AS month,
        CAST(quarter(week_start) AS INT) AS quarter,
        CAST(1 + floor((day(week_start) - 1) / 7) AS INT) AS week_of_month,
        CAST(day(week_start) <= 7 AS INT) AS is_month_start_week,
        CAST(datediff('day', week_start + 6, last_day(week_start + 6)) <= 6 AS INT) AS is_month_end_week,
        row_number() OVER (PARTITION BY user_id ORDER BY week_start) AS rn
      FROM weekly, thr),
f AS (SELECT b.*,
        lead(weekly_outflow_t) OVER w AS target_spend_t_plus_1,
        lead(weekly_net_t) OVER w AS target_net_t_plus_1,
        lead(bucket_spend_t) OVER w AS bucket_spend_t_plus_1,
        lead(bucket_net_t) OVER w AS bucket_net_t_plus_1,
        coalesce(lag(weekly_inflow_t) OVER w, 0.0) AS weekly_inflow_t_minus_1,
        coalesce(lag(weekly_outflow_t) OVER w, 0.0) AS weekly_outflow_t_minus_1,
        coalesce(lag(weekly_net_t) OVER w, 0.0) AS weekly_net_t_minus_1,
        coalesce(lag(weekly_inflow_t, 2) OVER w, 0.0) AS weekly_inflow_t_minus_2,
        coalesce(lag(weekly_outflow_t, 2) OVER w, 0.0) AS weekly_outflow_t_minus_2,
        weekly_inflow_t - coalesce(lag(weekly_inflow_t) OVER w, 0.0) AS delta_inflow,
        weekly_outflow_t - coalesce(lag(weekly_outflow_t) OVER w, 0.0) AS delta_outflow,
        greatest(0.0, least(10.0, weekly_inflow_t / (weekly_outflow_t + 1e-6))) AS inflow_outflow_ratio,
        greatest(0.0, least(1.0, weekly_inflow_t / (weekly_inflow_t + weekly_outflow_t + 1e-6))) AS inflow_share,
        coalesce(avg(weekly_inflow_t) OVER p8, 0.0) AS inflow_rolling_mean_8w,
        coalesce(""" + rolling_std_sql("weekly_inflow_t", 8, "w") + """, 0.0) AS inflow_rolling_std_8w,
        coalesce(avg(weekly_outflow_t) OVER p8, 0.0) AS outflow_rolling_mean_8w,
        coalesce(""" + rolling_std_sql("weekly_outflow_t", 8, "w") + """, 0.0) AS outflow_rolling_std_8w,
        coalesce(sum(CASE WHEN weekly_inflow_t > 0 THEN 1 ELSE 0 END) OVER p8, 0) / least(rn, 8) AS inflow_frequency_8w,
        coalesce(sum(CASE WHEN weekly_outflow_t > 0 THEN 1 ELSE 0 END) OVER p8, 0) / least(rn, 8) AS outflow_frequency_8w,
        CAST(coalesce(least(52, rn - 1 - last_value(CASE WHEN weekly_inflow_t > 0 THEN rn END IGNORE NULLS) OVER p2), 52) AS DOUBLE) AS weeks_since_inflow,
        CAST(coalesce(least(52, rn - 1 - last_value(CASE WHEN weekly_outflow_t > 0 THEN rn END IGNORE NULLS) OVER p2), 52) AS DOUBLE) AS weeks_since_outflow,
        coalesce(weekly_outflow_t / nullif(weekly_inflow_t, 0), 0.0) AS outflow_inflow_ratio_t,
        CAST(week_start > (SELECT split_week FROM sp) AS INT) AS is_test
      FROM b
      WINDOW w AS (PARTITION BY user_id ORDER BY week_start),
             p8 AS (PARTITION BY user_id ORDER BY week_start ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING),
             p2 AS (PARTITION BY user_id ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING))
"""

_F_INTS = ["bucket_spend_t", "bucket_net_t", "week_of_year", "month", "quarter", "week_of_month",
           "is_month_start_week", "is_month_end_week", "bucket_spend_t_plus_1", "bucket_net_t_plus_1", "is_test"]
_F_OTHER = ["user_id", "week_start", "week_t", "txn_count_t", "category_diversity_t"] + _F_INTS
_F_DOUBLES = [c for c in ff.FLOW_FEATURES_31 if c not in _F_OTHER] + ["target_spend_t_plus_1", "target_net_t_plus_1"]
# Means of <= 8 two-decimal amounts are exact at 6 digits; 4 digits would hit rounding ties.
MEAN_DIGITS = {c: 6 for c in ("inflow_rolling_mean_8w", "outflow_rolling_mean_8w", "rolling_mean_4")}


def weekly_of(spark, sf_dir):
    return shared.frame(spark, "weekly_flows", sf_dir, lambda: ff.weekly_flows(tx_flow(spark, sf_dir)))


def split_week_of(spark, sf_dir):
    return shared.value(spark, "flow_split_week", sf_dir, lambda: ff.holdout_split_week(weekly_of(spark, sf_dir), TEST_WEEKS))


def thresholds_of(spark, sf_dir):
    return shared.value(spark, "flow_thresholds", sf_dir,
                        lambda: ff.train_thresholds(weekly_of(spark, sf_dir), split_week_of(spark, sf_dir)))


@register("P7_normalize_flows", oracle_with("tx_flow") + "\n" + select_rounded(
    "tx_flow", ["amount", "amount_abs"],
    ["user_id", "transaction_date", "category", "flow_direction", "operation", "type", "k_symbol"]))
def p7_normalize_flows(spark, sf_dir):
    return rounded(tx_flow(spark, sf_dir))


@register("A17_weekly_flows", _WEEKLY_SQL + select_rounded(
    "weekly", ["weekly_inflow_t", "weekly_outflow_t", "weekly_net_t"],
    ["user_id", "week_start", "week_t", "txn_count_t", "category_diversity_t"]))
def a17_weekly_flows(spark, sf_dir):
    return rounded(weekly_of(spark, sf_dir))


@register("B10_holdout_split_week", _WEEKLY_SQL + """
SELECT (SELECT split_week FROM sp) AS split_week, CAST(count(DISTINCT week_start) AS BIGINT) AS total_weeks FROM weekly""")
def b10_split(spark, sf_dir):
    wk = weekly_of(spark, sf_dir)
    split = split_week_of(spark, sf_dir)
    return wk.agg(F.lit(split).alias("split_week"), F.countDistinct("week_start").alias("total_weeks"))


@register("B11_train_thresholds", _WEEKLY_SQL + """
SELECT round(s25, 4) AS q25_spend, round(s75, 4) AS q75_spend, round(n25, 4) AS q25_net, round(n75, 4) AS q75_net FROM thr""")
def b11_thresholds(spark, sf_dir):
    thr = thresholds_of(spark, sf_dir)
    row = [(thr["weekly_outflow_t"][0], thr["weekly_outflow_t"][1], thr["weekly_net_t"][0], thr["weekly_net_t"][1])]
    return rounded(spark.createDataFrame(row, "q25_spend double, q75_spend double, q25_net double, q75_net double"))


def features_31(spark, sf_dir):
    split = split_week_of(spark, sf_dir)
    feats = shared.frame(spark, "flow_features_31", sf_dir, lambda: _features_plan(spark, sf_dir))
    return feats, split


def _features_plan(spark, sf_dir):
    return ff.weekly_features_31(weekly_of(spark, sf_dir), split_week_of(spark, sf_dir), thresholds_of(spark, sf_dir))


#: What metrics of labels and baselines read of the feature frame.
LABEL_COLUMNS = ["user_id", "week_start", "week_t", "is_test", "bucket_spend_t", "bucket_net_t", "bucket_spend_t_plus_1", "bucket_net_t_plus_1"]


def labels_of(spark, sf_dir):
    """Keys and buckets of every row of the feature frame; windows of columns that are not read are left out of its plan."""
    return shared.frame(spark, "flow_labels", sf_dir, lambda: _features_plan(spark, sf_dir).select(*LABEL_COLUMNS))


@register("L16_weekly_features_31", _FEATURES_SQL + select_rounded(
    "f", _F_DOUBLES, _F_OTHER, where="bucket_spend_t_plus_1 IS NOT NULL AND target_spend_t_plus_1 IS NOT NULL",
    digits_by=MEAN_DIGITS))
def l16_features(spark, sf_dir):
    feats, _ = features_31(spark, sf_dir)
    return rounded(feats.select(*_F_OTHER, *_F_DOUBLES), overrides=MEAN_DIGITS)


_CAT_SQL = _WEEKLY_SQL + """,
cw AS (SELECT user_id, week_start, week_t, category, flow_direction, sum(amount_abs) AS amount_cat_t,
              count(*) AS txn_count_cat_t FROM txw2 GROUP BY ALL),
cwl AS (SELECT cw.*,
          lag(amount_cat_t) OVER w AS amount_cat_t_minus_1, lag(amount_cat_t, 2) OVER w AS amount_cat_t_minus_2,
          lead(amount_cat_t) OVER w AS amount_cat_t_plus_1,
          avg(amount_cat_t) OVER p4 AS rolling_mean_4, """ + rolling_std_sql("amount_cat_t", 4, "w") + """ AS rolling_std_4
        FROM cw WINDOW w AS (PARTITION BY user_id, category ORDER BY week_start),
                       p4 AS (PARTITION BY user_id, category ORDER BY week_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
uw AS (SELECT user_id, week_start,
          coalesce(lag(weekly_inflow_t) OVER w, 0.0) AS weekly_inflow_t_minus_1,
          coalesce(lag(weekly_outflow_t) OVER w, 0.0) AS weekly_outflow_t_minus_1,
          coalesce(lag(weekly_net_t) OVER w, 0.0) AS weekly_net_t_minus_1
        FROM weekly WINDOW w AS (PARTITION BY user_id ORDER BY week_start)),
reg AS (SELECT c.user_id, c.week_start, c.week_t, c.category, c.flow_direction, c.amount_cat_t, c.txn_count_cat_t,
          coalesce(c.amount_cat_t_minus_1, 0.0) AS amount_cat_t_minus_1,
          coalesce(c.amount_cat_t_minus_2, 0.0) AS amount_cat_t_minus_2,
          c.amount_cat_t_plus_1, coalesce(c.rolling_mean_4, 0.0) AS rolling_mean_4,
          coalesce(c.rolling_std_4, 0.0) AS rolling_std_4,
          u.weekly_inflow_t_minus_1, u.weekly_outflow_t_minus_1, u.weekly_net_t_minus_1,
          CAST(c.week_start > (SELECT split_week FROM sp) AS INT) AS is_test
        FROM cwl c LEFT JOIN uw u ON c.user_id = u.user_id AND c.week_start = u.week_start
        WHERE c.amount_cat_t_plus_1 IS NOT NULL)
"""
_R_DOUBLES = ["amount_cat_t", "amount_cat_t_minus_1", "amount_cat_t_minus_2", "amount_cat_t_plus_1",
              "rolling_mean_4", "rolling_std_4", "weekly_inflow_t_minus_1", "weekly_outflow_t_minus_1",
              "weekly_net_t_minus_1"]
_R_OTHER = ["user_id", "week_start", "week_t", "category", "flow_direction", "txn_count_cat_t", "is_test"]


def regression_rows(spark, sf_dir):
    return shared.frame(spark, "flow_regression_rows", sf_dir, lambda: regression_plan(spark, sf_dir)), regression_split(spark, sf_dir)


def regression_split(spark, sf_dir):
    """The split week from the weeks of the transactions, which are those of the weekly frame."""
    return shared.value(spark, "flow_split_week", sf_dir, lambda: ff.holdout_split_week(ff.with_weeks(tx_flow(spark, sf_dir)), TEST_WEEKS))


def regression_plan(spark, sf_dir):
    """The regression rows for queries that read them once: not kept, and without the windows they do not read."""
    return ff.category_regression_frame(tx_flow(spark, sf_dir), None, regression_split(spark, sf_dir))


@register("A18_weekly_category_flows", _CAT_SQL + select_rounded(
    "cw", ["amount_cat_t"], ["user_id", "week_start", "week_t", "category", "flow_direction", "txn_count_cat_t"]))
def a18(spark, sf_dir):
    return rounded(ff.weekly_category_flows(tx_flow(spark, sf_dir)))


@register("L18_category_regression_frame", _CAT_SQL + select_rounded("reg", _R_DOUBLES, _R_OTHER, digits_by=MEAN_DIGITS))
def l18(spark, sf_dir):
    reg, _ = regression_rows(spark, sf_dir)
    return rounded(reg.select(*_R_OTHER, *_R_DOUBLES), overrides=MEAN_DIGITS)


@register("A33_zero_rate", _CAT_SQL + """
SELECT is_test, round(avg(CASE WHEN amount_cat_t_plus_1 = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_rate_target,
       count(*) AS n_rows FROM reg GROUP BY is_test""")
def a33(spark, sf_dir):
    reg = regression_plan(spark, sf_dir)
    return rounded(reg.groupBy("is_test").agg(share(F.col("amount_cat_t_plus_1") == 0).alias("zero_rate_target"),
                                              F.count(F.lit(1)).alias("n_rows")), 6)


from ..operators.categories import top_labels  # noqa: E402
from ..operators.grid import weekly_category_grid  # noqa: E402


@register("A28_ingestion_profile", oracle_with("tx_flow") + """
SELECT count(*) AS rows, count(DISTINCT user_id) AS users, min(transaction_date) AS date_min, max(transaction_date) AS date_max,
       CAST(sum(CASE WHEN flow_direction = 'inflow' THEN 1 ELSE 0 END) AS BIGINT) AS inflow_rows,
       CAST(sum(CASE WHEN flow_direction = 'outflow' THEN 1 ELSE 0 END) AS BIGINT) AS outflow_rows FROM tx_flow""")
def a28(spark, sf_dir):
    return ff.ingestion_profile(tx_flow(spark, sf_dir))


@register("K1_top_flow_categories", oracle_with("tx_flow") + """
SELECT category, count(*) AS n FROM tx_flow GROUP BY category ORDER BY n DESC, category LIMIT 30""")
def k1f(spark, sf_dir):
    return top_labels(tx_flow(spark, sf_dir), "category", 30)


@register("K2_most_active_users", _WEEKLY_SQL + """,
top AS (SELECT user_id FROM tx_flow GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 20)
SELECT user_id, count(*) AS weeks, round(sum(weekly_outflow_t), 4) AS outflow FROM weekly
WHERE user_id IN (SELECT user_id FROM top) GROUP BY user_id""")
def k2(spark, sf_dir):
    top = top_labels(tx_flow(spark, sf_dir), "user_id", 20).select("user_id")
    wk = weekly_of(spark, sf_dir).join(F.broadcast(top), "user_id", "left_semi")
    return rounded(wk.groupBy("user_id").agg(F.count(F.lit(1)).alias("weeks"), F.sum("weekly_outflow_t").alias("outflow")))


@register("K4_recent_weeks", _WEEKLY_SQL + """,
rw AS (SELECT DISTINCT week_start FROM weekly ORDER BY week_start DESC LIMIT 8)
SELECT week_start, count(*) AS user_weeks, round(sum(weekly_net_t), 4) AS net FROM weekly
WHERE week_start IN (SELECT week_start FROM rw) GROUP BY week_start""")
def k4(spark, sf_dir):
    wk = weekly_of(spark, sf_dir)
    recent = wk.select("week_start").distinct().orderBy(F.desc("week_start")).limit(8)
    sel = wk.join(F.broadcast(recent), "week_start", "left_semi")
    return rounded(sel.groupBy("week_start").agg(F.count(F.lit(1)).alias("user_weeks"), F.sum("weekly_net_t").alias("net")))


@register("A29_weeks_per_user", _WEEKLY_SQL + """,
w AS (SELECT user_id, count(DISTINCT week_t) AS n FROM weekly GROUP BY user_id)
SELECT count(*) AS accounts, round(quantile_cont(n, 0.1), 4) AS p10, round(quantile_cont(n, 0.25), 4) AS p25,
       round(quantile_cont(n, 0.5), 4) AS p50, round(quantile_cont(n, 0.75), 4) AS p75, round(quantile_cont(n, 0.9), 4) AS p90,
       round(avg(CASE WHEN n < 8 THEN 1.0 ELSE 0.0 END), 6) AS lt_8_weeks, round(avg(CASE WHEN n < 12 THEN 1.0 ELSE 0.0 END), 6) AS lt_12_weeks
FROM w""")
def a29(spark, sf_dir):
    return rounded(ff.weeks_per_user(weekly_of(spark, sf_dir)), 4, {"lt_8_weeks": 6, "lt_12_weeks": 6})


@register("A30_volatility_cv", _WEEKLY_SQL + """,
v AS (SELECT user_id, stddev_samp(weekly_outflow_t) / nullif(avg(weekly_outflow_t), 0) AS cv FROM weekly GROUP BY user_id)
SELECT round(quantile_cont(cv, 0.25), 6) AS cv_p25, round(quantile_cont(cv, 0.5), 6) AS cv_p50, round(quantile_cont(cv, 0.75), 6) AS cv_p75 FROM v""")
def a30(spark, sf_dir):
    return rounded(ff.volatility_cv(weekly_of(spark, sf_dir)), 6)


@register("A31_weekly_trend", _WEEKLY_SQL + """
SELECT week_t, round(sum(weekly_outflow_t), 4) AS outflow_sum, round(sum(weekly_inflow_t), 4) AS inflow_sum,
       round(sum(weekly_net_t), 4) AS net_sum FROM weekly GROUP BY week_t""")
def a31(spark, sf_dir):
    return rounded(ff.weekly_trend(weekly_of(spark, sf_dir)))


@register("A31_trend_span", _WEEKLY_SQL + """
SELECT count(DISTINCT week_t) AS weekly_points, min(week_t) AS time_start, max(week_t) AS time_end FROM weekly""")
def a31s(spark, sf_dir):
    t = ff.weekly_trend(weekly_of(spark, sf_dir))
    return t.agg(F.count(F.lit(1)).alias("weekly_points"), F.min("week_t").alias("time_start"), F.max("week_t").alias("time_end"))


@register("Q10_lag_correlations", _WEEKLY_SQL + """,
d AS (SELECT weekly_outflow_t, weekly_net_t, lag(weekly_outflow_t) OVER w AS o1, lag(weekly_net_t) OVER w AS n1,
             lag(weekly_inflow_t) OVER w AS i1, lead(weekly_outflow_t) OVER w AS of1
      FROM weekly WINDOW w AS (PARTITION BY user_id ORDER BY week_start))
SELECT round(coalesce(""" + corr_sql("weekly_outflow_t", "o1", 0.0) + """, 0.0), 6) AS corr_outflow_t_vs_t_minus_1,
       round(coalesce(""" + corr_sql("weekly_net_t", "n1", 0.0) + """, 0.0), 6) AS corr_net_t_vs_t_minus_1,
       round(coalesce(""" + corr_sql("i1", "of1", 0.0) + """, 0.0), 6) AS corr_inflow_t_minus_1_vs_outflow_t_plus_1 FROM d""")
def q10(spark, sf_dir):
    return rounded(ff.lag_correlations(weekly_of(spark, sf_dir)), 6)


@register("A32_category_support", _CAT_SQL + """,
cs AS (SELECT category, count(*) AS support FROM reg GROUP BY category)
SELECT count(*) AS categories_total, round(avg(CASE WHEN support < 50 THEN 1.0 ELSE 0.0 END), 6) AS tail_share_below_50,
       max(support) AS max_support FROM cs""")
def a32(spark, sf_dir):
    reg, _ = regression_rows(spark, sf_dir)
    cs = reg.groupBy("category").agg(F.count(F.lit(1)).alias("support"))
    return rounded(cs.agg(F.count(F.lit(1)).alias("categories_total"),
                          share(F.col("support") < 50).alias("tail_share_below_50"), F.max("support").alias("max_support")), 6)


_DENSE_NUM = ["amount_cat_t", "amount_cat_t_minus_1", "amount_cat_t_minus_2", "rolling_mean_4",
              "rolling_std_4", "weekly_inflow_t_minus_1", "weekly_outflow_t_minus_1", "weekly_net_t_minus_1",
              "amount_cat_t_plus_1"]


def dense_test(spark, sf_dir):
    reg, _ = regression_rows(spark, sf_dir)
    te = reg.where("is_test = 1").withColumn("txn_count_cat_t", F.col("txn_count_cat_t").cast("double"))
    cats = reg.where("is_test = 0").select("category").distinct()
    return weekly_category_grid(te, cats, _DENSE_NUM + ["txn_count_cat_t"], keys=("user_id", "week_start", "week_t"))


_DENSE_SQL = _CAT_SQL + """,
rte AS (SELECT * FROM reg WHERE is_test = 1),
cats AS (SELECT DISTINCT category FROM reg WHERE is_test = 0),
uw2 AS (SELECT DISTINCT user_id, week_start, week_t FROM rte),
dense AS (SELECT u.user_id, u.week_start, u.week_t, c.category, split_part(c.category, ':', 1) AS flow_direction,
               """ + ", ".join(f"coalesce(r.{x}, 0.0) AS {x}" for x in _DENSE_NUM) + """,
               coalesce(CAST(r.txn_count_cat_t AS DOUBLE), 0.0) AS txn_count_cat_t
          FROM uw2 u CROSS JOIN cats c
          LEFT JOIN rte r ON r.user_id = u.user_id AND r.week_start = u.week_start AND r.category = c.category)"""


@register("J3_weekly_category_grid", _DENSE_SQL + "\n" + select_rounded(
    "dense", _DENSE_NUM + ["txn_count_cat_t"], ["user_id", "week_start", "week_t", "category", "flow_direction"],
    digits_by=MEAN_DIGITS))
def j3(spark, sf_dir):
    return rounded(dense_test(spark, sf_dir), overrides=MEAN_DIGITS)


@register("Q17_observed_vs_dense", _DENSE_SQL + """
SELECT 'observed' AS frame, count(*) AS rows, round(avg(CASE WHEN amount_cat_t_plus_1 = 0 THEN 1.0 ELSE 0.0 END), 6) AS target_zero_rate,
       round(avg(abs(amount_cat_t - amount_cat_t_plus_1)), 4) AS persistence_mae, round(avg(abs(rolling_mean_4 - amount_cat_t_plus_1)), 4) AS rolling4_mae
FROM rte
UNION ALL
SELECT 'dense', count(*), round(avg(CASE WHEN amount_cat_t_plus_1 = 0 THEN 1.0 ELSE 0.0 END), 6),
       round(avg(abs(amount_cat_t - amount_cat_t_plus_1)), 4), round(avg(abs(rolling_mean_4 - amount_cat_t_plus_1)), 4) FROM dense""")
def q17(spark, sf_dir):
    reg, _ = regression_rows(spark, sf_dir)
    out = ff.observed_vs_dense(reg.where("is_test = 1"), dense_test(spark, sf_dir))
    return rounded(out, 4, {"target_zero_rate": 6})


@register("Q17_dense_minus_observed", _DENSE_SQL + """,
o AS (SELECT count(*) AS n, avg((amount_cat_t_plus_1 = 0)::INT) AS z, avg(abs(amount_cat_t - amount_cat_t_plus_1)) AS p,
             avg(abs(rolling_mean_4 - amount_cat_t_plus_1)) AS r FROM rte),
d AS (SELECT count(*) AS n, avg((amount_cat_t_plus_1 = 0)::INT) AS z, avg(abs(amount_cat_t - amount_cat_t_plus_1)) AS p,
             avg(abs(rolling_mean_4 - amount_cat_t_plus_1)) AS r, count(DISTINCT category) AS c FROM dense)
SELECT d.n - o.n AS delta_rows, round(d.z - o.z, 6) AS delta_target_zero_rate, round(d.p - o.p, 4) AS delta_persistence_mae,
       round(d.r - o.r, 4) AS delta_rolling4_mae, d.c AS categories FROM d, o""")
def q17d(spark, sf_dir):
    reg, _ = regression_rows(spark, sf_dir)
    dense = dense_test(spark, sf_dir)
    both = ff.observed_vs_dense(reg.where("is_test = 1"), dense)
    names = ["rows", "target_zero_rate", "persistence_mae", "rolling4_mae"]
    sign = F.when(F.col("frame") == "dense", 1).otherwise(-1)
    out = both.agg(*[F.sum(sign * F.col(c)).alias(f"delta_{c}") for c in names])
    out = out.crossJoin(F.broadcast(dense.agg(F.countDistinct("category").alias("categories"))))
    return rounded(out, 4, {"delta_target_zero_rate": 6})


@register("A35_distinct_counts", _CAT_SQL + """
SELECT (SELECT count(*) FROM (SELECT DISTINCT user_id, category FROM cw)) AS user_category_pairs,
       (SELECT count(DISTINCT user_id) FROM tx_flow) AS users, (SELECT count(DISTINCT transaction_date) FROM tx_flow) AS dates,
       (SELECT count(DISTINCT week_start) FROM weekly) AS weeks, (SELECT count(DISTINCT category) FROM tx_flow) AS categories""")
def a35(spark, sf_dir):
    tx = tx_flow(spark, sf_dir)
    cw = ff.weekly_category_flows(tx)
    return tx.agg(F.countDistinct("user_id").alias("users"), F.countDistinct("transaction_date").alias("dates"),
                  F.countDistinct("category").alias("categories")).select(
        F.lit(cw.select("user_id", "category").distinct().count()).cast("bigint").alias("user_category_pairs"),
        "users", "dates", F.lit(weekly_of(spark, sf_dir).select("week_start").distinct().count()).cast("bigint").alias("weeks"),
        "categories")


@register("A37_training_profile", _FEATURES_SQL + """,
ff2 AS (SELECT * FROM f WHERE bucket_spend_t_plus_1 IS NOT NULL AND target_spend_t_plus_1 IS NOT NULL),
c AS (SELECT is_test, bucket_spend_t_plus_1, count(*) AS n FROM ff2 GROUP BY ALL)
SELECT p.is_test, p.rows, p.first_week, p.last_week,
       round(coalesce((SELECT n FROM c WHERE c.is_test = p.is_test AND bucket_spend_t_plus_1 = 0), 0) / p.rows, 6) AS share_0,
       round(coalesce((SELECT n FROM c WHERE c.is_test = p.is_test AND bucket_spend_t_plus_1 = 1), 0) / p.rows, 6) AS share_1,
       round(coalesce((SELECT n FROM c WHERE c.is_test = p.is_test AND bucket_spend_t_plus_1 = 2), 0) / p.rows, 6) AS share_2,
       round(coalesce((SELECT n FROM c WHERE c.is_test = p.is_test AND bucket_spend_t_plus_1 = 3), 0) / p.rows, 6) AS share_3
FROM (SELECT is_test, count(*) AS rows, min(week_t) AS first_week, max(week_t) AS last_week FROM ff2 GROUP BY is_test) p""")
def a37(spark, sf_dir):
    feats, _ = features_31(spark, sf_dir)
    y = F.col("bucket_spend_t_plus_1")
    g = feats.groupBy("is_test").agg(F.count(F.lit(1)).alias("rows"), F.min("week_t").alias("first_week"),
                                     F.max("week_t").alias("last_week"),
                                     *[F.sum(F.when(y == c, 1).otherwise(0)).alias(f"_n{c}") for c in range(4)])
    return rounded(g.select("is_test", "rows", "first_week", "last_week",
                            *[(F.col(f"_n{c}") / F.col("rows")).alias(f"share_{c}") for c in range(4)]), 6)
