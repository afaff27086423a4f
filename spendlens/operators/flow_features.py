"""Signed-flow weekly operators: A17, A18, B10, B11, L16, L18, J7, T4.

One ``partitionBy(user)`` shuffle feeds every classification window; the
category frame shares one ``partitionBy(user, category)`` shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import bucket_select
from ..functions.calendar import calendar_features, iso_week_label, week_start
from ..functions.clean import fill_zero, inflow_outflow_ratio, inflow_share, ratio_or_zero, split_flows
from . import windows as W
from .ordering import exact_quantiles_multi

# Column order of the 31 model inputs (fixed contract).
FLOW_FEATURES_31 = [
    "bucket_spend_t", "bucket_net_t", "weekly_inflow_t", "weekly_outflow_t", "weekly_net_t",
    "txn_count_t", "category_diversity_t", "weekly_inflow_t_minus_1", "weekly_outflow_t_minus_1",
    "weekly_net_t_minus_1", "weekly_inflow_t_minus_2", "weekly_outflow_t_minus_2", "outflow_inflow_ratio_t",
    "week_of_year", "month", "quarter", "week_of_month", "is_month_start_week", "is_month_end_week",
    "delta_inflow", "delta_outflow", "inflow_outflow_ratio", "inflow_share", "inflow_rolling_mean_8w",
    "inflow_rolling_std_8w", "outflow_rolling_mean_8w", "outflow_rolling_std_8w", "inflow_frequency_8w",
    "outflow_frequency_8w", "weeks_since_inflow", "weeks_since_outflow",
]
# Numeric inputs of the regressors, in order.
REGRESSION_NUMERIC = [
    "amount_cat_t", "txn_count_cat_t", "amount_cat_t_minus_1", "amount_cat_t_minus_2", "rolling_mean_4",
    "rolling_std_4", "weekly_inflow_t_minus_1", "weekly_outflow_t_minus_1", "weekly_net_t_minus_1",
]


def with_weeks(tx: DataFrame, date: str = "transaction_date") -> DataFrame:
    """T1 + T2 on every transaction."""
    return tx.withColumn("week_start", week_start(date)).withColumn("week_t", iso_week_label("week_start"))


def weekly_flows(tx: DataFrame) -> DataFrame:
    """Per (user, Monday, label) inflow, outflow, count, distinct categories, net."""
    fl = split_flows("flow_direction", "amount_abs")
    wk = with_weeks(tx).select("user_id", "week_start", "week_t", "category",
                               fl["inflow"].alias("inflow"), fl["outflow"].alias("outflow"))
    out = wk.groupBy("user_id", "week_start", "week_t").agg(
        F.sum("inflow").alias("weekly_inflow_t"),
        F.sum("outflow").alias("weekly_outflow_t"),
        F.count(F.lit(1)).alias("txn_count_t"),
        F.countDistinct("category").alias("category_diversity_t"),
    )
    return out.withColumn("weekly_net_t", F.col("weekly_inflow_t") - F.col("weekly_outflow_t"))


def holdout_split_week(weekly: DataFrame, test_weeks: int = 12):
    """The (k+1)-th last distinct week; needs more than k+2 distinct weeks."""
    weeks = weekly.select("week_start").distinct()
    rows = weeks.orderBy(F.desc("week_start")).limit(test_weeks + 3).collect()
    if len(rows) <= test_weeks + 2:
        raise RuntimeError("Not enough weekly history for requested split")
    return rows[test_weeks]["week_start"]


def train_thresholds(weekly: DataFrame, split_week, cols=("weekly_outflow_t", "weekly_net_t")) -> dict:
    """q25/q75 of train rows (week_start <= split) per column, applied to all rows."""
    train = weekly.where(F.col("week_start") <= F.lit(split_week))
    q = exact_quantiles_multi(train, list(cols), [0.25, 0.75])
    return {c: tuple(q[c]) for c in cols}


def weekly_features_31(weekly: DataFrame, split_week, thresholds: dict | None = None) -> DataFrame:
    """The 31-input classification frame on the whole timeline, then split.

    Keeps rows that have a next observed week (targets), adds ``is_test``.
    """
    thr = thresholds or train_thresholds(weekly, split_week)
    s25, s75 = thr["weekly_outflow_t"]
    n25, n75 = thr["weekly_net_t"]
    w = W.spec("user_id", "week_start")
    cal = calendar_features("week_start")
    base = weekly.select(
        "*",
        bucket_select("weekly_outflow_t", s25, s75).alias("bucket_spend_t"),
        bucket_select("weekly_net_t", n25, n75).alias("bucket_net_t"),
        *[v.alias(k) for k, v in cal.items()],
    )
    lag1 = {c: W.lag_k(c, w, 1, 0.0) for c in ("weekly_inflow_t", "weekly_outflow_t", "weekly_net_t")}
    feats = base.select(
        "*",
        W.lead_k("weekly_outflow_t", w, 1).alias("target_spend_t_plus_1"),
        W.lead_k("weekly_net_t", w, 1).alias("target_net_t_plus_1"),
        W.lead_k("bucket_spend_t", w, 1).alias("bucket_spend_t_plus_1"),
        W.lead_k("bucket_net_t", w, 1).alias("bucket_net_t_plus_1"),
        lag1["weekly_inflow_t"].alias("weekly_inflow_t_minus_1"),
        lag1["weekly_outflow_t"].alias("weekly_outflow_t_minus_1"),
        lag1["weekly_net_t"].alias("weekly_net_t_minus_1"),
        W.lag_k("weekly_inflow_t", w, 2, 0.0).alias("weekly_inflow_t_minus_2"),
        W.lag_k("weekly_outflow_t", w, 2, 0.0).alias("weekly_outflow_t_minus_2"),
        (F.col("weekly_inflow_t") - lag1["weekly_inflow_t"]).alias("delta_inflow"),
        (F.col("weekly_outflow_t") - lag1["weekly_outflow_t"]).alias("delta_outflow"),
        inflow_outflow_ratio("weekly_inflow_t", "weekly_outflow_t").alias("inflow_outflow_ratio"),
        inflow_share("weekly_inflow_t", "weekly_outflow_t").alias("inflow_share"),
        F.coalesce(W.rolling_mean_prev("weekly_inflow_t", w, 8), F.lit(0.0)).alias("inflow_rolling_mean_8w"),
        F.coalesce(W.rolling_mean_prev("weekly_outflow_t", w, 8), F.lit(0.0)).alias("outflow_rolling_mean_8w"),
        W.frequency_prev("weekly_inflow_t", w, 8).alias("inflow_frequency_8w"),
        W.frequency_prev("weekly_outflow_t", w, 8).alias("outflow_frequency_8w"),
        W.weeks_since_positive("weekly_inflow_t", w, 52).alias("weeks_since_inflow"),
        W.weeks_since_positive("weekly_outflow_t", w, 52).alias("weeks_since_outflow"),
        ratio_or_zero("weekly_outflow_t", "weekly_inflow_t").alias("outflow_inflow_ratio_t"),
    )
    feats = W.add_rolling_std(feats, "weekly_inflow_t", w, 8, "inflow_rolling_std_8w")
    feats = W.add_rolling_std(feats, "weekly_outflow_t", w, 8, "outflow_rolling_std_8w")
    feats = fill_zero(feats, ["inflow_rolling_std_8w", "outflow_rolling_std_8w"])
    feats = feats.where(F.col("bucket_spend_t_plus_1").isNotNull() & F.col("target_spend_t_plus_1").isNotNull())
    return feats.withColumn("is_test", (F.col("week_start") > F.lit(split_week)).cast("int"))


def weekly_category_flows(tx: DataFrame) -> DataFrame:
    """Per (user, week, category, direction) sum of |amount| and count."""
    # The label follows from the week; left out of the keys, it is not shuffled.
    cw = tx.withColumn("week_start", week_start("transaction_date")).groupBy("user_id", "week_start", "category", "flow_direction").agg(
        F.sum("amount_abs").alias("amount_cat_t"), F.count(F.lit(1)).alias("txn_count_cat_t"))
    return cw.select("user_id", "week_start", iso_week_label("week_start").alias("week_t"), "category", "flow_direction", "amount_cat_t", "txn_count_cat_t")


def user_week_lags(weekly: DataFrame) -> DataFrame:
    """Per user-week lag-1 flows (0.0 fill) for J7."""
    w = W.spec("user_id", "week_start")
    return weekly.select(
        "user_id", "week_start",
        W.lag_k("weekly_inflow_t", w, 1, 0.0).alias("weekly_inflow_t_minus_1"),
        W.lag_k("weekly_outflow_t", w, 1, 0.0).alias("weekly_outflow_t_minus_1"),
        W.lag_k("weekly_net_t", w, 1, 0.0).alias("weekly_net_t_minus_1"),
    )


def with_user_week_lags(cw: DataFrame) -> DataFrame:
    """J7 on category-week rows: flows of the user's previous observed week (0.0 fill), summed over that week's categories.

    The windows of a user lie in one partition, so rows dealt by user are not shuffled for them.
    """
    week = W.spec(["user_id", "week_start"], [])
    of = {"inflow": F.col("flow_direction") == "inflow"}
    of["outflow"] = ~F.coalesce(of["inflow"], F.lit(False))
    cw = cw.select("*", *[F.sum(F.when(c, F.col("amount_cat_t")).otherwise(0.0)).over(week).alias(f"_{k}") for k, c in of.items()],
                   F.unix_date("week_start").alias("_day"))
    earlier = W.spec("user_id", "_day").rangeBetween(W.UNB, -1)
    cw = cw.withColumn("_before", F.last(F.struct("_inflow", "_outflow", (F.col("_inflow") - F.col("_outflow")).alias("_net"))).over(earlier))
    return cw.select("*", *[F.coalesce(F.col(f"_before._{k}"), F.lit(0.0)).alias(f"weekly_{k}_t_minus_1") for k in ("inflow", "outflow", "net")]).drop(
        "_inflow", "_outflow", "_day", "_before")


def category_regression_frame(tx: DataFrame, weekly: DataFrame | None, split_week) -> DataFrame:
    """Observed category-week rows with lags, rolling 4, next-week target and
    user-level lags (J7); rows without a next observed week are dropped.

    The user-level lags come from ``weekly``, or without it from the category rows themselves.
    """
    cw = weekly_category_flows(tx)
    if weekly is None:
        cw = cw.repartition("user_id")
    w = W.spec(["user_id", "category"], "week_start")
    cw = cw.select(
        "*",
        W.lag_k("amount_cat_t", w, 1).alias("amount_cat_t_minus_1"),
        W.lag_k("amount_cat_t", w, 2).alias("amount_cat_t_minus_2"),
        W.lead_k("amount_cat_t", w, 1).alias("amount_cat_t_plus_1"),
        W.rolling_mean_prev("amount_cat_t", w, 4).alias("rolling_mean_4"),
    )
    cw = W.add_rolling_std(cw, "amount_cat_t", w, 4, "rolling_std_4")
    reg = with_user_week_lags(cw) if weekly is None else cw.join(user_week_lags(weekly), ["user_id", "week_start"], "left")
    reg = reg.select("user_id", "week_start", *[c for c in reg.columns if c not in ("user_id", "week_start")])
    reg = reg.where(F.col("amount_cat_t_plus_1").isNotNull())
    fill = ["amount_cat_t_minus_1", "amount_cat_t_minus_2", "rolling_mean_4", "rolling_std_4"]
    reg = reg.select(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c in fill else F.col(c) for c in reg.columns])
    return reg.withColumn("is_test", (F.col("week_start") > F.lit(split_week)).cast("int"))


def ingestion_profile(tx: DataFrame) -> DataFrame:
    """Rows, users, date range and flow counts of the signed table (top categories are K1)."""
    return tx.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("user_id").alias("users"),
                  F.min("transaction_date").alias("date_min"), F.max("transaction_date").alias("date_max"),
                  F.sum(F.when(F.col("flow_direction") == "inflow", 1).otherwise(0)).cast("bigint").alias("inflow_rows"),
                  F.sum(F.when(F.col("flow_direction") == "outflow", 1).otherwise(0)).cast("bigint").alias("outflow_rows"))


def weeks_per_user(weekly: DataFrame) -> DataFrame:
    """Distinct weeks per user -> quantiles and shares under 8 and 12 weeks."""
    w = weekly.groupBy("user_id").agg(F.countDistinct("week_t").alias("n"))
    return w.agg(F.count(F.lit(1)).alias("accounts"),
                 *[F.percentile("n", q).alias(f"p{int(q * 100)}") for q in (0.1, 0.25, 0.5, 0.75, 0.9)],
                 F.avg(F.when(F.col("n") < 8, 1.0).otherwise(0.0)).alias("lt_8_weeks"),
                 F.avg(F.when(F.col("n") < 12, 1.0).otherwise(0.0)).alias("lt_12_weeks"))


def volatility_cv(weekly: DataFrame) -> DataFrame:
    """Per-user std/mean of weekly outflow (mean 0 -> NULL), quartiles over users."""
    v = weekly.groupBy("user_id").agg(
        F.try_divide(F.stddev_samp("weekly_outflow_t"), F.when(F.avg("weekly_outflow_t") != 0, F.avg("weekly_outflow_t"))).alias("cv"))
    probs = [0.25, 0.5, 0.75]
    found = exact_quantiles_multi(v, ["cv"], probs)["cv"]
    return v.agg(*[F.lit(x).cast("double").alias(f"cv_p{int(q * 100)}") for q, x in zip(probs, found)])


def weekly_trend(weekly: DataFrame) -> DataFrame:
    """Total outflow / inflow / net per week label."""
    return weekly.groupBy("week_t").agg(F.sum("weekly_outflow_t").alias("outflow_sum"),
                                        F.sum("weekly_inflow_t").alias("inflow_sum"), F.sum("weekly_net_t").alias("net_sum"))


def lag_correlations(weekly: DataFrame) -> DataFrame:
    """Q10: pooled Pearson outflow_t~t-1, net_t~t-1, inflow_{t-1}~outflow_{t+1}; empty -> 0.0."""
    from ..functions.expr import guarded_corr
    w = W.spec("user_id", "week_start")
    d = weekly.select("weekly_outflow_t", "weekly_net_t",
                      W.lag_k("weekly_outflow_t", w, 1).alias("o1"), W.lag_k("weekly_net_t", w, 1).alias("n1"),
                      W.lag_k("weekly_inflow_t", w, 1).alias("i1"), W.lead_k("weekly_outflow_t", w, 1).alias("of1"))
    return d.agg(F.coalesce(guarded_corr("weekly_outflow_t", "o1", 0.0), F.lit(0.0)).alias("corr_outflow_t_vs_t_minus_1"),
                 F.coalesce(guarded_corr("weekly_net_t", "n1", 0.0), F.lit(0.0)).alias("corr_net_t_vs_t_minus_1"),
                 F.coalesce(guarded_corr("i1", "of1", 0.0), F.lit(0.0)).alias("corr_inflow_t_minus_1_vs_outflow_t_plus_1"))


def observed_vs_dense(observed: DataFrame, dense: DataFrame, target: str = "amount_cat_t_plus_1") -> DataFrame:
    """Q17: rows, zero rate, persistence and rolling-4 MAE on observed rows vs the dense grid."""
    def ev(df, kind):
        y = F.col(target)
        return df.agg(F.lit(kind).alias("frame"), F.count(F.lit(1)).alias("rows"),
                      F.avg(F.when(y == 0, 1.0).otherwise(0.0)).alias("target_zero_rate"),
                      F.avg(F.abs(F.col("amount_cat_t") - y)).alias("persistence_mae"),
                      F.avg(F.abs(F.col("rolling_mean_4") - y)).alias("rolling4_mae"))
    return ev(observed, "observed").unionByName(ev(dense, "dense"))
