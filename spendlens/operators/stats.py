"""Time-series and statistical operators.

Per-series statistics are ``groupBy(series)`` on frames that are already hash
partitioned by the series key (the grid), so they add no exchange.  Pearson
correlations are guarded (constant input -> NULL) instead of using ``corr``,
which raises under ANSI on zero variance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import guarded_corr, median, share
from . import windows as W
from .ordering import exact_quantiles_multi, medians, quantile_table, with_prefix_sums

EPS = 1e-8


def autocorr(grid: DataFrame, keys=("user_id", "category"), date="event_date", value="amount",
             lags=(1, 7, 30)) -> DataFrame:
    """Q1: Pearson of (x_t, x_{t-k}) per series; NULL when n <= k+1 or (near) constant."""
    keys = list(keys)
    w = W.spec(keys, date)
    x = F.col(value).cast("double")
    df = grid.select(*keys, x.alias("_x"), *[F.lag(x, k).over(w).alias(f"_l{k}") for k in lags])
    n = F.count(F.lit(1))
    var_ok = (F.var_samp("_x") > EPS) & (F.stddev_samp("_x") > EPS)
    return df.groupBy(*keys).agg(*[
        F.when((n > k + 1) & var_ok, guarded_corr("_x", f"_l{k}", EPS)).alias(f"corr_lag{k}") for k in lags])


def autocorr_summary(ac: DataFrame, lags=(1, 7, 30), ref_lag: int = 7) -> DataFrame:
    """Q2: median per lag; shares of the reference lag below 0.1, 0.1-0.3, >= 0.3 among non-null."""
    r = F.col(f"corr_lag{ref_lag}")
    nn = r.isNotNull()
    return ac.agg(
        *medians(ac, {f"median_corr_lag{k}": f"corr_lag{k}" for k in lags}).values(),
        F.avg(F.when(nn, F.when(r < 0.1, 1.0).otherwise(0.0))).alias("share_lag7_below_0_1"),
        F.avg(F.when(nn, F.when((r >= 0.1) & (r < 0.3), 1.0).otherwise(0.0))).alias("share_lag7_0_1_to_0_3"),
        F.avg(F.when(nn, F.when(r >= 0.3, 1.0).otherwise(0.0))).alias("share_lag7_0_3_plus"),
    )


def with_forecast_columns(grid: DataFrame, keys=("user_id", "category"), date="event_date",
                          value="amount") -> DataFrame:
    """W1 + W7 + series mean: target and the three naive predictions per row."""
    keys = list(keys)
    w = W.spec(keys, date)
    return grid.select(
        *keys, date, value,
        W.future_sum(value, w, 7).alias("y"),
        (F.avg(value).over(Window.partitionBy(*keys)) * 7.0).alias("pred_mean"),
        (W.rolling_mean_incl(value, w, 7) * 7.0).alias("pred_roll7"),
        (F.col(value) * 7.0).alias("pred_last"),
    )


def naive_forecasts(grid: DataFrame, keys=("user_id", "category"), date="event_date", value="amount") -> DataFrame:
    """Q3: MAE and RMSE per series and baseline on rows with a complete 7-day target."""
    keys = list(keys)
    fc = with_forecast_columns(grid, keys, date, value).where(F.col("y").isNotNull())
    long = fc.select(*keys, "y", F.expr(
        "stack(3, 'mean_predictor', pred_mean, 'rolling_mean_7', pred_roll7, 'last_value', pred_last) AS (baseline, pred)"))
    err = F.col("pred") - F.col("y")
    return long.groupBy(*keys, "baseline").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
    )


def baseline_summary(fc: DataFrame) -> DataFrame:
    """Unweighted mean MAE / RMSE over series per baseline."""
    return fc.groupBy("baseline").agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"),
                                      F.count(F.lit(1)).alias("n_series"))


def target_vs_rolling_corr(grid: DataFrame, keys=("user_id", "category"), date="event_date",
                           value="amount") -> DataFrame:
    """Q4: Pearson(target 7d sum, 7 x rolling mean) per series, NULL under 3 rows or constant."""
    keys = list(keys)
    fc = with_forecast_columns(grid, keys, date, value)
    y = F.col("y")
    r = F.when(y.isNotNull(), F.col("pred_roll7"))
    return fc.groupBy(*keys).agg(
        F.when(F.count(y) >= 3, guarded_corr(y, r, EPS)).alias("corr_target_vs_roll7"))


def target_corr_summary(tv: DataFrame) -> DataFrame:
    c = F.col("corr_target_vs_roll7")
    return tv.agg(medians(tv, {"median_corr": "corr_target_vs_roll7"})["median_corr"],
                  F.avg(F.when(c.isNotNull(), F.when(c >= 0.9, 1.0).otherwise(0.0))).alias("share_corr_0_9_plus"))


def event_analysis(grid: DataFrame, keys=("user_id", "category"), date="event_date", value="amount") -> DataFrame:
    """Q5: event (amount>0) persistence per series and the trivial event predictors.

    Baseline columns are NULL for a series without a single (prev, curr) transition.
    """
    keys = list(keys)
    w = W.spec(keys, date)
    y = (F.col(value) > 0).cast("double")
    df = grid.select(*keys, y.alias("_y"), F.lag(y, 1).over(w).alias("_p"), F.lag(y, 7).over(w).alias("_p7"))
    n = F.count(F.lit(1))
    var_ok = (F.var_samp("_y") > EPS) & (F.stddev_samp("_y") > EPS)
    base = df.groupBy(*keys).agg(
        F.avg("_y").alias("event_rate"),
        F.when((n > 2) & var_ok, guarded_corr("_y", "_p", EPS)).alias("corr_lag1"),
        F.when((n > 8) & var_ok, guarded_corr("_y", "_p7", EPS)).alias("corr_lag7"),
        F.avg(F.when(F.col("_p") == 0, F.col("_y"))).alias("p_event_given_prev0"),
        F.avg(F.when(F.col("_p") == 1, F.col("_y"))).alias("p_event_given_prev1"),
        F.count("_p").alias("n_points"),
        F.sum(F.when(F.col("_p").isNotNull() & (F.col("_y") == 1), 1).otherwise(0)).alias("_n1"),
        F.sum(F.when(F.col("_p").isNotNull() & (F.col("_y") == 0), 1).otherwise(0)).alias("_n0"),
    )
    trans = F.col("n_points") > 0
    pred1 = F.col("event_rate") >= 0.5
    n1, n0, npts = F.col("_n1").cast("double"), F.col("_n0").cast("double"), F.col("n_points").cast("double")
    acc = F.when(pred1, n1 / npts).otherwise(n0 / npts)
    tpr = F.when(pred1, n1).otherwise(F.lit(0.0)) / F.greatest(n1, F.lit(1.0))
    tnr = F.when(pred1, F.lit(0.0)).otherwise(n0) / F.greatest(n0, F.lit(1.0))
    return base.select(
        *keys, "event_rate", "corr_lag1", "corr_lag7", "p_event_given_prev0", "p_event_given_prev1",
        F.when(trans, F.col("n_points")).alias("n_points"),
        F.when(trans, n0 / npts).alias("always_0_accuracy"),
        F.when(trans, acc).alias("frequency_accuracy"),
        F.when(trans, 0.5 * (tpr + tnr)).alias("frequency_balanced_accuracy"),
    )


def event_summary(ev: DataFrame) -> DataFrame:
    return ev.agg(
        F.count(F.lit(1)).alias("pairs"),
        *medians(ev, {f"median_{c}": c for c in (
            "event_rate", "corr_lag1", "corr_lag7", "p_event_given_prev0", "p_event_given_prev1")}).values(),
        F.avg("always_0_accuracy").alias("always_0_accuracy"),
        F.avg("frequency_accuracy").alias("frequency_accuracy"),
        F.avg("frequency_balanced_accuracy").alias("frequency_balanced_accuracy"),
    )


def distribution(grid: DataFrame, value="amount") -> DataFrame:
    """A4: zero share, mean, median, p95, p99 and bias-corrected skewness (G1, n > 2).

    The quantiles come from the distributed exact quantile operator.
    """
    q = exact_quantiles_multi(grid, [value], [0.5, 0.95, 0.99])[value]
    n = F.count(F.col(value)).cast("double")
    g1 = F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2)
    return grid.agg(
        share(F.col(value) == 0).alias("zero_share"),
        F.avg(value).alias("mean"),
        F.lit(q[0]).cast("double").alias("median"),
        F.lit(q[1]).cast("double").alias("p95"),
        F.lit(q[2]).cast("double").alias("p99"),
        F.when(n > 2, g1).alias("skewness"),
    )


def histogram(df: DataFrame, value: str, bins: int, log1p: bool = False, label: str | None = None) -> DataFrame:
    """A5: equal-width bins over [min, max] (last bin closed), non-empty bins only."""
    x = F.log1p(F.col(value)) if log1p else F.col(value).cast("double")
    src = df.select(x.alias("_x")).where(F.col("_x").isNotNull())
    mm = src.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi")).first()
    lo, hi = mm["lo"], mm["hi"]
    if lo is None:
        return src.limit(0)
    width = (hi - lo) if hi > lo else 1.0
    b = F.least(F.lit(bins - 1), F.floor((F.col("_x") - F.lit(lo)) / F.lit(width) * F.lit(bins)).cast("int"))
    out = src.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.lit(label or value).alias("series"), "bin",
                      (F.lit(lo) + F.col("bin") * F.lit(width / bins)).alias("bin_lo"), "n")


def user_variance(grid: DataFrame, user="user_id", category="category", date="event_date",
                  value="amount") -> DataFrame:
    """A14 table: per user mean / std / median of the daily total."""
    daily = grid.groupBy(user, date).agg(F.sum(value).alias("_d"))
    return daily.groupBy(user).agg(F.avg("_d").alias("daily_mean"), F.stddev_samp("_d").alias("daily_std"),
                                   median("_d").alias("daily_median"))


def user_variance_summary(grid: DataFrame, user_stats: DataFrame, user="user_id", category="category",
                          value="amount") -> DataFrame:
    """A14 summary: CV of user means; mean over categories of the between-user variance of
    mean spend, where users without the category count as 0 (no pivot needed)."""
    n_users = user_stats.count()
    prof = grid.groupBy(user, category).agg(F.avg(value).alias("_m"))
    per_cat = prof.groupBy(category).agg(F.sum("_m").alias("s1"), F.sum(F.col("_m") * F.col("_m")).alias("s2"))
    nu = F.lit(float(n_users))
    var = F.when(nu > 1, (F.col("s2") - F.col("s1") * F.col("s1") / nu) / (nu - 1))
    between = per_cat.agg(F.avg(var).alias("between_user_category_variance"))
    cv = user_stats.agg((F.stddev_samp("daily_mean") / (F.avg("daily_mean") + F.lit(1e-9))).alias("cv")).first()["cv"]
    return between.select(F.lit(cv).cast("double").alias("cv_daily_mean_spend"), "between_user_category_variance")


def category_signal(sp: DataFrame, ac: DataFrame, focus: list[str], category="category") -> DataFrame:
    """A15 + J8: median active % and median lag-7 correlation per category, full outer join, focus filter."""
    def per_category(df, value):
        q = quantile_table(df.where(F.col(category).isin(*focus)), [value], [0.5], by=[category])
        return q.select(category, F.col("q")[0].alias(value))

    categories = (sp.select(category).unionByName(ac.select(category))
                  .where(F.col(category).isin(*focus)).distinct())
    return (categories.join(per_category(sp, "active_days_pct"), category, "left")
            .join(per_category(ac, "corr_lag7"), category, "left"))


def spearman(df: DataFrame, a: str, b: str, by: str | None = None) -> DataFrame:
    """Q6: Spearman rank correlation with average ranks, NULL under 3 pairs.

    Ranks come from each side's value histogram (count before + (count + 1) / 2) by distributed
    prefix sums, and meet the pairs' own histogram by value; any number of distinct values works.
    """
    grp = [by] if by else []
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*grp, F.col(a).alias("_a"), F.col(b).alias("_b"))
    cells = pairs.groupBy(*grp, "_a", "_b").agg(F.count(F.lit(1)).alias("_c"))

    def ranks(c):
        h = cells.groupBy(*grp, c).agg(F.sum("_c").alias("_n"))
        before = with_prefix_sums(h, grp, [c], {"_s": F.col("_n")}, per_group=True)
        return before.select(*grp, c, (F.col("_s") + (F.col("_n") + 1) / 2.0).alias(f"{c}_r"))

    j = cells.join(ranks("_a"), grp + ["_a"]).join(ranks("_b"), grp + ["_b"])
    x, y, w = F.col("_a_r"), F.col("_b_r"), F.col("_c")
    m = (j.groupBy(*grp) if grp else j.groupBy()).agg(
        F.coalesce(F.sum(w), F.lit(0)).cast("bigint").alias("n_pairs"), F.sum(w * x).alias("_x"), F.sum(w * x * x).alias("_xx"),
        F.sum(w * y * y).alias("_yy"), F.sum(w * x * y).alias("_xy"))
    # Average ranks have mean (n + 1) / 2 on both sides; all sums are multiples of a quarter.
    n = F.col("n_pairs")
    mean2 = n * ((n + 1) / 2.0) * ((n + 1) / 2.0)
    vx, vy = F.col("_xx") - mean2, F.col("_yy") - mean2
    r = F.when((n >= 3) & (vx > 0) & (vy > 0), (F.col("_xy") - mean2) / F.sqrt(vx * vy))
    return m.select(*grp, "n_pairs", r.alias("spearman"))


def ks_two_sample_multi(frame: DataFrame, split_col: str, a_val: str, b_val: str, features: list[str],
                        n_buckets: int | None = None) -> DataFrame:
    """Q9 for many features in one pass: statistic, sample sizes, asymptotic p-value, similar flag.

    Features are stacked to (feature, value, side) and pooled into a per-value histogram (map-side
    combined); both ECDFs come from one distributed prefix sum over (feature, value).  The p-value
    is the Kolmogorov tail 2 sum (-1)^(j-1) exp(-2 j^2 t^2) at t = D sqrt(n_a n_b / (n_a + n_b));
    ``similar`` means it is above 0.05.
    """
    side = F.col(split_col)
    long = frame.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v"),
                 F.when(side == a_val, 1).otherwise(0).alias("a"), F.when(side == b_val, 1).otherwise(0).alias("b"))
        for c in features])).alias("s")).select("s.*").where(F.col("v").isNotNull())
    pooled = long.groupBy("feature", "v").agg(F.sum("a").cast("bigint").alias("a"), F.sum("b").cast("bigint").alias("b"))
    cum = with_prefix_sums(pooled, ["feature"], ["v"], {"_ba": F.col("a"), "_bb": F.col("b")}, n_buckets, per_group=True)
    cum = cum.select("feature", (F.col("_ba") + F.col("a")).alias("ca"), (F.col("_bb") + F.col("b")).alias("cb"))
    sizes = cum.groupBy("feature").agg(F.max("ca").alias("n_a"), F.max("cb").alias("n_b"))
    d = F.abs(F.try_divide(F.col("ca"), F.col("n_a")) - F.try_divide(F.col("cb"), F.col("n_b")))
    out = cum.join(sizes, "feature").groupBy("feature", "n_a", "n_b").agg(F.max(d).alias("ks_statistic"))
    t = F.col("ks_statistic") * F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    out = out.withColumn("_t", t)
    tail = sum(((-1) ** (j - 1) * 2.0 * F.exp(-2.0 * j * j * F.col("_t") * F.col("_t")) for j in range(1, 101)), F.lit(0.0))
    # Below 0.2 the tail is 1 to twelve digits and the series is slow to converge.
    p = F.when(F.col("_t") < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))
    p = F.when(F.col("ks_statistic").isNotNull(), p)
    return out.select("feature", "ks_statistic", "n_a", "n_b", p.alias("p_value"), (p > 0.05).alias("similar"))
