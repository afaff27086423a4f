"""Profiles, gates and summaries.

Every summary is a single ``agg`` (one pass, partial aggregation before the
shuffle); per-user statistics are ``groupBy(user)`` on already-aggregated grains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import count_if, median, safe_div, share


def sparsity(grid: DataFrame, keys=("user_id", "category"), amount="amount") -> DataFrame:
    """A3: per series share of days with amount > 0, in percent."""
    return grid.groupBy(*keys).agg(
        (F.avg(F.when(F.col(amount) > 0, 1.0).otherwise(0.0)) * 100.0).alias("active_days_pct"))


def sparsity_summary(stats: DataFrame) -> DataFrame:
    """A3 summary: median active %, shares below 20, 20-50, 50+."""
    p = F.col("active_days_pct")
    return stats.agg(
        median(p).alias("median_active_days_pct"),
        share(p < 20).alias("share_pairs_below_20pct"),
        share((p >= 20) & (p < 50)).alias("share_pairs_20_to_50pct"),
        share(p >= 50).alias("share_pairs_50plus_pct"),
    )


def sanity_profile(tx: DataFrame, user="user_id", date="event_date", heavy: int = 200) -> DataFrame:
    """A1: rows, users, date range, mean/median transactions per user, users with >= heavy rows."""
    per = tx.groupBy(user).agg(F.count(F.lit(1)).alias("n"), F.min(date).alias("d0"), F.max(date).alias("d1"),
                               F.sum(F.lit(1)).alias("_r"))
    return per.agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("users"), F.min("d0").alias("min_date"),
        F.max("d1").alias("max_date"), F.avg("n").alias("avg_tx_per_user"),
        median("n").cast("double").alias("median_tx_per_user"),
        count_if(F.col("n") >= heavy).alias("users_with_200plus_tx"),
        share(F.col("n") >= heavy).alias("share_users_with_200plus_tx"),
    )


def category_profile(tx: DataFrame, raw="raw_category", collapsed="category") -> DataFrame:
    """A2: distinct raw and collapsed labels (the top-10 lists are K1)."""
    return tx.agg(F.countDistinct(raw).alias("raw_unique_categories"),
                  F.countDistinct(collapsed).alias("collapsed_unique_categories"))


def signal_decision(grid: DataFrame, sparse_bad, lag7_bad, amount="amount") -> DataFrame:
    """Q13: decision case from sparsity, lag-7 weakness and the zero share of the grid."""
    zs = share(F.col(amount) == 0)
    sb = F.lit(sparse_bad).cast("double")
    lb = F.lit(lag7_bad).cast("double")
    dec = (F.when((lb > 0.7) | (sb > 0.7), F.lit("CASE 1: no_signal"))
           .when(lb > 0.4, F.lit("CASE 2: weak_signal")).otherwise(F.lit("CASE 3: good_signal")))
    return grid.agg(zs.alias("zero_share")).select(
        dec.alias("decision"), F.coalesce(F.col("zero_share") >= 0.95, F.lit(False)).alias("mostly_zero_note"),
        sb.alias("share_pairs_below_20pct"), lb.alias("share_lag7_below_0_1"), "zero_share")


def leakage_check(user_stats: DataFrame, train_tx: DataFrame, user="user_id", date="event_date",
                  amount="amount", rtol: float = 0.01, atol: float = 1e-8) -> DataFrame:
    """User means carried by the features must equal the train weekly means."""
    from ..functions.calendar import iso_week_label
    wk = train_tx.withColumn("_w", iso_week_label(date)).groupBy(user, "_w").agg(F.sum(amount).alias("_a"))
    cm = wk.groupBy(user).agg(F.avg("_a").alias("computed_mean"))
    j = user_stats.select(user, "user_mean_amount").join(cm, user, "inner")
    bad = F.abs(F.col("user_mean_amount") - F.col("computed_mean")) > atol + rtol * F.abs(F.col("computed_mean"))
    return j.agg(F.count(F.lit(1)).alias("users_checked"), count_if(bad).alias("mismatches"))
