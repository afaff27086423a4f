"""Weekly card data: coverage, quality gates, temporal split, weekly lag rows and the
15/21-column feature frame (A6-A12, A16, A19-A22, A25-A27, J5, J9, J11-J15, L17, Q8, Q11, Q12).

Per-user windows run on aggregated grains only: distinct (user, day) for gaps and
as-of recency, (user, week) for lags and rolling statistics, so a user holding a
third of all rows still contributes at most one row per day to any window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import bucket_select
from ..functions.calendar import iso_week_label, week_label_to_monday, week_start
from ..functions.expr import clip, count_if, median, share
from . import windows as W
from .ordering import exact_quantiles, quantile_table


@dataclass(frozen=True)
class Gate:
    """A12 thresholds (the reference's values are 300, 365, 2.5, 90)."""
    min_tx: int = 300
    min_span_days: int = 365
    min_tx_per_week: float = 2.5
    max_gap_days: int = 90


def missing_counts(raw: DataFrame, cols: list[str]) -> DataFrame:
    """NULL or blank text per critical column, and the mean null rate."""
    aggs = []
    for c in cols:
        bad = F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
        aggs.append(count_if(bad).alias(f"missing_{c}"))
    rates = [F.avg(F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), 1.0).otherwise(0.0)) for c in cols]
    total = rates[0]
    for r in rates[1:]:
        total = total + r
    return raw.agg(*aggs, (total / len(cols)).alias("mean_null_rate"))


def max_gap_days(tx: DataFrame, user="user_id", date="event_date") -> DataFrame:
    """A10: max days between consecutive distinct dates per user, 0 with <= 1 date."""
    d = tx.select(user, date).distinct()
    w = W.spec(user, date)
    g = d.select(user, F.datediff(F.col(date), F.lag(date, 1).over(w)).alias("_g"))
    return g.groupBy(user).agg(F.coalesce(F.max("_g"), F.lit(0)).alias("max_consecutive_gap_days"))


def user_coverage(tx: DataFrame, user="user_id", date="event_date", amount="amount",
                  category="category", middle: bool = True) -> DataFrame:
    """A9 + J10: per-user first/last date, counts, mean/median amount, span, rate, max gap; without ``middle`` no median."""
    cov = tx.groupBy(user).agg(
        F.min(date).alias("first_transaction_date"), F.max(date).alias("last_transaction_date"),
        F.count(F.lit(1)).alias("total_transactions"), F.countDistinct(category).alias("categories_count"),
        F.avg(amount).alias("avg_transaction_amount"))
    if middle:
        # A hot user's raw amounts are cut by value, so no buffer holds them all.
        mid = quantile_table(tx, [amount], [0.5], by=[user]).select(user, F.col("q")[0].alias("median_transaction_amount"))
        cov = cov.join(mid, user, "left")
    span = F.datediff("last_transaction_date", "first_transaction_date")
    cov = cov.withColumn("activity_span_days", span).withColumn(
        "avg_txn_per_week", F.col("total_transactions") / F.greatest(F.col("activity_span_days"), F.lit(1)) * 7.0)
    return cov.join(max_gap_days(tx, user, date), user, "inner")


def quality_flags(cov: DataFrame, gate: Gate) -> DataFrame:
    """The four pass flags and the combined validity per user."""
    return cov.select(
        "*",
        (F.col("total_transactions") >= gate.min_tx).alias("ok_tx"),
        (F.col("activity_span_days") >= gate.min_span_days).alias("ok_span"),
        (F.col("avg_txn_per_week") >= gate.min_tx_per_week).alias("ok_rate"),
        (F.col("max_consecutive_gap_days") <= gate.max_gap_days).alias("ok_gap"),
    ).withColumn("valid", F.col("ok_tx") & F.col("ok_span") & F.col("ok_rate") & F.col("ok_gap"))


def quality_gate_summary(flags: DataFrame) -> DataFrame:
    """A12 summary: exclusions by reason, retention, PASS/WARN/FAIL."""
    s = flags.agg(
        F.count(F.lit(1)).alias("original_users"),
        count_if(~F.col("valid")).alias("excluded_users_count"),
        count_if(~F.col("ok_tx")).alias("insufficient_transactions"),
        count_if(~F.col("ok_span")).alias("insufficient_activity_span"),
        count_if(~F.col("ok_rate")).alias("insufficient_weekly_rate"),
        count_if(~F.col("ok_gap")).alias("excessive_data_gap"),
        count_if(F.col("valid")).alias("valid_users_count"),
    )
    ret = F.col("valid_users_count") / F.greatest(F.col("original_users"), F.lit(1))
    return s.withColumn("retention_rate", ret).withColumn(
        "status", F.when(F.col("valid_users_count") < 100, "FAIL").when(ret < 0.5, "WARN").otherwise("PASS"))


def keep_valid_users(tx: DataFrame, flags: DataFrame, user="user_id") -> DataFrame:
    """Left semi join on the valid users."""
    return tx.join(flags.where("valid").select(user), user, "left_semi")


def excluded_users(flags: DataFrame, n: int = 50, user="user_id") -> DataFrame:
    """The first n excluded users in user order."""
    return flags.where(~F.col("valid")).select(user).orderBy(user).limit(n)


def sanity_gate(tx: DataFrame, user="user_id", date="event_date", min_users=200, min_rows=500_000,
                min_days=365) -> DataFrame:
    """A7 + A8: totals, date range, averages, outlier flags and the PASS/FAIL status."""
    per = tx.groupBy(user).agg(F.count(F.lit(1)).alias("n"), F.max("amount").alias("mx"),
                               F.min(date).alias("d0"), F.max(date).alias("d1"))
    s = per.agg(F.count(F.lit(1)).alias("total_users"), F.sum("n").alias("total_transactions"),
                F.min("d0").alias("date_range_start"), F.max("d1").alias("date_range_end"),
                (F.max("n") > 50000).alias("users_over_50k_tx"), (F.max("mx") > 100000).alias("amount_over_100k"))
    days = F.datediff("date_range_end", "date_range_start")
    s = s.withColumn("date_range_days", days).withColumn(
        "avg_transactions_per_user", F.col("total_transactions") / F.greatest(F.col("total_users"), F.lit(1))).withColumn(
        "avg_transactions_per_user_per_day",
        F.col("total_transactions") / F.greatest(F.col("date_range_days") * F.col("total_users"), F.lit(1)))
    ok = (F.col("total_users") >= min_users) & (F.col("total_transactions") >= min_rows) & (days >= min_days)
    return s.withColumn("status", F.when(ok, "PASS").otherwise("FAIL"))


def split_profile(train: DataFrame, test: DataFrame, user="user_id", date="event_date") -> DataFrame:
    """Per split start, end, span, rows, users, distinct weeks."""
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return both.groupBy("split").agg(
        F.min(date).alias("start_date"), F.max(date).alias("end_date"),
        F.datediff(F.max(date), F.min(date)).alias("days_span"),
        F.count(F.lit(1)).alias("transactions_count"), F.countDistinct(user).alias("unique_users"),
        F.countDistinct(week_start(date)).alias("distinct_weeks"))


def split_ratio(train: DataFrame, test: DataFrame, date="event_date", few_weeks: int = 10) -> DataFrame:
    """Train rows per test row, and whether the test split covers fewer than ``few_weeks`` weeks."""
    both = train.select(date, F.lit(1).alias("_t")).unionByName(test.select(date, F.lit(0).alias("_t")))
    s = both.agg(count_if(F.col("_t") == 1).alias("train_transactions"), count_if(F.col("_t") == 0).alias("test_transactions"),
                 F.countDistinct(F.when(F.col("_t") == 0, week_start(date))).alias("test_weeks"))
    ratio = F.col("train_transactions") / F.greatest(F.col("test_transactions"), F.lit(1))
    return s.select("train_transactions", "test_transactions", ratio.alias("train_test_ratio"), "test_weeks",
                    (F.col("test_weeks") < few_weeks).alias("few_test_weeks"))


def weekly_amounts(tx: DataFrame, q25, q75, user="user_id", date="event_date", amount="amount", by=()) -> DataFrame:
    """A16 + B2: per (user, Monday) sum, first and last transaction date, count, bucket, label; ``by`` holds keys beside the user."""
    wk = tx.withColumn("week_key", week_start(date))
    out = wk.groupBy(*by, user, "week_key").agg(
        F.sum(amount).alias("amount_sum"), F.min(date).alias("first_txn_date"),
        F.max(date).alias("last_txn_date"), F.count(F.lit(1)).alias("txn_count"))
    return out.withColumn("year_week", iso_week_label("week_key")).withColumn(
        "bucket", bucket_select("amount_sum", q25, q75))


def lag_rows(weekly: DataFrame, user="user_id", by=()) -> DataFrame:
    """Next observed week's bucket and amount, within the user and the keys ``by``; rows without one are dropped."""
    w = W.spec([*by, user], "week_key")
    out = weekly.select(
        *by, user, F.col("year_week").alias("week_t"), F.col("week_key").alias("week_monday"),
        F.col("bucket").alias("bucket_t"), F.col("amount_sum").alias("amount_t"),
        W.lead_k("bucket", w, 1).alias("bucket_t_plus_1"), W.lead_k("amount_sum", w, 1).alias("amount_t_plus_1"))
    return out.where(F.col("bucket_t_plus_1").isNotNull() & F.col("amount_t_plus_1").isNotNull())


def largest_shift(rows: DataFrame, bucket="bucket", split="split", classes=(0, 1, 2, 3)) -> DataFrame:
    """``max_shift_pp``: largest difference of a bucket's share between the 'train' and the 'test' rows, in percentage points."""
    cells = [count_if((F.col(split) == s) & (F.col(bucket) == c)).alias(f"_{s}{c}") for s in ("train", "test") for c in classes]
    one = rows.agg(*cells)
    total = {s: sum((F.col(f"_{s}{c}") for c in classes), F.lit(0)) for s in ("train", "test")}
    apart = [F.abs(F.try_divide(F.col(f"_train{c}") * 100.0, total["train"]) - F.try_divide(F.col(f"_test{c}") * 100.0, total["test"])) for c in classes]
    return one.select(F.greatest(*apart).alias("max_shift_pp"))


def dataset_verdict(sanity: DataFrame, gate: DataFrame, overlap: DataFrame, shift: DataFrame, baseline: DataFrame, min_valid: int = 100) -> DataFrame:
    """Q15 as one plan over one-row frames: five checks (sanity, retention, overlap, shift under 15 points, macro F1 over 0.25).

    GO without a failed check, BORDERLINE with one or two, NO_GO with more, without sanity or with under ``min_valid`` valid users.
    """
    one = (sanity.select(F.col("status").alias("_s")).crossJoin(gate.select("retention_rate", "valid_users_count"))
           .crossJoin(overlap.select("overlapping_users")).crossJoin(shift.select("max_shift_pp")).crossJoin(baseline.select("f1_macro")))
    sane = F.col("_s") == "PASS"
    checks = [sane, F.col("retention_rate") >= 0.5, F.col("overlapping_users") >= 0.8 * F.greatest("valid_users_count", F.lit(1)),
              F.col("max_shift_pp") < 15.0, F.col("f1_macro") > 0.25]
    failed = sum((F.when(c, 0).otherwise(1) for c in checks), F.lit(0)).cast("int")
    hard = ~sane | (F.col("valid_users_count") < min_valid)
    return one.select(failed.alias("failed_checks"), F.when(hard, "NO_GO").when(failed == 0, "GO").when(failed <= 2, "BORDERLINE")
                      .otherwise("NO_GO").alias("verdict"))


def chi2_bucket_shift(train: DataFrame, test: DataFrame, bucket="bucket", classes=(0, 1, 2, 3)) -> DataFrame:
    """Q8: Pearson chi-square of the 2 x k bucket table (empty columns dropped, Yates at 1 dof),
    plus the largest share shift in percentage points.  The p-value comes from the
    chi-square distribution with the table's degrees of freedom."""
    a = train.agg(*[count_if(F.col(bucket) == c).alias(f"a{c}") for c in classes]).first()
    b = test.agg(*[count_if(F.col(bucket) == c).alias(f"b{c}") for c in classes]).first()
    cols = [(a[f"a{c}"], b[f"b{c}"]) for c in classes if a[f"a{c}"] + b[f"b{c}"] > 0]
    na, nb = sum(x for x, _ in cols), sum(y for _, y in cols)
    n = na + nb
    dof = max(len(cols) - 1, 0)
    stat = 0.0
    for x, y in cols:
        t = x + y
        for obs, row in ((x, na), (y, nb)):
            exp = row * t / n if n else 0.0
            if exp > 0:
                dev = abs(obs - exp)
                if dof == 1:
                    dev = max(dev - 0.5, 0.0)
                stat += dev * dev / exp
    shift = max((abs(x / na - y / nb) * 100.0 if na and nb else 0.0) for x, y in cols) if cols else 0.0
    p = _chi2_sf(stat, dof) if dof > 0 else None
    status = "FAIL" if (p is not None and p < 0.05) else ("PASS" if shift < 10 else "WARN")
    spark = train.sparkSession
    return spark.createDataFrame([(float(stat), int(dof), p, float(shift), status)],
                                 "chi2 double, dof int, p_value double, max_shift_pp double, status string")


def _chi2_sf(x: float, k: int) -> float:
    """Upper tail of the chi-square distribution for whole degrees of freedom, in closed form: a
    finite sum times exp(-x/2), plus the normal tail when ``k`` is odd."""
    from math import erfc, exp, gamma, sqrt
    half, first = x / 2.0, 0.5 * (k % 2)
    terms = sum(half ** (i + first) / gamma(i + first + 1) for i in range(k // 2))
    return exp(-half) * terms + (erfc(sqrt(half)) if k % 2 else 0.0)


def user_weekly_stats(train_tx: DataFrame, user="user_id", date="event_date", amount="amount",
                      category="category") -> DataFrame:
    """A19 + A20: per user mean/std/median/min/max of the weekly amount (train only),
    mean weekly category count rounded half-even, total and mean weekly transactions."""
    wk = train_tx.withColumn("week_t", iso_week_label(date)).groupBy(user, "week_t").agg(
        F.sum(amount).alias("weekly_amount"), F.count(F.lit(1)).alias("weekly_txn_count"),
        F.countDistinct(category).alias("category_count"))
    s = wk.groupBy(user).agg(
        F.avg("weekly_amount").alias("user_mean_amount"), F.stddev_samp("weekly_amount").alias("_std"),
        median("weekly_amount").alias("user_median_amount"), F.min("weekly_amount").alias("user_min_amount"),
        F.max("weekly_amount").alias("user_max_amount"),
        F.bround(F.avg("category_count"), 0).cast("int").alias("user_category_count"),
        F.sum("weekly_txn_count").alias("user_total_txn_count"),
        F.avg("weekly_txn_count").alias("user_avg_txn_count"))
    std = F.coalesce(F.col("_std"), F.lit(0.0))
    return s.withColumn("user_std_amount", F.when(std == 0, F.lit(1e-6)).otherwise(std)).drop("_std")


def weekly_txn_count(tx: DataFrame, user="user_id", date="event_date") -> DataFrame:
    """Transactions per (user, ISO week label); ``user`` may be a list of key columns."""
    keys = [user] if isinstance(user, str) else list(user)
    return tx.withColumn("week_t", iso_week_label(date)).groupBy(*keys, "week_t").agg(
        F.count(F.lit(1)).alias("txn_count"))


def category_mix(tx: DataFrame, user="user_id", date="event_date", category="category") -> DataFrame:
    """A20-A22 per (user, week label): transactions, distinct categories, dominant category share."""
    keys = [user] if isinstance(user, str) else list(user)
    c = tx.withColumn("week_t", iso_week_label(date)).groupBy(*keys, "week_t", category).agg(
        F.count(F.lit(1)).alias("cnt"))
    return c.groupBy(*keys, "week_t").agg(
        F.sum("cnt").alias("txn_count"),
        F.count(F.lit(1)).alias("category_diversity"),
        (F.max("cnt") / F.greatest(F.sum("cnt"), F.lit(1))).alias("dominant_category_ratio"))


def recency_asof(rows: DataFrame, tx: DataFrame, user="user_id", probe="week_monday", date="event_date",
                 none_value: float = 180.0, cap: float = 180.0) -> DataFrame:
    """Days since the user's last transaction strictly before the probe date.

    Probe rows are unioned with the user's distinct transaction days, sorted so a
    probe precedes transactions of the same day, and the last transaction day
    before it is read with ``last(ignorenulls)`` - no range join, and the window
    holds one row per distinct day, however many rows a user has.
    """
    keys = [user] if isinstance(user, str) else list(user)
    days = tx.select(*keys, F.col(date).alias("_d")).distinct()
    probes = rows.select(*keys, F.col(probe).alias("_d")).distinct()
    u = (probes.select(*keys, "_d", F.lit(0).alias("_o"), F.lit(None).cast("date").alias("_tx"))
         .unionByName(days.select(*keys, "_d", F.lit(1).alias("_o"), F.col("_d").alias("_tx"))))
    w = W.spec(keys, ["_d", "_o"]).rowsBetween(W.UNB, -1)
    last = u.select(*keys, "_d", "_o", F.last("_tx", ignorenulls=True).over(w).alias("_last"))
    rec = last.where(F.col("_o") == 0).select(
        *keys, F.col("_d").alias(probe),
        clip(F.coalesce(F.datediff("_d", "_last").cast("double"), F.lit(none_value)), 0.0, cap).alias("recency_days"))
    return rows.join(rec, keys + [probe], "left")


def rows_without_stats(lag: DataFrame, stats: DataFrame, user="user_id") -> DataFrame:
    """Rows of users that have no train statistics."""
    return lag.join(stats.select(user), user, "left_anti")


def attach_user_stats(lag: DataFrame, stats: DataFrame, user="user_id", missing: str = "fail") -> DataFrame:
    """Statistics by user; rows without any make it fail, or with ``missing='exclude'`` stay out
    (callers that exclude report them through :func:`rows_without_stats`)."""
    if missing == "fail" and (n := rows_without_stats(lag, stats, user).count()):
        raise RuntimeError(f"{n} rows have no user statistics")
    return lag.join(stats, user, "inner")


def card_features(lag: DataFrame, tx_split: DataFrame, stats: DataFrame, user="user_id",
                  split: str | None = None, missing: str = "fail", columns: list[str] | None = None) -> DataFrame:
    """The 16-column frame (tier 1 + 2) plus tier 3.

    ``lag`` holds user_id, week_t, week_monday, bucket_t, amount_t, bucket_t_plus_1,
    amount_t_plus_1 (buckets already re-assigned per user).  With ``split`` both splits
    are computed in one pass: every window and join is keyed by (split, user), so a
    split's history never sees the other split.  ``missing``: see :func:`attach_user_stats`.
    With ``columns`` all rows come with those only, without the joins and windows that none of them reads.
    """
    keys = ([split] if split else []) + [user]
    f = attach_user_stats(lag, stats, user, missing)
    mixed = columns is None or not _OF_MIX.isdisjoint(columns)
    if mixed:
        f = f.join(category_mix(tx_split, keys), keys + ["week_t"], "left")
    w = W.spec(keys, "week_monday")
    f = f.select(
        "*",
        clip((F.col("amount_t") - F.col("user_mean_amount")) / F.greatest(F.col("user_std_amount"), F.lit(1e-6)),
             -10, 10).alias("z_score"),
        W.rolling_entropy("bucket_t", w, 4).alias("entropy"),
        *([clip(F.col("txn_count") / F.greatest(F.col("user_avg_txn_count"), F.lit(1e-6)), 0, 10).alias("relative_txn_count")] if mixed else []),
        clip(W.diff_prev("amount_t", w, 0.0), -1000, 1000).alias("delta_amount"),
        W.diff_prev("bucket_t", w, 0).cast("int").alias("delta_bucket"),
        F.coalesce(W.rolling_mean_prev("amount_t", w, 8), F.lit(0.0)).alias("rolling_mean_8w"),
        clip(F.col("user_std_amount") / F.greatest(F.col("user_mean_amount"), F.lit(1e-6)), 0, 10).alias("user_cv"),
        F.coalesce(W.lag_k("amount_t", w, 1), F.col("user_mean_amount"), F.lit(0.0)).alias("amount_t_minus_1"),
        F.coalesce(W.lag_k("amount_t", w, 2), F.col("user_mean_amount"), F.lit(0.0)).alias("amount_t_minus_2"),
        W.lag_k("bucket_t", w, 1, 3).alias("bucket_t_minus_1"),
    )
    f = W.add_rolling_std(f, "amount_t", w, 8, "rolling_std_8w")
    f = f.withColumn("rolling_std_8w", F.greatest(F.coalesce(F.col("rolling_std_8w"), F.lit(0.0)), F.lit(1e-6)))
    if columns is None or "recency_days" in columns:
        f = recency_asof(f, tx_split, keys)
    return f if columns is None else f.select(*columns)


#: Columns of the card frame that read a week's categories.
_OF_MIX = {"txn_count", "relative_txn_count", "category_diversity", "dominant_category_ratio"}

# Output columns of the card frame, in order.
CARD_FEATURES_21 = [
    "user_id", "week_t", "bucket_t", "amount_t", "bucket_t_plus_1", "amount_t_plus_1", "z_score", "entropy",
    "txn_count", "relative_txn_count", "delta_amount", "delta_bucket", "rolling_mean_8w", "rolling_std_8w",
    "recency_days", "user_cv", "category_diversity", "dominant_category_ratio", "amount_t_minus_1",
    "amount_t_minus_2", "bucket_t_minus_1",
]
CARD_MODEL_INPUTS = [c for c in CARD_FEATURES_21 if c not in
                     ("user_id", "week_t", "bucket_t_plus_1", "amount_t_plus_1", "bucket_t", "amount_t")]


def feature_profile(frame: DataFrame, cols: list[str], split_col: str = "split") -> DataFrame:
    """Mean, std, min, max, non-null per feature and split (one pass, then unpivot)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std"),
                 F.min(F.col(c).cast("double")).alias(f"{c}__min"), F.max(F.col(c).cast("double")).alias(f"{c}__max"),
                 F.count(c).alias(f"{c}__non_null")]
    wide = frame.groupBy(split_col).agg(*aggs)
    return wide.select(split_col, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__std").alias("std"),
                 F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max"),
                 F.col(f"{c}__non_null").alias("non_null")) for c in cols])).alias("r")).select(split_col, "r.*")


def target_balance(frame: DataFrame, target: str, split_col: str = "split") -> DataFrame:
    """Majority share and classes above 1 % / 0.5 % per split; fail above 0.90."""
    c = frame.groupBy(split_col, target).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window
    c = c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(split_col)))
    return c.groupBy(split_col).agg(
        F.max("share").alias("majority_share"), count_if(F.col("share") > 0.01).alias("classes_over_1pct"),
        count_if(F.col("share") > 0.005).alias("classes_over_half_pct"),
    ).withColumn("status", F.when(F.col("majority_share") > 0.90, "FAIL").otherwise("PASS"))
