"""Threshold search, per-user thresholds and temporal splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.buckets import bucket_quantile_class, bucket_strict, widen_equal_thresholds
from ..functions.expr import count_if
from ..session import checkpointed
from .ordering import exact_quantiles, exact_quantiles_multi, with_prefix_sum, with_prefix_sums

# Fixed values of the threshold search grid (low 0.20..0.45, high 0.55..0.85, step 0.05).
TUNE_LOW = [0.20, 0.25, 0.30, 0.35, 0.40, 0.45]
TUNE_HIGH = [0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85]
MIN_CLASS_SHARE = 0.10


def tune_thresholds(df: DataFrame, y: str) -> dict:
    """q25/q75 of positive values, kept if each class 1-3 holds >= 10 % of the
    non-null buckets; otherwise the grid pair maximising (min share, -imbalance),
    first best in grid order.  One quantile pass, one counting pass."""
    pos = df.where(F.col(y) > 0)
    probs = sorted(set([0.25, 0.75] + TUNE_LOW + TUNE_HIGH))
    q = dict(zip(probs, exact_quantiles(pos, y, probs)))
    if q[0.25] is None:
        return {"low": 0.0, "high": 0.0, "mode": "degenerate", "q_low": 0.0, "q_high": 0.0}
    combos = [(0.25, 0.75)] + [(lo, hi) for lo in TUNE_LOW for hi in TUNE_HIGH if lo < hi]
    # Positive rows up to each candidate; every pair's classes are differences of these counts.
    yy = F.col(y)
    upto = [count_if((yy > 0) & (yy <= q[p])).alias(f"u{i}") for i, p in enumerate(probs)]
    r = df.agg(count_if(yy >= 0).alias("n"), count_if(yy > 0).alias("positive"), *upto).first()
    n, below = r["n"], {p: r[f"u{i}"] for i, p in enumerate(probs)}

    def shares(i):
        lo, hi = combos[i]
        counts = (below[lo], below[hi] - below[lo], r["positive"] - below[hi])
        return [c / n if n else 0.0 for c in counts]

    d = shares(0)
    if min(d) >= MIN_CLASS_SHARE:
        return {"low": q[0.25], "high": q[0.75], "mode": "default", "q_low": 0.25, "q_high": 0.75}
    best = None
    for i, (lo, hi) in enumerate(combos[1:], start=1):
        d1, d2, d3 = shares(i)
        score = (min(d1, d2, d3), -abs(d1 - d2) - abs(d2 - d3))
        if best is None or score > best[0]:
            best = (score, lo, hi)
    _, lo, hi = best
    return {"low": q[lo], "high": q[hi], "mode": "tuned", "q_low": lo, "q_high": hi}


def class_distribution(df: DataFrame, bucket: str, value: str, classes=(0, 1, 2, 3)) -> DataFrame:
    """Share (percent) and mean value per class, zero filled for absent classes.

    One aggregate with a conditional count per class, stacked into one row per class.
    """
    b = F.col(bucket)
    aggs = [count_if(b.isNotNull()).alias("_n")]
    for c in classes:
        aggs += [count_if(b == c).alias(f"_c{c}"), F.avg(F.when(b == c, F.col(value))).alias(f"_m{c}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("bucket"),
                              F.coalesce(F.try_divide(F.col(f"_c{c}") * 100.0, F.col("_n")), F.lit(0.0)).alias("class_pct"),
                              F.col(f"_m{c}").alias("mean_value")) for c in classes])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def transition_matrix(df: DataFrame, a: str, b: str, classes=(0, 1, 2, 3)) -> DataFrame:
    """Row-normalised crosstab of (a, b) over non-null pairs, zero filled, long form."""
    x, y = F.col(a), F.col(b)
    ok = x.isNotNull() & y.isNotNull()
    aggs = []
    for i in classes:
        for j in classes:
            aggs.append(count_if(ok & (x == i) & (y == j)).alias(f"_c{i}_{j}"))
    one = df.agg(*aggs)
    cells = []
    for i in classes:
        row_total = None
        for j in classes:
            row_total = F.col(f"_c{i}_{j}") if row_total is None else row_total + F.col(f"_c{i}_{j}")
        for j in classes:
            cells.append(F.struct(F.lit(i).alias("bucket_from"), F.lit(j).alias("bucket_to"),
                                  F.col(f"_c{i}_{j}").alias("n"),
                                  F.coalesce(F.try_divide(F.col(f"_c{i}_{j}").cast("double"), row_total),
                                             F.lit(0.0)).alias("share")))
    return one.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def user_quantile_thresholds(train: DataFrame, value: str, user: str = "user_id", min_rows: int = 4):
    """B3 thresholds: per-user train q25/q75 (users with < min_rows train rows use the
    global train quantiles), equal pairs widened.  Returns (per-user frame, (g25, g75))."""
    g25, g75 = exact_quantiles(train, value, [0.25, 0.75])
    if g25 is not None and g25 == g75:
        e = max(1e-6, abs(g25) * 0.01)
        g25, g75 = g25 - e, g75 + e
    per = train.groupBy(user).agg(F.percentile(F.col(value), F.array(F.lit(0.25), F.lit(0.75))).alias("_q"),
                                  F.count(F.lit(1)).alias("_n"))
    fb = F.col("_n") < min_rows
    q25, q75 = widen_equal_thresholds(F.col("_q")[0], F.col("_q")[1])
    thr = per.select(user, F.when(fb, F.lit(g25)).otherwise(q25).alias("q25"),
                     F.when(fb, F.lit(g75)).otherwise(q75).alias("q75"), fb.alias("fallback"))
    return thr, (g25, g75)


def user_quantile_thresholds_multi(train: DataFrame, values: list[str], user: str = "user_id",
                                   min_rows: int = 4) -> dict:
    """B3 thresholds for several value columns in one pass: one distributed quantile job
    set for the global pairs, one ``groupBy(user)`` for the per-user pairs."""
    gq = exact_quantiles_multi(train, values, [0.25, 0.75])
    glob = {}
    for v in values:
        g25, g75 = gq[v]
        if g25 is not None and g25 == g75:
            e = max(1e-6, abs(g25) * 0.01)
            g25, g75 = g25 - e, g75 + e
        glob[v] = (g25, g75)
    per = train.groupBy(user).agg(F.count(F.lit(1)).alias("_n"), *[
        F.percentile(F.col(v), F.array(F.lit(0.25), F.lit(0.75))).alias(f"_q_{v}") for v in values])
    fb = F.col("_n") < min_rows
    cols = [user, fb.alias("fallback")]
    for v in values:
        q25, q75 = widen_equal_thresholds(F.col(f"_q_{v}")[0], F.col(f"_q_{v}")[1])
        cols += [F.when(fb, F.lit(glob[v][0])).otherwise(q25).alias(f"q25_{v}"),
                 F.when(fb, F.lit(glob[v][1])).otherwise(q75).alias(f"q75_{v}")]
    return per.select(*cols), glob


def apply_user_buckets(df: DataFrame, thr: DataFrame, glob: tuple, value: str, out: str,
                       user: str = "user_id") -> DataFrame:
    """Class 1-3 with the user's thresholds, test-only users with the global pair."""
    t = thr.select(user, F.col("q25").alias("_q25"), F.col("q75").alias("_q75"))
    j = df.join(t, user, "left")
    q25 = F.coalesce(F.col("_q25"), F.lit(glob[0]))
    q75 = F.coalesce(F.col("_q75"), F.lit(glob[1]))
    return j.withColumn(out, bucket_quantile_class(value, q25, q75)).drop("_q25", "_q75")


def apply_user_buckets_multi(df: DataFrame, thr: DataFrame, glob: dict, outs: dict[str, str], user: str = "user_id") -> DataFrame:
    """B3/J14 for several value columns (value -> class column) in one join with ``user_quantile_thresholds_multi``'s table."""
    ends = {f"q{p}_{v}": f"_q{p}_{v}" for v in outs for p in (25, 75)}
    j = df.drop(*outs.values()).join(thr.select(user, *[F.col(a).alias(b) for a, b in ends.items()]), user, "left")
    return j.withColumns({out: bucket_quantile_class(v, F.coalesce(F.col(f"_q25_{v}"), F.lit(glob[v][0])), F.coalesce(F.col(f"_q75_{v}"), F.lit(glob[v][1])))
                          for v, out in outs.items()}).drop(*ends.values())


def apply_global_buckets(df: DataFrame, train: DataFrame, value: str, out: str) -> DataFrame:
    """One train q25/q75 for all rows, B3's class rule."""
    q25, q75 = exact_quantiles(train, value, [0.25, 0.75])
    return df.withColumn(out, bucket_quantile_class(value, q25, q75))


def split_by_distinct_date(df: DataFrame, date: str, frac: float = 0.8):
    """The date at index int(frac * n) of the sorted distinct dates (clamped); <= is train.

    Distinct dates are bounded by the calendar span; the offset is taken in Spark.
    """
    dates = df.select(F.col(date).alias("d")).where(F.col("d").isNotNull()).distinct()
    n = dates.count()
    if n == 0:
        raise RuntimeError("no dates")
    idx = min(max(int(n * frac), 0), n - 1)
    return dates.orderBy("d").offset(idx).limit(1).first()["d"]


def date_quantile(df: DataFrame, date: str, p: float):
    """Linear-interpolated quantile of a date column, in fractional days since epoch."""
    return exact_quantiles(df.select(F.unix_date(F.col(date)).alias("_u")), "_u", [p])[0]


def split_by_date_quantile(df: DataFrame, date: str, p: float = 0.8) -> DataFrame:
    """Row-weighted date quantile; rows on or before it are train (is_test = 0)."""
    q = date_quantile(df, date, p)
    if q is None:
        raise RuntimeError("Train/test split is empty")
    out = df.withColumn("is_test", (F.unix_date(F.col(date)) > F.lit(q)).cast("int"))
    ends = df.agg(F.min(F.unix_date(F.col(date))).alias("lo"), F.max(F.unix_date(F.col(date))).alias("hi")).first()
    if not ends["lo"] <= q < ends["hi"]:
        raise RuntimeError("Train/test split is empty")
    return out


def expanding_folds(df: DataFrame, order_cols: list[str], n_splits: int = 5, index: bool = True) -> DataFrame:
    """Global row index over ``order_cols`` and the expanding-window fold layout: test block i covers
    [n - (k - i + 1) * size, n - (k - i) * size) with size = n // (k + 1).

    Blocks begin at k rows, whose keys are found on the keys alone; each row's block then follows from
    its own key, so rows stay where they are (keys must not repeat).  ``index`` adds ``row_index``, a
    two-level prefix sum of all rows, which also tells rows of one key apart.
    """
    n = df.count()
    size = n // (n_splits + 1)
    start = n - n_splits * size
    out = with_prefix_sum(df, [], order_cols[0], order_cols[1:], out="row_index") if index else df
    if index:
        block = F.when(F.col("row_index") >= start, (F.floor((F.col("row_index") - start) / F.lit(max(size, 1))) + 1).cast("int"))
    else:
        block = _block_of(df, order_cols, _rows_at(df, order_cols, [start + i * size for i in range(n_splits)] if size else []))
    return out.withColumns({"test_fold": block, "n_rows": F.lit(n), "test_size": F.lit(size)})


def _rows_at(df: DataFrame, order_cols: list[str], places: list[int]) -> list:
    """Keys of the rows at the given places of the order by ``order_cols``.

    Counts by the first column name its values that hold a place; only the keys of those are put in order.
    """
    if not places:
        return []
    first, rest = order_cols[0], order_cols[1:]
    held = with_prefix_sum(df.groupBy(first).agg(F.count(F.lit(1)).alias("_c")), [], first, [], "_c")
    at = F.filter(F.array(*[F.lit(p) for p in places]), lambda p: (p >= F.col("_before")) & (p < F.col("_before") + F.col("_c")))
    held = checkpointed(held.select(F.col(first).alias("_first"), "_before", at.alias("_at")).where(F.size("_at") > 0))   # at most a row a place
    near = df.select(*order_cols).join(F.broadcast(held), F.col(first).eqNullSafe(F.col("_first")))
    inside = with_prefix_sums(near.drop("_first"), [first], rest, {"_in": None}, per_group=True)
    found = inside.where(F.array_contains("_at", F.col("_before") + F.col("_in"))).select(F.struct(*order_cols).alias("key"), (F.col("_before") + F.col("_in")).alias("place"))
    return [r["key"] for r in sorted(found.collect(), key=lambda r: r["place"])]


def _block_of(df: DataFrame, order_cols: list[str], begins: list) -> Column:
    """Number of the last of the growing keys ``begins`` that a row's key does not precede; null before the first."""
    key = F.struct(*order_cols)
    out = F.lit(None).cast("int")
    for i, k in enumerate(begins, start=1):
        out = F.when(key >= F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for v, c in zip(k, order_cols)]), F.lit(i)).otherwise(out)
    return out

def user_overlap(train: DataFrame, test: DataFrame, user: str = "user_id") -> DataFrame:
    """X2 + B13 inputs: users in both, only train, only test (one full outer join)."""
    a = train.select(user).distinct().withColumn("_a", F.lit(1))
    b = test.select(user).distinct().withColumn("_b", F.lit(1))
    j = a.join(b, user, "full_outer")
    return j.agg(count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("overlapping_users"),
                 count_if(F.col("_a").isNotNull() & F.col("_b").isNull()).alias("users_only_in_train"),
                 count_if(F.col("_a").isNull() & F.col("_b").isNotNull()).alias("users_only_in_test"))
