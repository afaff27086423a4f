"""Row-frame window operators.

All frames are ROWS frames over one partition/order spec per grain, so Spark
plans a single sort per exchange for every column built on it.  The inputs are
aggregated grains (series-day, user-week): a hot user contributes at most one row
per day or week, which bounds every window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import col

UNB = Window.unboundedPreceding


def spec(keys, order):
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*keys).orderBy(*order)


def future_sum(c, w, k: int = 7) -> Column:
    """Sum of rows t+1..t+k, NULL unless all k rows exist."""
    f = w.rowsBetween(1, k)
    return F.when(F.count(col(c)).over(f) == k, F.sum(col(c)).over(f))


def lead_k(c, w, k: int) -> Column:
    """Value k rows later."""
    return F.lead(col(c), k).over(w)


def lag_k(c, w, k: int = 1, fill=None) -> Column:
    """Value k rows earlier, optional fill."""
    out = F.lag(col(c), k).over(w)
    return out if fill is None else F.coalesce(out, fill if isinstance(fill, Column) else F.lit(fill))


def trailing_sum(c, w, k: int) -> Column:
    """Sum over the previous k rows (>= 1 row), NULL on the first row."""
    return F.sum(col(c)).over(w.rowsBetween(-k, -1))


def rolling_mean_incl(c, w, k: int = 7) -> Column:
    """Mean of rows t-k+1..t (current row included)."""
    return F.avg(col(c)).over(w.rowsBetween(-(k - 1), 0))


def rolling_mean_prev(c, w, k: int) -> Column:
    """Mean of the previous k rows (NULL on the first row)."""
    return F.avg(col(c)).over(w.rowsBetween(-k, -1))


def add_rolling_std(df: DataFrame, c: str, w, k: int, out: str) -> DataFrame:
    """Sample std of the previous k rows (NULL with fewer than two rows)."""
    return df.withColumn(out, F.stddev_samp(col(c).cast("double")).over(w.rowsBetween(-k, -1)))


def frequency_prev(c, w, k: int = 8) -> Column:
    """Positives among rows t-k..t-1 divided by min(row_number, k).

    The shifted first row is a missing value that pandas counts in the denominator.
    """
    pos = F.coalesce(F.sum(F.when(col(c) > 0, 1).otherwise(0)).over(w.rowsBetween(-k, -1)), F.lit(0))
    rn = F.row_number().over(w)
    return pos / F.least(rn, F.lit(k)).cast("double")


def weeks_since_positive(c, w, cap: int = 52) -> Column:
    """Rows since the last positive value at or before row t-2, capped; none -> cap."""
    rn = F.row_number().over(w)
    last_pos = F.last(F.when(col(c) > 0, rn), ignorenulls=True).over(w.rowsBetween(UNB, -2))
    return F.coalesce(F.least(F.lit(cap), rn - 1 - last_pos), F.lit(cap)).cast("double")


def diff_prev(c, w, first=0.0) -> Column:
    """Value minus previous value; first row -> ``first``."""
    return F.coalesce(col(c) - F.lag(col(c), 1).over(w), F.lit(first))


def rolling_entropy(bucket, w, k: int = 4, classes=(0, 1, 2, 3)) -> Column:
    """Shannon entropy (bits) of the previous <=k buckets with log2(p+1e-10); first row 0.0."""
    f = w.rowsBetween(-k, -1)
    n = F.count(col(bucket)).over(f)
    terms = []
    for c in classes:
        cnt = F.sum(F.when(col(bucket) == c, 1).otherwise(0)).over(f)
        p = cnt / n
        terms.append(F.when(cnt > 0, -p * F.log2(p + F.lit(1e-10))).otherwise(F.lit(0.0)))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.when(n > 0, total).otherwise(F.lit(0.0))
