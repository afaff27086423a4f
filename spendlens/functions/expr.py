"""Small null- and ANSI-safe column helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c, lo=None, hi=None) -> Column:
    """Clip that keeps NULL as NULL (``greatest``/``least`` alone skip NULLs)."""
    c = col(c)
    out = c
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    return F.when(c.isNotNull(), out)


def safe_div(num, den) -> Column:
    """Division that yields NULL for a zero or NULL divisor (ANSI raises otherwise)."""
    return F.try_divide(col(num), col(den))





def guarded_corr(x, y, eps: float = 1e-8) -> Column:
    """Aggregate Pearson correlation over aligned non-null pairs, NULL when degenerate.

    Uses ``covar_samp / (stddev_samp * stddev_samp)`` with explicit guards instead of
    ``corr``, which raises DIVIDE_BY_ZERO under ANSI on constant input.
    """
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    xs = F.when(both, x)
    ys = F.when(both, y)
    sx = F.stddev_samp(xs)
    sy = F.stddev_samp(ys)
    ok = (F.count(xs) >= 2) & (sx > eps) & (sy > eps)
    return F.when(ok, F.try_divide(F.covar_samp(xs, ys), sx * sy))


def share(cond) -> Column:
    """Share of rows meeting ``cond`` (NULL counts as false)."""
    return F.avg(F.when(col(cond), 1.0).otherwise(0.0))


def count_if(cond) -> Column:
    return F.sum(F.when(col(cond), 1).otherwise(0)).cast("bigint")


def median(c) -> Column:
    """Exact median with linear interpolation (pandas' default)."""
    return F.percentile(col(c), 0.5)
