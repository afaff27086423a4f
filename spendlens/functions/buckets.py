"""Bucket rules as column expressions (B1, B2, B3 class rule, B6, B7).

The four threshold rules differ on zero, negative and NULL input; each is its own
function so callers pick the semantics explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import col

# Confidence-bin edges (left-closed) and entropy level cut-offs.
CONFIDENCE_EDGES = [0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.95, 1.001]
ENTROPY_LOW, ENTROPY_MEDIUM = 0.8, 1.4


def bucket_strict(y, lo, hi) -> Column:
    """B1: 0 if y=0; 1 if 0<y<=lo; 2 if y<=hi; 3 if y>hi; negative or NULL -> NULL."""
    y, lo, hi = col(y), F.lit(lo) if not isinstance(lo, Column) else lo, F.lit(hi) if not isinstance(hi, Column) else hi
    return (F.when(y == 0, 0).when((y > 0) & (y <= lo), 1).when((y > lo) & (y <= hi), 2)
            .when(y > hi, 3)).cast("int")


def bucket_select(y, q25, q75) -> Column:
    """B2: tested in order =0 -> 0, <=q25 -> 1, <=q75 -> 2, else 3 (NULL -> 3)."""
    y = col(y)
    q25 = q25 if isinstance(q25, Column) else F.lit(q25)
    q75 = q75 if isinstance(q75, Column) else F.lit(q75)
    return F.when(y == 0, 0).when(y <= q25, 1).when(y <= q75, 2).otherwise(3).cast("int")


def bucket_quantile_class(y, q25, q75) -> Column:
    """B3/B4 class rule (bins [0,q25], (q25,q75], (q75,inf)): classes 1-3 only;
    zero, negatives and NULL fall into class 1."""
    y = col(y)
    q25 = q25 if isinstance(q25, Column) else F.lit(q25)
    q75 = q75 if isinstance(q75, Column) else F.lit(q75)
    return F.when(y <= q25, 1).when(y <= q75, 2).when(y > q75, 3).otherwise(1).cast("int")


def widen_equal_thresholds(q25, q75) -> tuple[Column, Column]:
    """When q25 == q75 spread them by +-max(1e-6, 1% of |q25|)."""
    q25, q75 = col(q25), col(q75)
    eps = F.greatest(F.lit(1e-6), F.abs(q25) * 0.01)
    same = q25 == q75
    return F.when(same, q25 - eps).otherwise(q25), F.when(same, q75 + eps).otherwise(q75)


def confidence_bin(p) -> Column:
    """Left-closed bins [.25,.35) ... [.95,1.001); label is the lower edge text."""
    p = col(p)
    out = None
    for lo, hi in zip(CONFIDENCE_EDGES[:-1], CONFIDENCE_EDGES[1:]):
        cond = (p >= lo) & (p < hi)
        label = F.lit(f"{lo:.2f}-{hi:.2f}" if hi < 1 else f"{lo:.2f}-1.00")
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def entropy_level(e) -> Column:
    """<0.8 low, <1.4 medium, else high."""
    e = col(e)
    return F.when(e < ENTROPY_LOW, "low").when(e < ENTROPY_MEDIUM, "medium").when(e.isNotNull(), "high")
