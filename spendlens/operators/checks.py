"""Contract checks between stages (P16) and schema differences.

Every value check is one aggregate pass (conditional counts); the driver only
receives the counts and raises when a contract is broken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import count_if


class ContractError(RuntimeError):
    pass


def schema_diff(columns: list[str], expected: list[str]) -> dict:
    """Missing and extra columns relative to an expected list (order kept)."""
    have, want = set(columns), set(expected)
    return {"missing": [c for c in expected if c not in have], "extra": [c for c in columns if c not in want]}


def assert_schema(df: DataFrame, expected: list[str], exact_order: bool = True) -> None:
    """The exact column list (and width)."""
    cols = df.columns
    if (cols != list(expected)) if exact_order else (sorted(cols) != sorted(expected)):
        raise ContractError(f"schema mismatch: {schema_diff(cols, list(expected))}")


def check_frame(df: DataFrame, no_null: list[str] = (), ranges: dict | None = None, keys: list[str] | None = None,
                labels: tuple[str, list] | None = None) -> dict:
    """P16 in one pass: NULL counts, out-of-range counts, duplicate keys, labels outside a set."""
    ranges = ranges or {}
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [count_if(F.col(c).isNull()).alias(f"null__{c}") for c in no_null]
    for c, (lo, hi) in ranges.items():
        bad = F.lit(False)
        if lo is not None:
            bad = bad | (F.col(c) < lo)
        if hi is not None:
            bad = bad | (F.col(c) > hi)
        aggs.append(count_if(bad).alias(f"range__{c}"))
    if labels:
        c, allowed = labels
        aggs.append(count_if(~F.col(c).isin(*allowed) | F.col(c).isNull()).alias(f"label__{c}"))
    out = df.agg(*aggs).first().asDict()
    if keys:
        out["duplicate_keys"] = df.groupBy(*keys).count().where("count > 1").count()
    return out


def assert_frame(df: DataFrame, expected_rows: int | None = None, **kw) -> dict:
    """Raise on any broken contract from :func:`check_frame` or a row-count drift."""
    res = check_frame(df, **kw)
    bad = {k: v for k, v in res.items() if k != "rows" and v}
    if expected_rows is not None and res["rows"] != expected_rows:
        bad["rows"] = (res["rows"], expected_rows)
    if bad:
        raise ContractError(f"contract violations: {bad}")
    return res
