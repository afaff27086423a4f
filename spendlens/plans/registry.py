"""Query registry: each entry is ``(spark, sf_dir) -> DataFrame`` plus, where the
operator is SQL-expressible, the DuckDB text the correctness gate runs against it.

Names follow ``<inventory id>_<operator>``.  Doubles are rounded (4 digits, ratios 6)
on both sides so summation order cannot change a value hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 4, overrides: dict[str, int] | None = None) -> DataFrame:
    """Round every DOUBLE/FLOAT column (per-column digits via ``overrides``)."""
    overrides = overrides or {}
    out = []
    for name, dtype in df.dtypes:
        if dtype in ("double", "float"):
            out.append(F.round(F.col(name).cast("double"), overrides.get(name, digits)).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def load_all() -> None:
    """Import every module that registers queries."""
    from . import card_weekly, daily_signal, deterministic, evaluation, files, flow_weekly, intensity, models, reports  # noqa: F401
