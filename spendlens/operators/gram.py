"""Linear regressors from sums of products: one aggregation serves every fold and every penalty.

Rows are reduced to sums and sums of products of the numeric columns and the label for each block of rows and each
combination of the categorical columns.  Blocks add up, so the matrix of a fold's train rows is a sum of block
matrices; one-hot columns need no sums of their own, a combination's count and sums are their entries.  What
reaches the driver is blocks x combinations x columns squared numbers, never rows.  On the matrix, ridge is a
linear system, elastic net coordinate descent; predictions are a column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Design:
    """Sums of products of (1, numeric..., one-hot..., label) by block."""
    numeric: list[str]
    hot: list[tuple[str, str]]          # (categorical column, value) of each one-hot column
    blocks: dict[int, np.ndarray]

    def upto(self, block: int) -> np.ndarray:
        """The matrix of all rows in blocks before ``block``."""
        return sum((m for b, m in self.blocks.items() if b < block), np.zeros_like(next(iter(self.blocks.values()))))


def design(df: DataFrame, numeric: list[str], categorical: list[str], label: str, block: Column | None = None) -> Design:
    """L5 + L4: the sums, in one pass over ``df``; null categoricals are a value of their own, null numbers count as 0."""
    n = len(numeric) + 2
    cells = [F.lit(1.0), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric], F.col(label).cast("double")]
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    keys = [(F.lit(0) if block is None else block).cast("int").alias("_block"), *[F.col(c).cast("string").alias(f"_k{k}") for k, c in enumerate(categorical)]]
    rows = df.select(*keys, *[c.alias(f"_z{i}") for i, c in enumerate(cells)])
    sums = rows.groupBy("_block", *[f"_k{k}" for k in range(len(categorical))]).agg(
        *[F.sum(F.col(f"_z{i}") * F.col(f"_z{j}")).alias(f"_s{i}_{j}") for i, j in pairs]).collect()
    hot = sorted({(c, r[f"_k{k}"]) for r in sums for k, c in enumerate(categorical)}, key=lambda x: (x[0], x[1] is not None, x[1] or ""))
    width, place = n + len(hot), {h: n - 1 + i for i, h in enumerate(hot)}
    dense = [*range(n - 1), width - 1]
    blocks: dict[int, np.ndarray] = {}
    for r in sums:
        own = np.zeros((n, n))
        for i, j in pairs:
            own[i, j] = own[j, i] = r[f"_s{i}_{j}"]
        m = blocks.setdefault(r["_block"], np.zeros((width, width)))
        m[np.ix_(dense, dense)] += own
        at = [place[c, r[f"_k{k}"]] for k, c in enumerate(categorical)]
        for p in at:
            m[p, dense] += own[0]
            m[dense, p] += own[0]
            m[np.ix_([p], at)] += own[0, 0]
    return Design(list(numeric), hot, blocks)


@dataclass
class Linear:
    """Coefficients of the raw numeric columns and of the one-hot values."""
    numeric: dict[str, float]
    hot: dict[tuple[str, str], float]
    intercept: float

    def prediction(self) -> Column:
        """The prediction as an expression; a value unseen in training adds nothing."""
        out = F.lit(float(self.intercept))
        for c, b in self.numeric.items():
            out = out + F.lit(float(b)) * F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        for c in dict.fromkeys(c for c, _ in self.hot):
            when = None
            for (col, value), b in self.hot.items():
                if col == c:
                    hit = F.col(c).cast("string").eqNullSafe(F.lit(value))
                    when = F.when(hit, F.lit(float(b))) if when is None else when.when(hit, F.lit(float(b)))
            out = out + when.otherwise(F.lit(0.0))
        return out


def coordinate_descent(g: np.ndarray, c: np.ndarray, l1: float, l2: float, steps: int = 10_000, tol: float = 1e-12) -> np.ndarray:
    """Minimum of b'gb/2 - c'b + l1 |b| + l2 b'b/2."""
    b = np.zeros(len(c))
    for _ in range(steps):
        moved = 0.0
        for i in range(len(c)):
            if g[i, i] <= 0:
                continue
            r = c[i] - g[i] @ b + g[i, i] * b[i]
            new = np.sign(r) * max(abs(r) - l1, 0.0) / (g[i, i] + l2)
            moved = max(moved, abs(new - b[i]) * np.sqrt(g[i, i]))
            b[i] = new
        if moved <= tol * max(1.0, np.abs(c).max()):
            break
    return b


def solve(d: Design, m: np.ndarray, kind: str, alpha: float, l1_ratio: float = 0.2) -> Linear:
    """L4 on the matrix ``m`` of ``d``: 'ridge' (penalty alpha on the sum of squares), 'elasticnet' or 'sgd' (alpha on the mean).

    Numeric columns are scaled by mean and population deviation, columns without spread get no weight.
    """
    n, p = m[0, 0], len(m) - 2
    mean = m[0, 1:] / n
    centred = m[1:, 1:] / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(centred)[:p], 0.0))
    flat = spread <= 1e-9 * np.maximum(1.0, np.abs(mean[:p]))
    scale = np.where(np.arange(p) < len(d.numeric), np.where(flat, 1.0, spread), 1.0)
    g, c = centred[:p, :p] / np.outer(scale, scale), centred[:p, p] / scale
    g[flat], g[:, flat], c[flat] = 0.0, 0.0, 0.0
    if kind == "elasticnet":
        b = coordinate_descent(g, c, alpha * l1_ratio, alpha * (1 - l1_ratio))
    else:
        b = np.linalg.lstsq(g + (alpha / n if kind == "ridge" else alpha) * np.eye(p), c, rcond=None)[0]
    b = b / scale
    k = len(d.numeric)
    return Linear(dict(zip(d.numeric, b[:k])), dict(zip(d.hot, b[k:])), float(mean[p] - mean[:p] @ b))
