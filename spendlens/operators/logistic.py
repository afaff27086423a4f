"""Logistic regressions fitted together: a pass over the rows serves every fold, setting and class.

Rows are packed once, some thousands to a compressed byte string, under the block they lie in.  Loss, gradient and
Hessian are sums over rows, so one pass adds them up for all fits that still move, and the driver takes a Newton step
for each: a few passes in place of hundreds of iterations for every fit.  What reaches the driver are fits x columns
squared numbers, never rows.  Every pass reads every row of a fit's blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that are packed together.
ROWS_AT_ONCE = 4_096
#: Passes after which a fit that still moves is an error, and the decrease of the loss below which a step is the last one.
PASSES, TOLERANCE = 300, 1e-10


def packed(df: DataFrame, features: list[str], label: str, block: Column | None = None) -> DataFrame:
    """``(block, n, y, x)``: rows by block, classes as bytes, columns as compressed doubles; kept until ``unpersist``."""
    rows = df.where(F.col(label).isNotNull()).select(
        (F.lit(0) if block is None else block).cast("int").alias("_block"), F.col(label).cast("int").alias("_y"),
        *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)])

    def run(batches):
        held: dict[int, list] = {}

        def out(b: int, every: bool):
            y, x = np.concatenate([p[0] for p in held[b]]), np.concatenate([p[1] for p in held[b]], axis=1)
            end = len(y) if every else len(y) - len(y) % ROWS_AT_ONCE
            held[b] = [(y[end:], x[:, end:])]
            for s in range(0, end, ROWS_AT_ONCE):
                e = min(end, s + ROWS_AT_ONCE)
                yield pa.record_batch([pa.array([b], pa.int32()), pa.array([e - s], pa.int32()), pa.array([y[s:e].tobytes()], pa.binary()),
                                       pa.array([pa.compress(x[:, s:e].tobytes(), "zstd", asbytes=True)], pa.binary())], names=["block", "n", "y", "x"])

        for batch in batches:
            of, y = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.uint8)
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]]) if batch.num_rows else None
            for b in np.unique(of).tolist():
                held.setdefault(b, []).append((y[of == b], x[:, of == b]))
                if sum(len(p[0]) for p in held[b]) >= ROWS_AT_ONCE:
                    yield from out(b, False)
        for b in list(held):
            yield from out(b, True)

    return rows.mapInArrow(run, "block int, n int, y binary, x binary").persist(StorageLevel.MEMORY_AND_DISK)


def _parts(batches, width: int):
    """``(block, y, x)`` of packed rows, ``x`` as columns x rows."""
    for batch in batches:
        for b, n, y, x in zip(*(c.to_pylist() for c in batch.columns)):
            x = pa.decompress(x, width * n * 8, "zstd", asbytes=True)
            yield b, np.frombuffer(y, np.uint8).astype(np.int64), np.frombuffer(x, np.float64).reshape(width, n)


@dataclass
class Moments:
    """Class counts, mean, squared deviations and range of the columns over some rows; they add up."""
    classes: np.ndarray
    mean: np.ndarray
    squares: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        a, b = self.classes.sum(), other.classes.sum()
        apart, n = other.mean - self.mean, a + b
        return Moments(self.classes + other.classes, self.mean + apart * (b / n), self.squares + other.squares + apart ** 2 * (a * b / n),
                       np.minimum(self.low, other.low), np.maximum(self.high, other.high))

    @property
    def spread(self) -> np.ndarray:
        """Population deviation, 0 for a column of one value."""
        return np.where(self.high > self.low, np.sqrt(self.squares / self.classes.sum()), 0.0)

    @property
    def balanced(self) -> np.ndarray:
        """Weights n / (k n_c) of the classes that occur."""
        n = self.classes
        return np.where(n > 0, n.sum() / np.maximum(n, 1) / max(1, (n > 0).sum()), 0.0)


def moments(rows: DataFrame, width: int, n_classes: int) -> dict[int, Moments]:
    """Moments of each block; a row per task and block reaches the driver."""
    def run(batches):
        found: dict[int, Moments] = {}
        for b, y, x in _parts(batches, width):
            m = x.mean(axis=1)
            own = Moments(np.bincount(y, minlength=n_classes).astype(np.float64), m, ((x - m[:, None]) ** 2).sum(axis=1), x.min(axis=1), x.max(axis=1))
            found[b] = found[b] + own if b in found else own
        for b, m in found.items():
            yield pa.record_batch([pa.array([b], pa.int32()), pa.array([np.concatenate([m.classes, m.mean, m.squares, m.low, m.high]).tobytes()], pa.binary())],
                                  names=["block", "m"])

    out: dict[int, Moments] = {}
    for r in rows.mapInArrow(run, "block int, m binary").collect():
        m = Moments(*np.split(np.frombuffer(r["m"]), [n_classes + i * width for i in range(4)]))
        out[r["block"]] = out[r["block"]] + m if r["block"] in out else m
    return out


@dataclass
class Logistic:
    """Margins of each class on the raw columns; a Spark transformer by its ``transform``.

    One class against the rest each, or all together (``kind`` 'multinomial').  A class that no row had is never said.
    """
    kind: str
    features: list[str]
    coefficients: np.ndarray        # columns x classes
    intercepts: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Classes x rows from columns x rows."""
        return self.coefficients.T @ x + self.intercepts[:, None]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``rawPrediction`` (array by class) and ``prediction``, the first of the classes with the largest."""
        def margin(k: int) -> Column:
            out = F.lit(float(self.intercepts[k]))
            for c, b in zip(self.features, self.coefficients[:, k]):
                out = out + F.lit(float(b)) * F.col(c).cast("double")
            return out

        out = df.withColumn("rawPrediction", F.array(*[margin(k) for k in range(len(self.intercepts))]))
        return out.withColumn("prediction", (F.array_position("rawPrediction", F.array_max("rawPrediction")) - 1).cast("double"))


@dataclass
class _Fit:
    """One minimum that is looked for: ``cls`` against the rest, or all classes (-1), on the rows of blocks before ``upto``."""
    upto: int
    cls: int
    weight: np.ndarray              # of each class
    n: float
    penalty: np.ndarray             # of each squared cell of ``at``
    free: np.ndarray                # cells that may move
    at: np.ndarray                  # (1 + columns) x classes, flat; the point to look at
    best: np.ndarray | None = None
    loss: float = np.inf
    step: np.ndarray | None = None
    slope: float = 0.0
    length: float = 1.0
    done: bool = False

    def move(self, loss: float, gradient: np.ndarray, hessian: np.ndarray) -> None:
        """A Newton step from ``at`` if the loss fell there, else half of the last one."""
        loss = loss / self.n + (self.penalty * self.at ** 2).sum() / 2
        if not np.isfinite(loss) and self.best is None:
            raise ValueError("columns of a logistic regression hold nulls or non-finite numbers")
        if self.best is not None and not loss <= self.loss + 1e-4 * self.length * self.slope + 1e-13 * abs(self.loss):
            self.length /= 2
            self.at, self.done = self.best + self.length * self.step, self.length < 1e-9
            if self.done:
                self.at = self.best
            return
        g = np.where(self.free, gradient / self.n + self.penalty * self.at, 0.0)
        h = np.where(np.outer(self.free, self.free), hessian / self.n + np.diag(self.penalty), 0.0)
        h[~self.free, ~self.free] = 1.0
        self.best, self.loss, self.length = self.at, loss, 1.0
        self.step = -np.linalg.lstsq(h, g, rcond=1e-15)[0]
        self.slope = float(g @ self.step)
        self.at = self.best + self.step if self.slope < 0 else self.best
        self.done = self.slope > -TOLERANCE * max(loss, 1e-6)       # then one more step, without another look


def _sums(rows: DataFrame, fits: list[_Fit], base: Moments, n_classes: int) -> list[tuple]:
    """Loss, gradient and Hessian of every fit at its point, over all rows of its blocks."""
    width = len(base.mean)
    p, together = width + 1, fits[0].cls < 0
    k = n_classes if together else 1
    upper = np.triu_indices(p)
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    centre, scale = base.mean[:, None], np.where(base.spread > 0, base.spread, 1.0)[:, None]
    upto, cls = np.array([f.upto for f in fits]), np.array([f.cls for f in fits])
    points = np.stack([f.at.reshape(p, k).T for f in fits])          # fits x classes x columns
    weight = np.stack([f.weight for f in fits])
    size = 1 + p * k + len(upper[0]) * len(pairs)

    def run(batches):
        total = np.zeros((len(fits), size))
        for b, y, raw in _parts(batches, width):
            on = np.flatnonzero(upto > b)
            if not len(on):
                continue
            n = len(y)
            x = np.empty((p, n))
            x[0], x[1:] = 1.0, (raw - centre) / scale
            m = (points[on].reshape(-1, p) @ x).reshape(len(on), k, n)
            w = weight[on][:, y]
            if together:
                m += np.where(weight[on] > 0, 0.0, -np.inf)[:, :, None]
                top = m.max(axis=1)
                e = np.exp(m - top[:, None])
                mass = e.sum(axis=1)
                total[on, 0] += (w * (np.log(mass) + top - m[:, y, np.arange(n)])).sum(axis=1)
                e /= mass[:, None]
                q = np.stack([w * e[:, a] * ((a == c) - e[:, c]) for a, c in pairs], axis=1)
                e[:, y, np.arange(n)] -= 1.0
                r = w[:, None] * e
            else:
                m, hit = m[:, 0], cls[on][:, None] == y
                total[on, 0] += (w * (np.logaddexp(0.0, m) - np.where(hit, m, 0.0))).sum(axis=1)
                e = 1.0 / (1.0 + np.exp(-np.clip(m, -700.0, 700.0)))
                r, q = (w * (e - hit))[:, None], (w * e * (1.0 - e))[:, None]
            total[on, 1:1 + p * k] += (r.reshape(-1, n) @ x.T).reshape(len(on), -1)
            z = np.concatenate([x[i] * x[i:] for i in range(p)])
            total[on, 1 + p * k:] += (q.reshape(-1, n) @ z.T).reshape(len(on), -1)
        yield pa.record_batch([pa.array(range(len(fits)), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], names=["fit", "sums"])

    def add(table: pa.Table) -> pa.Table:
        own = sum(np.frombuffer(s) for s in table["sums"].to_pylist())
        return pa.table([table["fit"].slice(0, 1), pa.chunked_array([pa.array([own.tobytes()], pa.binary())])], names=["fit", "sums"])

    parts = rows.mapInArrow(run, "fit int, sums binary")
    found = {r["fit"]: np.frombuffer(r["sums"]) for r in parts.groupBy("fit").applyInArrow(add, "fit int, sums binary").collect()}
    out = []
    for i in range(len(fits)):
        s = found[i]
        h = np.zeros((k, k, p, p))
        for (a, c), v in zip(pairs, s[1 + p * k:].reshape(len(pairs), -1)):
            h[a, c][upper] = v
            h[a, c] += np.triu(h[a, c], 1).T
            h[c, a] = h[a, c]
        out.append((s[0], s[1:1 + p * k].reshape(k, p).T.reshape(-1), h.transpose(2, 0, 3, 1).reshape(p * k, p * k)))
    return out


def fit_all(rows: DataFrame, features: list[str], jobs: list[tuple], kind: str, n_classes: int = 4,
            blocks: dict[int, Moments] | None = None) -> list[Logistic]:
    """A model for each ``(upto, penalty)`` of ``jobs``: balanced classes, columns scaled on the rows of the blocks before ``upto``.

    The mean weighted loss plus ``penalty(n)`` / 2 times the squares of the coefficients of the scaled columns is minimal;
    ``kind`` is 'multinomial' or 'one_vs_rest', ``rows`` are :func:`packed`.
    """
    width = len(features)
    blocks = blocks or moments(rows, width, n_classes)
    base = sum_of(blocks, max(u for u, _ in jobs))
    scale = np.where(base.spread > 0, base.spread, 1.0)
    fits: list[list[_Fit]] = []
    for upto, penalty in jobs:
        own = sum_of(blocks, upto)
        n, weight, spread = own.classes.sum(), own.balanced, own.spread / scale
        here, k = np.flatnonzero(weight > 0), n_classes if kind == "multinomial" else 1
        share = np.concatenate([[0.0], float(penalty(int(n))) * spread ** 2])
        free = np.concatenate([[True], spread > 0])
        made = []
        for c in ([-1] if kind == "multinomial" else here.tolist()) if len(here) > 1 else []:
            at = np.zeros((width + 1, k))
            if c >= 0:
                at[0] = -np.log(len(here) - 1)
            cells = np.outer(free, weight > 0) if c < 0 else free[:, None]
            made.append(_Fit(upto, c, weight, n, np.repeat(share, k), cells.reshape(-1), at.reshape(-1)))
        fits.append(made)
    moving = [f for made in fits for f in made]
    for _ in range(PASSES):
        if not moving:
            break
        for f, s in zip(moving, _sums(rows, moving, base, n_classes)):
            f.move(*s)
        moving = [f for f in moving if not f.done]
    if moving:
        raise RuntimeError(f"{len(moving)} logistic regressions still move after {PASSES} passes")
    out = []
    for (upto, _), made in zip(jobs, fits):
        here = sum_of(blocks, upto).classes > 0
        b, a = np.zeros((width, n_classes)), np.where(here, 0.0 if kind == "multinomial" or here.sum() > 1 else np.inf, -np.inf)
        for f in made:
            cells = f.at.reshape(width + 1, -1)
            at = slice(None) if f.cls < 0 else slice(f.cls, f.cls + 1)
            b[:, at] = cells[1:] / scale[:, None]
            a[at] += cells[0] - base.mean @ b[:, at]
        out.append(Logistic(kind, list(features), b, a))
    return out


def sum_of(blocks: dict[int, Moments], upto: int) -> Moments:
    """Moments of all rows in blocks before ``upto``."""
    own = [m for b, m in sorted(blocks.items()) if b < upto]
    if not own:
        raise ValueError("no rows to fit")
    out = own[0]
    for m in own[1:]:
        out = out + m
    return out


def confusions(rows: DataFrame, models: list[Logistic], blocks: list[int], n_classes: int = 4) -> DataFrame:
    """``(model, y_true, y_pred, n)`` of each model on all rows of its block, models by their number in the list."""
    width = len(models[0].features)

    def run(batches):
        counts = np.zeros((len(models), n_classes ** 2), dtype=np.int64)
        for b, y, x in _parts(batches, width):
            for i, m in enumerate(models):
                if blocks[i] == b:
                    counts[i] += np.bincount(y * n_classes + m.margins(x).argmax(axis=0), minlength=n_classes ** 2)
        i, c = np.nonzero(counts)
        yield pa.record_batch([pa.array(v, t) for v, t in ((i, pa.int32()), (c // n_classes, pa.int32()), (c % n_classes, pa.int32()), (counts[i, c], pa.int64()))],
                              names=["model", "y_true", "y_pred", "n"])

    found = rows.mapInArrow(run, "model int, y_true int, y_pred int, n long")
    return found.groupBy("model", "y_true", "y_pred").agg(F.sum("n").alias("n"))
