"""Random forests on binned columns: Spark deals trees to tasks, a task grows its trees level by level on all rows.

Columns are cut at quantiles once, so a row is a few bytes.  Rows are put in order by a hash and packed, and every group
of trees gets all of them; a task keeps them as bytes, in a file where they are many, and streams them through each level.
Trees of a forest differ by their bootstrap and feature draws.  A tree keeps the class
shares of its inner nodes, so one that is grown deep also serves as each of its shallower versions, and a
forest as each of its shorter ones; the search uses both.
"""

from __future__ import annotations

import tempfile
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property
from math import log2, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..session import checkpointed

BINS = 32
ROWS_PER_GROUP = 500_000
#: Rows that go through a tree together: their bins and nodes stay in the processor's cache.
ROWS_AT_ONCE = 8_192
#: Rows that go through a level of a growing tree together, and nodes whose histograms are held together.
ROWS_OF_A_PIECE, NODES_OF_A_RANGE = 65_536, 4_096
#: Rows that are sorted in one task, and rows of a compressed string; a batch of Arrow holds thousands of the latter.
ROWS_OF_A_PART, ROWS_OF_A_STRING = 100_000, 1_024
#: Bytes of bins that a task holds in memory; more lie in a file without a name, which ends with the task.
BYTES_IN_MEMORY = 64 << 20


def bin_edges(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of the bins of each column: its distinct quantiles, to a thousandth in rank."""
    found = df.approxQuantile(features, [k / bins for k in range(1, bins)], 0.001)
    return [np.unique(np.array(q, dtype=np.float64)) for q in found]


def binned(columns: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """Rows x columns of bin numbers; a value is in the first bin whose edge it does not exceed, null in the first."""
    return np.stack([np.searchsorted(e, np.nan_to_num(np.asarray(c, dtype=np.float64), nan=-np.inf)) for c, e in zip(columns, edges)],
                    axis=1).astype(np.uint8)


def binned_rows(df: DataFrame, features: list[str], label: str, edges: list[np.ndarray], keep: list[str]) -> DataFrame:
    """``(keep..., _y, _order, _bins)``: one byte string per row, and a hash that orders rows alike in any run."""
    @F.pandas_udf("binary")
    def pack(*cols: pd.Series) -> pd.Series:
        return pd.Series([r.tobytes() for r in binned([c.to_numpy() for c in cols], edges)], dtype=object)

    return df.select(*keep, F.col(label).cast("int").alias("_y"), F.xxhash64(*features, label).alias("_order"),
                     pack(*[F.col(c).cast("double") for c in features]).alias("_bins"))


def draws(max_features: str | int, d: int) -> int:
    """Columns that a node looks at."""
    n = {"sqrt": int(sqrt(d)), "log2": int(log2(d)) if d > 1 else 1}.get(max_features, max_features)
    return max(1, min(d, int(n)))


@dataclass
class Tree:
    """Nodes in level order: column and bin of the split, first of the two children (0: leaf), class shares, gain."""
    column: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    share: np.ndarray
    gain: np.ndarray

    @cached_property
    def steps(self) -> np.ndarray:
        """One number a node: next node, cut and column.  A leaf leads to itself, past a cut that no bin exceeds."""
        own = np.arange(len(self.child), dtype=np.int64)
        leaf = self.child <= 0
        return (np.where(leaf, own, self.child).astype(np.int64) << 24) | (np.where(leaf, 255, self.cut).astype(np.int64) << 16) | self.column

    def nodes_at_depths(self, x: np.ndarray, depths: list[int]) -> list[np.ndarray]:
        """Nodes that rows ``x`` (C order) are in at each of the growing ``depths``; rows in leaves are set aside on the way."""
        steps, cells, width = self.steps, x.reshape(-1), x.shape[1]
        node, rows, out = np.zeros(len(x), dtype=np.int64), None, []
        at, base, moving = node, np.arange(len(x), dtype=np.int64) * width, True
        for depth in range(max(depths) + 1):
            if depth in depths:
                if rows is not None:
                    node[rows] = at
                out.append(node.copy())
            if moving:
                step = steps[at]
                after = (step >> 24) + (cells[base + (step & 0xFFFF)] > ((step >> 16) & 0xFF))
                if depth % 3 == 2:
                    on = np.flatnonzero(after != at)
                    moving = len(on) > 0
                    if len(on) < 0.7 * len(at):
                        if rows is None:
                            node = after
                        else:
                            node[rows] = after
                        rows, base, after = on if rows is None else rows[on], base[on], after[on]
                at = after
                if rows is None:
                    node = at
        return out

    def at_depths(self, x: np.ndarray, depths: list[int]) -> list[np.ndarray]:
        """Class shares of rows ``x`` for the tree cut at each of the growing ``depths``."""
        x = np.ascontiguousarray(x)
        return [self.share[node] for node in self.nodes_at_depths(x, depths)]


def grow(x: np.ndarray, y: np.ndarray, class_weight: np.ndarray, rng: np.random.Generator, max_depth: int, min_leaf: int,
         min_split: int, n_draws: int) -> Tree:
    """One tree on a bootstrap of all of ``x`` (rows x columns of bins, C order): best weighted Gini cut of the drawn columns at each node.

    Rows go through a level in pieces and nodes in ranges, so that beside ``x``, which may lie in a file, a tree holds ten bytes a drawn row.
    """
    n_classes, d = len(class_weight), x.shape[1]
    cells = x.reshape(-1)
    bag = []
    for start in range(0, len(x), ROWS_OF_A_PIECE):
        t = rng.poisson(1.0, min(ROWS_OF_A_PIECE, len(x) - start))
        hit = np.flatnonzero(t)
        bag.append(((hit + start).astype(np.uint32 if len(x) < 1 << 32 else np.int64), y[start:start + ROWS_OF_A_PIECE][hit].astype(np.uint8), t[hit].astype(np.uint8)))
    rows, y, times = (np.concatenate(c) for c in zip(*bag)) if bag else (np.zeros(0, np.uint32), np.zeros(0, np.uint8), np.zeros(0, np.uint8))
    del bag
    node = np.zeros(len(rows), dtype=np.int32)      # place among the open nodes of the level
    total = np.bincount(y, times, minlength=n_classes)[None]
    parts: list[tuple] = []
    n_nodes, until = 1, None
    for depth in range(max_depth + 1):
        weighted = total * class_weight
        mass = np.maximum(weighted.sum(axis=1), 1e-12)
        share, own = weighted / mass[:, None], (weighted ** 2).sum(axis=1) / mass
        size, k = total.sum(axis=1), len(total)
        column, cut, child, gain = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k)
        parts.append((column, cut, child, share, gain))
        # Drawn for every node whatever the limits, so that deeper trees begin like shallower ones.
        drawn = np.concatenate([np.argsort(rng.random((min(NODES_OF_A_RANGE, k - at), d)), axis=1)[:, :n_draws] for at in range(0, k, NODES_OF_A_RANGE)])
        open_ = np.nonzero((size >= max(min_split, 2 * min_leaf)) & ((total > 0).sum(axis=1) > 1))[0]
        if depth == max_depth or not len(open_):
            break
        if until is not None:       # the last level's cuts move rows to the open nodes of this one
            place = np.full(k, -1, dtype=np.int32)
            place[open_] = np.arange(len(open_))
            best_column, best_cut, split = until
            to = np.full((len(split), 2), -1, dtype=np.int32)
            to[split] = place.reshape(-1, 2)
            rows, y, times, node = _moved(cells, d, rows, y, times, node, best_column, best_cut, to.reshape(-1))
        total, drawn = total[open_], drawn[open_]
        ranges = [(0, len(open_), slice(None))]
        if len(open_) > NODES_OF_A_RANGE:
            order = np.argsort(node, kind="stable")
            rows, y, times, node = rows[order], y[order], times[order], node[order]
            del order
            firsts = np.arange(0, len(open_), NODES_OF_A_RANGE)
            begins = [*np.searchsorted(node, firsts).tolist(), len(node)]
            ranges = [(a, min(a + NODES_OF_A_RANGE, len(open_)), slice(*begins[i:i + 2])) for i, a in enumerate(firsts.tolist())]
        found = [_best_cuts(cells, d, rows[of], y[of], times[of], node[of], a, total[a:b], drawn[a:b], class_weight, min_leaf) for a, b, of in ranges]
        best, best_column, best_cut, left = (np.concatenate(c) for c in zip(*found))
        split = best > own[open_] + 1e-9
        made = np.cumsum(split) - 1
        column[open_], cut[open_] = np.where(split, best_column, 0), np.where(split, best_cut, 0)
        child[open_] = np.where(split, n_nodes + 2 * made, 0)
        gain[open_] = np.where(split, best - own[open_], 0.0)
        if not split.any():
            break
        until = best_column, best_cut, split
        n_nodes += 2 * int(split.sum())
        total = np.stack([left[split], total[split] - left[split]], axis=1).reshape(-1, n_classes)
    return Tree(*(np.concatenate([p[i] for p in parts]) for i in range(5)))


def _moved(cells, d, rows, y, times, node, column, cut, to):
    """Rows in the children of their nodes, by place among the open ones (``to``, -1 for none); rows of closed nodes are left out."""
    out = []
    for start in range(0, len(rows), ROWS_OF_A_PIECE):
        of = slice(start, start + ROWS_OF_A_PIECE)
        at = node[of].astype(np.int64)
        now = to.take(2 * at + (cells.take(rows[of].astype(np.int64) * d + column.take(at)) > cut.take(at)))
        on = np.flatnonzero(now >= 0)
        out.append((rows[of].take(on), y[of].take(on), times[of].take(on), now.take(on)))
    return tuple(np.concatenate(c) for c in zip(*out))


def _best_cuts(cells, d, rows, y, times, node, first, total, drawn, class_weight, min_leaf):
    """Score, column and cut of the best cut of each node from ``first`` on, and the rows of each class left of it."""
    k, n_classes, n_draws = len(drawn), len(class_weight), drawn.shape[1]
    piece, hist, columns = max(ROWS_OF_A_PIECE, 2 * k * BINS * n_classes), None, np.ascontiguousarray(drawn.T)
    for start in range(0, len(rows), piece):
        of = slice(start, start + piece)
        at, weight = node[of].astype(np.int64) - first, times[of].astype(np.float64)
        base, key = rows[of].astype(np.int64) * d, (y[of] * np.int64(k) + at) * BINS
        own = [np.bincount(key + cells.take(base + c.take(at)), weight, minlength=k * BINS * n_classes) for c in columns]
        hist = own if hist is None else [np.add(h, o, out=h) for h, o in zip(hist, own)]
    every = np.arange(k)
    best, best_column, best_cut = np.full(k, -np.inf), np.zeros(k, np.int64), np.zeros(k, np.int64)
    best_left = np.zeros((k, n_classes))
    for j in range(n_draws):
        count = hist[j].reshape(n_classes, k, BINS).cumsum(axis=2)[:, :, :-1]
        left, right = count, total.T[:, :, None] - count
        enough = (left.sum(axis=0) >= min_leaf) & (right.sum(axis=0) >= min_leaf)
        left, right = left * class_weight[:, None, None], right * class_weight[:, None, None]
        score = (left * left).sum(axis=0) / np.maximum(left.sum(axis=0), 1e-12) + (right * right).sum(axis=0) / np.maximum(right.sum(axis=0), 1e-12)
        score = np.where(enough, score, -np.inf)
        where = score.argmax(axis=1)
        score = score[every, where]
        better = score > best
        best, best_cut = np.where(better, score, best), np.where(better, where, best_cut)
        best_column = np.where(better, drawn[:, j], best_column)
        best_left = np.where(better[:, None], count[:, every, where].T, best_left)
    return best, best_column, best_cut, best_left


def balanced(y: np.ndarray, n_classes: int) -> np.ndarray:
    """Weights n / (k n_c) of the classes that occur."""
    n = np.bincount(y, minlength=n_classes)
    return np.where(n > 0, len(y) / np.maximum(1, n) / max(1, (n > 0).sum()), 0.0)


def _ordered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list]:
    """Bins and classes of a group in an order that no partitioning changes."""
    bins, y = b"".join(table["_bins"].to_pylist()), table["_y"].to_numpy()
    order = np.lexsort([y, table["_order"].to_numpy()])
    return np.frombuffer(bins, np.uint8).reshape(len(y), -1)[order], y[order], order


@dataclass
class Forest:
    """Trees with the columns and edges they read; a Spark transformer by its ``transform``."""
    features: list[str]
    edges: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        total, n_classes = [], self.trees[0].share.shape[1] if self.trees else 1
        for start in range(0, len(x), ROWS_AT_ONCE):
            part = np.ascontiguousarray(x[start:start + ROWS_AT_ONCE])
            own = np.zeros((len(part), n_classes))
            for t in self.trees:
                own += t.at_depths(part, [64])[0]
            total.append(own)
        return np.concatenate(total) / max(1, len(self.trees)) if total else np.zeros((0, n_classes))

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability`` (array by class) and ``prediction``, the first of the likeliest classes."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf(ArrayType(DoubleType()))
        def score(*cols: pd.Series) -> pd.Series:
            m = shared.value
            p = m.probabilities(binned([c.to_numpy() for c in cols], m.edges)) if len(cols[0]) else []
            return pd.Series(list(p), dtype=object)

        out = df.withColumn("probability", score(*[F.col(c).cast("double") for c in self.features]))
        return out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))

    @property
    def importances(self) -> list[float]:
        """Mean over trees of each column's share of the gains."""
        total = np.zeros(len(self.features))
        for t in self.trees:
            own = np.bincount(t.column, t.gain, minlength=len(total))
            total += own / max(own.sum(), 1e-12)
        return (total / max(total.sum(), 1e-12)).tolist()


def strings(rows: DataFrame, width: int) -> DataFrame:
    """``(part, start, n, y, x)`` of ``(_part, _y, _bins)``: many rows to a compressed string of columns; ``start`` counts the rows of a part within a task."""
    def run(batches):
        held: dict[int, tuple] = {}

        def made(p: int, every: bool):
            y, x, start = held[p]
            end = len(y) if every else len(y) - len(y) % ROWS_OF_A_STRING
            for s in range(0, end, ROWS_OF_A_STRING):
                e = min(end, s + ROWS_OF_A_STRING)
                yield p, start + s, e - s, y[s:e].tobytes(), pa.compress(np.ascontiguousarray(x[s:e].T).tobytes(), "zstd", asbytes=True)
            held[p] = y[end:], x[end:], start + end

        def table(got: list) -> pa.RecordBatch:
            cols = list(zip(*got)) or [[]] * 5
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                                   names=["part", "start", "n", "y", "x"])

        for batch in batches:
            of, y = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.uint8)
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(y), width)
            for p in np.unique(of).tolist():
                before = held.get(p, (y[:0], x[:0], 0))
                held[p] = np.concatenate([before[0], y[of == p]]), np.concatenate([before[1], x[of == p]]), before[2]
                yield table(list(made(p, False)))
        for p in list(held):
            yield table(list(made(p, True)))

    return rows.mapInArrow(run, "part int, start long, n int, y binary, x binary")


def packed_rows(rows: DataFrame, n: int, width: int) -> tuple[DataFrame, dict[int, int], int]:
    """All ``binned_rows``, about ``n``, as :func:`strings` in the order of their hash; the first row of each part, and the number of rows.

    A part is a range of hashes, so the order does not depend on how rows lie, and a row's place is that of its part
    plus ``start``.  The frame is kept until ``unpersist``.
    """
    n_parts = max(1, -(-n // ROWS_OF_A_PART))
    part = F.least(F.floor((F.col("_order").cast("double") / 2.0 ** 64 + 0.5) * n_parts), F.lit(n_parts - 1)).cast("int")
    dealt = (rows.select("_y", "_order", "_bins", part.alias("_part")).repartitionById(n_parts, "_part")
             .sortWithinPartitions("_part", "_order", "_y", "_bins").select("_part", "_y", "_bins"))
    packed = strings(dealt, width).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = {r["part"]: r["n"] for r in packed.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    firsts, at = {}, 0
    for p in sorted(sizes):
        firsts[p], at = at, at + sizes[p]
    return packed, firsts, at


class Rows:
    """Room for the bins and classes of ``n`` rows, filled by strings that come in any order."""
    def __init__(self, n: int, width: int, firsts: dict[int, int]):
        room = np.empty if n * width <= BYTES_IN_MEMORY else lambda shape, kind: np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=shape)
        self.x, self.y, self.firsts = room((n, width), np.uint8), np.zeros(n, np.uint8), firsts

    def put(self, part: int, start: int, n: int, y: bytes, x: bytes) -> None:
        at = self.firsts[part] + start
        self.y[at:at + n], self.x[at:at + n] = opened(n, y, x, self.x.shape[1])


def opened(n: int, y: bytes, x: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes and bins of a string's rows."""
    return np.frombuffer(y, np.uint8), np.frombuffer(pa.decompress(x, n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T


def dealt_strings(df: DataFrame, to: Column, test: bool) -> DataFrame:
    """Strings copied to each of the tasks that the array ``to`` numbers."""
    return df.select(F.explode(to).alias("task"), F.lit(test).alias("test"), "part", "start", "n", "y", "x")


def _groups(df: DataFrame, n_trees: int, trees_per_group: int | None) -> tuple[int, int]:
    """Trees of a group and number of groups: as many groups as tasks run at once, unless told otherwise."""
    each = trees_per_group or -(-n_trees // min(n_trees, df.sparkSession.sparkContext.defaultParallelism))
    return each, -(-n_trees // each)


def _trees(rows: Rows, numbers: range, seed: list[int], n_classes: int, max_depth: int, min_leaf: int, min_split: int, n_draws: int):
    """``(number, tree)``, one after another."""
    weight = balanced(rows.y, n_classes)
    for k in numbers:
        yield k, grow(rows.x, rows.y, weight, np.random.default_rng([*seed, k]), max_depth, min_leaf, min_split, n_draws)


def fit_forest(df: DataFrame, features: list[str], label: str, n_classes: int = 4, n_trees: int = 250, max_depth: int = 12, min_leaf: int = 1,
               min_split: int = 2, max_features: str = "sqrt", seed: int = 42, rows_per_group: int | None = None,
               trees_per_group: int | None = None) -> Forest:
    """L1: a forest with balanced class weights.  ``label`` holds 0 up to ``n_classes`` - 1; null labels are left out.

    Every tree learns from a bootstrap of all rows, unless ``rows_per_group`` asks for a sample of about that size by
    group.  Trees are dealt to as many groups as tasks run at once, or ``trees_per_group`` each; their number decides
    what a tree draws, the group does not.  The model is held by the driver: at most 2 ** (max_depth + 1) nodes a tree.
    """
    df = df.where(F.col(label).isNotNull())
    edges, n, width = bin_edges(df, features), df.count(), len(features)
    if not n:
        return Forest(list(features), edges)
    (each, n_groups), n_draws = _groups(df, n_trees, trees_per_group), draws(max_features, width)
    packed, firsts, n = packed_rows(binned_rows(df, features, label, edges, []), n, width)

    def run(batches):
        rows, groups = Rows(n, width, firsts), set()
        for batch in batches:
            for g, _, *string in zip(*(c.to_pylist() for c in batch.columns)):
                rows.put(*string)
                groups.add(g)
        for g in sorted(groups):
            own = rows
            if rows_per_group and rows_per_group < n:
                keep = np.flatnonzero(np.random.default_rng([seed, n_trees, g]).random(n) < rows_per_group / n)
                own = Rows(len(keep), width, {})
                own.x[:], own.y[:] = rows.x[keep], rows.y[keep]
            for k, t in _trees(own, range(g * each, min(n_trees, (g + 1) * each)), [seed], n_classes, max_depth, min_leaf, min_split, n_draws):
                yield pa.record_batch([pa.array([k], pa.int32()), *[pa.array([getattr(t, c).astype(kind).tobytes()], pa.binary()) for c, kind in _KINDS.items()]],
                                      names=["tree", *_KINDS])

    # An exchange by number: each group is a task of its own, and no sort in Spark samples its input first, which would grow every tree twice.
    dealt = dealt_strings(packed, F.sequence(F.lit(0), F.lit(n_groups - 1)), False).repartitionById(n_groups, "task")
    got = sorted(dealt.mapInArrow(run, "tree int, " + ", ".join(f"{c} binary" for c in _KINDS)).collect(), key=lambda r: r["tree"])
    packed.unpersist()
    trees = [Tree(*(np.frombuffer(r[c], kind).reshape((-1, n_classes) if c == "share" else -1) for c, kind in _KINDS.items())) for r in got]
    return Forest(list(features), edges, trees)


def forest_confusion(train: DataFrame, test: DataFrame, features: list[str], label: str, n_classes: int = 4, n_trees: int = 250, max_depth: int = 12,
                     min_leaf: int = 1, min_split: int = 2, max_features: str = "sqrt", seed: int = 42, trees_per_group: int | None = None) -> DataFrame:
    """``(y_true, y_pred, n)`` of :func:`fit_forest` on ``test``, for trees of any size: a task scores each of its trees where it grew.

    Only sums of class shares leave a task, so neither tasks nor the driver hold a forest.
    """
    train, test = (d.where(F.col(label).isNotNull()) for d in (train, test))
    edges, n, m, width = bin_edges(train, features), train.count(), test.count(), len(features)
    (each, n_groups), n_draws = _groups(train, n_trees, trees_per_group), draws(max_features, width)
    packed, firsts, n = packed_rows(binned_rows(train, features, label, edges, []), n, width)
    asked, asked_firsts, m = packed_rows(binned_rows(test, features, label, edges, []), m, width)

    def run(batches):
        rows, test_rows, groups = Rows(n, width, firsts), Rows(m, width, asked_firsts), set()
        for batch in batches:
            for g, is_test, *string in zip(*(c.to_pylist() for c in batch.columns)):
                (test_rows if is_test else rows).put(*string)
                groups.add(g)
        for g in sorted(groups):
            total = np.zeros((m, n_classes))
            for _, t in _trees(rows, range(g * each, min(n_trees, (g + 1) * each)), [seed], n_classes, max_depth, min_leaf, min_split, n_draws):
                t.share = t.share.astype(_KINDS["share"])
                for start in range(0, m, ROWS_AT_ONCE):
                    total[start:start + ROWS_AT_ONCE] += t.at_depths(test_rows.x[start:start + ROWS_AT_ONCE], [64])[0]
            for start in range(0, m, ROWS_AT_ONCE):
                of = slice(start, start + ROWS_AT_ONCE)
                yield pa.record_batch([pa.array([start], pa.int64()), pa.array([test_rows.y[of].tobytes()], pa.binary()), pa.array([total[of].tobytes()], pa.binary())],
                                      names=["start", "y", "total"])

    def add(table: pa.Table) -> pa.Table:
        said = sum(np.frombuffer(t).reshape(-1, n_classes) for t in table["total"].to_pylist()).argmax(axis=1)
        truth = np.frombuffer(table["y"][0].as_py(), np.uint8).astype(np.int64)
        counts = np.bincount(truth * n_classes + said, minlength=n_classes ** 2)
        cell = np.flatnonzero(counts)
        return pa.table([pa.array(v, t) for v, t in ((cell // n_classes, pa.int32()), (cell % n_classes, pa.int32()), (counts[cell], pa.int64()))],
                        names=["y_true", "y_pred", "n"])

    every = F.sequence(F.lit(0), F.lit(n_groups - 1))
    dealt = dealt_strings(packed, every, False).unionByName(dealt_strings(asked, every, True)).repartitionById(n_groups, "task")
    found = dealt.mapInArrow(run, "start long, y binary, total binary").groupBy("start").applyInArrow(add, "y_true int, y_pred int, n long")
    out = checkpointed(found.groupBy("y_true", "y_pred").agg(F.sum("n").alias("n")))       # at most classes squared rows
    packed.unpersist()
    asked.unpersist()
    return out


_KINDS = {"column": np.int16, "cut": np.uint8, "child": np.int32, "share": np.float32, "gain": np.float32}


def save_forest(spark, forest: Forest, path: str) -> None:
    """The forest as Parquet, a row per tree, with its columns and edges."""
    rows = [(k, list(forest.features), [e.tolist() for e in forest.edges], *[bytearray(getattr(t, c).astype(kind).tobytes()) for c, kind in _KINDS.items()],
             t.share.shape[1]) for k, t in enumerate(forest.trees)]
    spark.createDataFrame(rows, "tree int, features array<string>, edges array<array<double>>, " + ", ".join(f"{c} binary" for c in _KINDS)
                          + ", n_classes int").write.mode("overwrite").parquet(path)


def load_forest(spark, path: str) -> Forest:
    rows = spark.read.parquet(path).orderBy("tree").collect()
    trees = [Tree(*(np.frombuffer(r[c], kind).reshape((-1, r["n_classes"]) if c == "share" else -1) for c, kind in _KINDS.items())) for r in rows]
    return Forest(list(rows[0]["features"]), [np.array(e) for e in rows[0]["edges"]], trees)


def search_confusions(frame: DataFrame, folds: list[tuple[DataFrame, DataFrame]], features: list[str], label: str, settings: list[dict],
                      n_classes: int = 4, seed: int = 42, rows_per_group: int = ROWS_PER_GROUP, test_rows_per_group: int = 4_000_000) -> DataFrame:
    """``(setting, fold, y_true, y_pred, n)``, the confusion of every setting on every fold.

    ``folds`` are (train, test) pairs, ``settings`` hold n_trees, max_depth, min_leaf, min_split and max_features; ``setting``
    is the number in the list.  Settings that differ in length and depth only share their trees, and all share the bins,
    which come from the rows a fold trains on.  A fold's train rows are bounded by a hashed sample of ``rows_per_group``.
    All test rows are scored, in chunks of about ``test_rows_per_group`` that each grow the trees they need; a task holds them packed.
    """
    grown = [dict(t) for t in sorted({tuple(sorted((k, s[k]) for k in ("min_leaf", "min_split", "max_features"))) for s in settings}, key=str)]
    width, slots = len(features), frame.sparkSession.sparkContext.defaultParallelism

    def fold(pair: tuple[DataFrame, DataFrame]) -> tuple:
        train, test = pair
        edges, n, m = bin_edges(train, features), train.count(), test.count()
        rows = binned_rows(train, features, label, edges, [])
        if n > rows_per_group:
            rows = rows.where(F.pmod(F.xxhash64("_order"), F.lit(1 << 20)) < int(rows_per_group / n * (1 << 20)))
        n_chunks = max(1, -(-m // test_rows_per_group))
        chunk = F.pmod(F.xxhash64(*test.columns), F.lit(n_chunks)).cast("int")
        asked = strings(binned_rows(test.withColumn("_part", chunk), features, label, edges, ["_part"]).select("_part", "_y", "_bins"), width)
        # Enough tasks for all processors, few copies of the test rows.
        return *packed_rows(rows, min(n, rows_per_group), width), asked, n_chunks, min(len(grown), max(1, -(-4 * slots // (len(folds) * n_chunks))))

    with ThreadPoolExecutor(max_workers=4) as pool:
        made = list(pool.map(fold, folds))
    tasks, dealt = [], None
    for i, (packed, _, _, asked, n_chunks, n_bundles) in enumerate(made):
        first = len(tasks)
        tasks += [(i, b) for _ in range(n_chunks) for b in range(n_bundles)]
        begin = F.lit(first) + F.col("part") * n_bundles
        for part in (dealt_strings(packed, F.sequence(F.lit(first), F.lit(len(tasks) - 1)), False),
                     dealt_strings(asked, F.sequence(begin, begin + n_bundles - 1), True)):
            dealt = part if dealt is None else dealt.unionByName(part)
    folded = [(firsts, n, n_bundles) for _, firsts, n, _, _, n_bundles in made]

    def run(batches):
        held: dict[int, tuple] = {}
        for batch in batches:
            for task, is_test, *string in zip(*(c.to_pylist() for c in batch.columns)):
                if task not in held:
                    firsts, n, _ = folded[tasks[task][0]]
                    held[task] = Rows(n, width, firsts), []
                held[task][1].append(string[2:]) if is_test else held[task][0].put(*string)
        for task, (rows, asked) in held.items():
            fold, bundle = tasks[task]
            out = []
            for which in range(bundle, len(grown), folded[fold][2]):
                of = {k: s for k, s in enumerate(settings) if all(s[c] == v for c, v in grown[which].items())}
                depths, lengths = sorted({s["max_depth"] for s in of.values()}), {s["n_trees"] for s in of.values()}
                trees = [t for _, t in _trees(rows, range(max(lengths)), [seed, fold], n_classes, depths[-1], grown[which]["min_leaf"],
                                              grown[which]["min_split"], draws(grown[which]["max_features"], width))]
                counts = {k: np.zeros(n_classes ** 2, dtype=np.int64) for k in of}
                at_once = max(1, ROWS_AT_ONCE // ROWS_OF_A_STRING)
                for start in range(0, len(asked), at_once):
                    piece = [opened(*string, width) for string in asked[start:start + at_once]]
                    truth, part = np.concatenate([y for y, _ in piece]).astype(np.int64), np.ascontiguousarray(np.concatenate([x for _, x in piece]))
                    total = np.zeros((len(depths), len(part), n_classes))
                    for k, tree in enumerate(trees):
                        for d, share in enumerate(tree.at_depths(part, depths)):
                            total[d] += share
                        if k + 1 in lengths:
                            for number, s in of.items():
                                if s["n_trees"] == k + 1:
                                    said = total[depths.index(s["max_depth"])].argmax(axis=1)
                                    counts[number] += np.bincount(truth * n_classes + said, minlength=n_classes ** 2)
                out += [(number, fold, *divmod(c, n_classes), int(v)) for number, n in counts.items() for c, v in enumerate(n)]
            cols = list(zip(*out))
            yield pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()),
                                   pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int64())], names=["setting", "fold", "y_true", "y_pred", "n"])

    found = dealt.repartitionById(len(tasks), "task").mapInArrow(run, "setting int, fold int, y_true int, y_pred int, n long")
    out = checkpointed(found.groupBy("setting", "fold", "y_true", "y_pred").agg(F.sum("n").alias("n")))     # settings x folds x classes squared rows
    for packed, *_ in made:
        packed.unpersist()
    return out
