"""Embedding near-duplicates through a pivot-permutation index.

A vector is described by its nearest pivots in order.  Inverted lists hold the vectors by pivot;
asking for two shared pivots at least is the same as one list per pair of pivots, so the count is
part of the list's key and no pair of vectors is counted up in a shuffle.  Lists are verified in
blocks of bounded size by exact double precision cosines; a pair is taken only in the list of its
two smallest shared pivots, so it counts once.  Equal vectors are one class before anything else.

Pivots keep a set angle from each other.  Else a dense region would hold many of them, all about
equally near to its vectors, whose order says nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from spendlens.llm.graph import components
from spendlens.llm.shared import checkpointed


#: Vectors on which the length of the prefixes is tried.
SAMPLE = 512


def usable(v: Column) -> Column:
    """Vectors with finite components that are not all zero."""
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def choose_pivots(classes: DataFrame, most: int, apart: float, threshold: float, nearest: int) -> dict[int, tuple[np.ndarray, int]]:
    """Unit pivots by dimension and the length of their prefixes.

    Candidates are the first vectors by a hash of the vector, twice ``most`` and a sample for the
    prefix length.  Every task keeps its own first vectors, so no more than these meet in one place.
    """
    sized = classes.select("uid", "vector", F.size("vector").alias("_d"))
    out = {}
    for d in sorted(r["_d"] for r in sized.select("_d").distinct().collect()):
        first = sized.where(F.col("_d") == d).orderBy(F.xxhash64("vector"), "uid").limit(2 * most + SAMPLE)
        x = first.select("vector").toArrow()["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        x = _units(x.reshape(-1, d).astype(np.float64))
        pivots = thinned(x[:2 * most], most, apart)
        out[d] = pivots, prefix_length(x[-SAMPLE:], pivots, threshold, nearest)
    return out


def thinned(x: np.ndarray, most: int, apart: float) -> np.ndarray:
    """The first ``most`` of unit vectors ``x`` of which no two have a cosine of ``apart`` or more."""
    kept = x[:0]
    for s in range(0, len(x), 256):
        some = x[s:s + 256]
        if len(kept):
            some = some[(some @ kept.T).max(axis=1) < apart]
        near, free = some @ some.T >= apart, []
        for i in range(len(some)):
            if not near[i, free].any():
                free.append(i)
        kept = np.concatenate([kept, some[free]])[:most]
        if len(kept) == most:
            break
    return kept


def prefix_length(x: np.ndarray, pivots: np.ndarray, threshold: float, least: int, recall: float = 0.995) -> int:
    """Shortest prefix, ``least`` at least, under which ``recall`` of the links of unit vectors ``x`` share two pivots.

    The links tried are the hardest ones, at a cosine of ``threshold`` in a random direction.  A link shares a pivot
    from the larger of its two ranks on, so it needs a prefix up to the second smallest of these; nothing bounds
    the length but the number of pivots, which every link shares.
    """
    least = min(least, len(pivots))
    if least == len(pivots) or len(pivots) < 2 or x.shape[1] < 2 or not len(x):
        return least
    side = np.random.default_rng(0).normal(size=x.shape)
    side = _units(side - (side * x).sum(axis=1, keepdims=True) * x)
    near, need = threshold * x + sqrt(1 - threshold ** 2) * side, []
    for s in range(0, len(x), 64):
        ranks = [np.argsort(np.argsort(-(v[s:s + 64] @ pivots.T), axis=1, kind="stable"), axis=1) for v in (x, near)]
        need.append(np.partition(np.maximum(*ranks), 1, axis=1)[:, 1] + 1)
    need = np.sort(np.concatenate(need))
    return max(least, int(need[ceil(recall * len(need)) - 1]))


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)        # no overflow or underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def index(classes: DataFrame, pivots: dict[int, tuple[np.ndarray, int]]) -> DataFrame:
    """``(key, uid, prefix)``: inverted lists by dimension and pair of pivots.

    ``prefix`` holds the vector's nearest pivots in order of nearness.  A single pivot makes one
    list of all vectors.
    """
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            dims = b["vector"].map(len)
            for d, part in b.groupby(dims):
                p, k = shared.value[int(d)]
                for i in range(0, len(part), 2048):
                    some = part.iloc[i:i + 2048]
                    sims = _units(np.stack(some["vector"]).astype(np.float64)) @ p.T
                    prefix = np.argsort(-sims, axis=1, kind="stable")[:, :k].astype(np.int32)
                    ranked = np.sort(prefix, axis=1).astype(np.int64)
                    pairs = list(combinations(range(k), 2)) or [(0, 0)]
                    keys = np.stack([(d << 44) | (ranked[:, a] << 22) | ranked[:, c] for a, c in pairs], axis=1)
                    uid = np.repeat(some["uid"].to_numpy(), len(pairs))
                    held = np.repeat(np.array([r.tobytes() for r in prefix], dtype=object), len(pairs))
                    yield pd.DataFrame({"key": keys.ravel(), "uid": uid, "prefix": held})

    return classes.select("uid", "vector").mapInPandas(run, "key long, uid long, prefix binary")


def _own(i: np.ndarray, j: np.ndarray, prefix: np.ndarray, key: int) -> np.ndarray:
    """Which pairs of positions share no pivots before the two of the list, by sorted prefixes."""
    first, second = (key >> 22) & ((1 << 22) - 1), key & ((1 << 22) - 1)
    before = (prefix < second) & (prefix != first)
    names, at = np.unique(prefix[before], return_inverse=True)
    own = np.ones(len(i), dtype=bool)
    if len(names) <= 4 * prefix.shape[1] ** 2:    # few names: a product of their marks costs less
        marks = np.zeros((len(prefix), len(names)), dtype=np.float32)
        marks[np.nonzero(before)[0], at] = 1
        a, i = np.unique(i, return_inverse=True)
        b, j = np.unique(j, return_inverse=True)
        return (marks[a] @ marks[b].T == 0)[i, j]
    held = np.where(before, prefix, -1 - np.arange(len(prefix))[:, None])
    for t in range(0, len(i), 100_000):
        a, b = held[i[t:t + 100_000]], held[j[t:t + 100_000]]
        own[t:t + 100_000] = ~(a[:, :, None] == b[:, None, :]).any(axis=(1, 2))
    return own


def _verify(g: pd.DataFrame, threshold: float, dtype) -> pd.DataFrame | None:
    """Links of one block pair of one list: weight of linked vectors and a root for each vector."""
    key, lo, hi = int(g["key"].iloc[0]), int(g["lo"].iloc[0]), int(g["hi"].iloc[0])
    x = _units(np.frombuffer(b"".join(g["packed"]), dtype=dtype).reshape(len(g), -1).astype(np.float64))
    prefix = np.sort(np.frombuffer(b"".join(g["prefix"]), dtype=np.int32).reshape(len(g), -1), axis=1).astype(np.int64)
    block, uid, n = g["block"].to_numpy(), g["uid"].to_numpy(), g["n"].to_numpy()
    rows, cols = np.nonzero(block == lo)[0], np.nonzero(block == hi)[0]
    links, root = np.zeros(len(g), dtype=np.int64), np.arange(len(g))
    found_i, found_j = [], []
    for s in range(0, len(rows), 512):
        i, j = np.nonzero(x[rows[s:s + 512]] @ x[cols].T >= threshold)
        i, j = rows[s + i], cols[j]
        if lo == hi:
            i, j = i[i < j], j[i < j]
        own = _own(i, j, prefix, key)
        found_i.append(i[own])
        found_j.append(j[own])
    i, j = np.concatenate(found_i or [rows[:0]]), np.concatenate(found_j or [rows[:0]])
    if not len(i):
        return None
    np.add.at(links, i, n[j])
    np.add.at(links, j, n[i])
    while True:                                         # smallest position reachable inside the block pair
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    some = links > 0
    return pd.DataFrame({"uid": uid[some], "links": links[some], "root": uid[root[some]]})


def verified(lists: DataFrame, threshold: float, dtype) -> DataFrame:
    """``(uid, links, root)`` from lists cut into block pairs and sorted by them."""
    group = ["key", "lo", "hi"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done() -> Iterator[pd.DataFrame]:
            if held and sum(map(len, held)) > 1:
                out = _verify(held[0] if len(held) == 1 else pd.concat(held), threshold, dtype)
                if out is not None:
                    yield out
            held.clear()

        for b in batches:
            edge = (b[group] != b[group].shift()).any(axis=1).to_numpy()
            starts = np.append(np.nonzero(edge)[0], len(b))
            for s, e in zip(starts[:-1], starts[1:]):
                part = b.iloc[s:e]
                if held and tuple(held[-1][group].iloc[0]) != tuple(part[group].iloc[0]):
                    yield from done()
                held.append(part)
        yield from done()

    return lists.mapInPandas(run, "uid long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, nearest: int = 7, block: int = 1024,
                    most_pivots: int = 16_384, apart: float = 0.7) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``: one row per row of ``vectors(vec_id, embedding)``.

    Vectors are linked at a cosine of ``threshold`` or more.  ``n_links`` counts the other vectors
    linked directly, ``component_id`` is the smallest vec_id reachable.  Null or zero vectors and
    those with null or non-finite components link with nothing, equal ones included; vectors of
    different length never link.  The square root of the number of distinct vectors, 64 at least
    and ``most_pivots`` at most, are pivots, fewer where vectors lie so close that no more have
    cosines under ``apart`` (or the threshold) with each other; a region within that angle is
    compared whole.  Every vector is indexed, by ``nearest`` pivots or as many more as links at the
    threshold need.  Repeated rows are vectors of their own.  A
    null vec_id is ignored by the minimum.
    """
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    dtype = np.float32 if kind == "float" else np.float64
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast(f"array<{'float' if kind == 'float' else 'double'}>").alias("vector"))
    classes = checkpointed(rows.where(usable(F.col("vector"))).groupBy("vector")
                           .agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
                           .withColumn("uid", F.monotonically_increasing_id()))
    pivots = choose_pivots(classes, min(most_pivots, max(64, ceil(sqrt(classes.count())))), min(apart, threshold),
                           threshold, nearest)
    keys = checkpointed(index(classes, pivots))
    counts = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    lists = keys.join(counts, "key")
    lists = lists.withColumn("blocks", F.ceil(F.col("size") / block).cast("long"))
    lists = lists.withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")))
    lists = lists.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    lists = lists.select("key", "uid", "prefix", "block", F.least("block", "_other").alias("lo"),
                         F.greatest("block", "_other").alias("hi"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            packed = [np.asarray(v, dtype=dtype).tobytes() for v in b["vector"]]
            yield pd.DataFrame({"uid": b["uid"], "n": b["n"], "packed": packed})

    packed = classes.select("uid", "n", "vector").mapInPandas(pack, "uid long, n long, packed binary")
    lists = lists.join(packed, "uid").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "uid")
    found = checkpointed(verified(lists.select("key", "lo", "hi", "block", "uid", "n", "prefix", "packed"), threshold, dtype))
    linked = found.groupBy("uid").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    named = (classes.join(linked, "uid", "left").join(parts, classes["uid"] == parts["node"], "left")
             .select("vector", "low", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "uid").alias("root")))
    roots = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(roots, "root").select(F.col("vector").alias("_vector"), (F.col("n") - 1 + F.col("links")).alias("n_links"),
                                             "component_id")
    out = rows.join(named, F.col("vector") == F.col("_vector"), "left")
    alone = F.col("_vector").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate component and number of links of every vector."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT *, coalesce(len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(e, lambda x: x <> 0)) > 0, false) AS ok FROM v),
g AS (SELECT rid, vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM u WHERE ok),
l AS (SELECT a.rid AS r, a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.rid <> b.rid AND len(a.e) = len(b.e)
        AND list_dot_product(a.e, b.e) >= 0.9::DOUBLE * a.norm * b.norm),
n AS (SELECT r, count(*) AS n FROM l GROUP BY r),
p AS (WITH RECURSIVE c AS (SELECT DISTINCT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a) SELECT a, min(b) AS b FROM c GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(p.b, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(p.b, vec_id)) AS kept
FROM u LEFT JOIN n ON u.rid = n.r LEFT JOIN p ON u.vec_id = p.a
"""
