"""Connected components of a distributed edge list by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spendlens.llm.shared import checkpointed


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return (both.where("v > u").join(low, "u").where("v <> m")
            .select(F.col("m").alias("a"), F.col("v").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("b").agg(F.min("a").alias("m"))
    rest = edges.join(low, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return rest.unionByName(low.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of the undirected ``edges(a, b)`` of non-null longs.

    ``component`` is the smallest node reachable.  Each round replaces edges by stars around
    neighbourhood minima (a logarithmic number of rounds in the diameter); a hub only ever meets
    its neighbours through a minimum and a join that adaptive execution can split, and each
    round's edges are checkpointed.  Self-loops and repeated edges are ignored; no edges give no
    rows.
    """
    e = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                     .where("a < b").distinct())
    state = _state(e)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        e = checkpointed(_small_star(_large_star(e)))
        before, state = state, _state(e)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return (e.select(F.col("b").alias("node"), F.col("a").alias("component"))
            .unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()))
