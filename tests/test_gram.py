"""Regressors from sums of products against Spark ML, a dense solution, and the optimality of the penalised minimum."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlens.operators import gram as G
from spendlens.operators import train as T

NUM, CAT = ["a", "b", "c"], ["k", "side"]


def frame(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, float(rng.normal(100, 20)), float(rng.exponential(3)), 7.0, "xyz"[int(rng.integers(3))], "lr"[int(rng.integers(2))]) for i in range(n)]
    rows = [(*r, 3 * r[1] - 20 * r[2] + {"x": 5, "y": -40, "z": 90}[r[4]] + (12 if r[5] == "l" else 0) + float(rng.normal(0, 9))) for r in rows]
    return spark.createDataFrame(rows, "i long, a double, b double, c double, k string, side string, y double")


def dense(df):
    rows = df.orderBy("i").collect()
    x = np.array([[r[c] for c in NUM] for r in rows])
    x = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    hot = np.array([[float(r["k"] == v) for v in "xyz"] + [float(r["side"] == v) for v in "lr"] for r in rows])
    return np.hstack([x, hot]), np.array([r["y"] for r in rows])


def predictions(df, model):
    return np.array([r["p"] for r in df.select("i", model.prediction().alias("p")).orderBy("i").collect()])


def test_ridge_agrees_with_spark_ml_and_with_dense_rows(spark):
    df = frame(spark).repartition(3)
    d = G.design(df, NUM, CAT, "y")
    got = predictions(df, G.solve(d, d.upto(1), "ridge", 1.0))
    s = df.agg(F.stddev_pop("y")).first()[0]       # by which Spark divides the label
    ml = T.linear_regressor(NUM, CAT, "y", "ridge", 400, s, alpha=1.0).fit(df)
    want = np.array([r["prediction"] for r in ml.transform(df).orderBy("i").collect()])
    assert np.abs(got - want).max() <= 1e-6 * np.abs(want).max()
    x, y = dense(df)
    xc, yc = x - x.mean(axis=0), y - y.mean()
    b = np.linalg.solve(xc.T @ xc + np.eye(x.shape[1]), xc.T @ yc)
    assert np.allclose(got, xc @ b + y.mean(), rtol=1e-9, atol=1e-6)


@pytest.mark.parametrize("kind, alpha", [("elasticnet", 0.5), ("elasticnet", 0.001), ("sgd", 0.01)])
def test_penalised_minimum(spark, kind, alpha):
    df = frame(spark, 300, 2)
    d = G.design(df, NUM, CAT, "y")
    model = G.solve(d, d.upto(1), kind, alpha, 0.2)
    x, y = dense(df)
    scale = np.array([r for r in df.agg(*[F.stddev_pop(c) for c in NUM]).first()])
    b = np.concatenate([[model.numeric[c] for c in NUM] * scale, [model.hot["k", v] for v in "xyz"], [model.hot["side", v] for v in "lr"]])
    xc, yc = x - x.mean(axis=0), y - y.mean()
    slope = xc.T @ (yc - xc @ b) / len(y)                       # of the mean squared error over 2, downwards
    l1, l2 = (alpha * 0.2, alpha * 0.8) if kind == "elasticnet" else (0.0, alpha)
    for g, v in zip(slope, b):
        assert abs(g - l2 * v - l1 * np.sign(v)) < 1e-5 if abs(v) > 1e-9 else abs(g) <= l1 + 1e-5


def test_blocks_add_up_and_unseen_values_add_nothing(spark):
    df = frame(spark, 300, 3).withColumn("block", (F.col("i") / 100).cast("int"))
    df = df.withColumn("k", F.when(F.col("block") == 2, "new").otherwise(F.col("k"))).withColumn("side", F.when(F.col("i") > 4, F.col("side")))
    d = G.design(df, NUM, CAT, "y", F.col("block"))
    part = G.design(df.where("block < 2"), NUM, CAT, "y")
    a, b = G.solve(d, d.upto(2), "ridge", 1.0), G.solve(part, part.upto(1), "ridge", 1.0)
    assert abs(a.hot["k", "new"]) < 1e-9 and ("side", None) in a.hot
    assert np.allclose(predictions(df, a), predictions(df, b), rtol=1e-9, atol=1e-6)
