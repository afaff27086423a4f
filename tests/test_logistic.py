"""Fits that share their passes: the same minimum as Spark ML, whatever the partitions, folds of their own, every row read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlens.operators import logistic as L
from spendlens.operators import train as T

NAMES = ["a", "b", "c", "d"]


def frame(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b = float(rng.normal(1000, 250)), float(rng.exponential(2))
        y = int(np.argmax([rng.normal(0, 1), a / 300 - 3 + rng.normal(0, 1), b - 1.5 + rng.normal(0, 1), rng.normal(-0.5, 1)]))
        rows.append((i, a, b, 7.0, a - 100 * b, y, i * 4 // n))       # c is flat, d follows from a and b
    return spark.createDataFrame(rows, "i long, a double, b double, c double, d double, y int, blk int")


def margins(df, model):
    return np.array([r["m"] for r in model.transform(df).select("i", F.col("rawPrediction").alias("m")).orderBy("i").collect()])


@pytest.mark.parametrize("name, setting", [("sgd_classifier", {"alpha": 0.001}), ("logistic_regression", {"C": 0.1})])
def test_same_minimum_as_spark_ml_and_folds_of_their_own(spark, name, setting):
    df = frame(spark).repartition(5)
    rows = L.packed(df, NAMES, "y", F.col("blk"))
    jobs = [(upto, T.penalty(name, **setting)) for upto in (2, 4)]
    for model, (upto, _) in zip(L.fit_all(rows, NAMES, jobs, T.KINDS[name]), jobs):
        train = df.where(F.col("blk") < upto)
        train = T.with_weights(train, "y", T.class_weights(train, "y"))
        ml = T.learner(name, NAMES, "y", train.count(), **setting)
        ml.getStages()[-1].getOrDefault("classifier").setTol(1e-12) if name == "sgd_classifier" else ml.getStages()[-1].setTol(1e-12)
        told = ml.fit(train).transform(df).select("i", T.vector_to_array("rawPrediction").alias("m"), "prediction").orderBy("i").collect()
        want, got = np.array([r["m"] for r in told]), margins(df, model)
        if name == "logistic_regression":       # a shift of all classes is no part of the minimum
            want, got = want - want.mean(axis=1, keepdims=True), got - got.mean(axis=1, keepdims=True)
        assert np.abs(got - want).max() < 1e-4
        said = [r["prediction"] for r in model.transform(df).orderBy("i").collect()]
        assert said == [r["prediction"] for r in told]
    rows.unpersist()


def test_partitions_do_not_matter_and_absent_classes_are_never_said(spark):
    df = frame(spark).where("y <> 2")
    found = []
    for n in (1, 7):
        rows = L.packed(df.repartition(n), NAMES, "y")
        assert rows.agg(F.sum("n")).first()[0] == df.count()
        models = [L.fit_all(rows, NAMES, [(1, lambda n: 0.01)], kind)[0] for kind in ("multinomial", "one_vs_rest")]
        counts = L.confusions(rows, models, [0, 0]).collect()
        assert all(r["y_pred"] != 2 for r in counts) and sum(r["n"] for r in counts) == 2 * df.count()
        found.append([m.coefficients for m in models])
        rows.unpersist()
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(*found))


def test_one_class_and_nulls(spark):
    rows = L.packed(frame(spark).where("y = 1"), NAMES, "y")
    for kind in ("multinomial", "one_vs_rest"):
        assert {r["y_pred"] for r in L.confusions(rows, L.fit_all(rows, NAMES, [(1, lambda n: 0.01)], kind), [0]).collect()} == {1}
    rows.unpersist()
    rows = L.packed(frame(spark, 50).withColumn("a", F.when(F.col("i") > 3, F.col("a"))), NAMES, "y")
    with pytest.raises(ValueError):
        L.fit_all(rows, NAMES, [(1, lambda n: 0.01)], "multinomial")
    rows.unpersist()


def test_search_counts_every_row_of_every_fold_in_few_jobs(spark):
    df = frame(spark).repartition(3)
    rows = L.packed(df, NAMES, "y", F.col("blk"))
    spark.sparkContext.setJobGroup("search", "search")
    settings, counts = T.search(rows, "sgd_classifier", NAMES, 3)
    got = counts.groupBy("setting", "fold").agg(F.sum("n").alias("n")).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("search"))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert {(r["setting"], r["fold"]) for r in got} == {(k, i) for k in range(len(settings)) for i in (1, 2, 3)}
    assert {r["n"] for r in got} == {150}
    assert jobs < 60            # 48 fits, each of which ran jobs of its own for every iteration
    rows.unpersist()


def test_folds_of_all_learners_share_passes_and_equal_single_fits(spark, monkeypatch):
    from spendlens.operators.forest import fit_forest
    from spendlens.plans import evaluation as EV
    from spendlens.plans import models as P
    df = frame(spark, 900).withColumn("test_fold", F.when(F.col("blk") > 0, F.col("blk"))).drop("blk").withColumnRenamed("i", "user_id").withColumn(
        "week_start", F.date_add(F.lit("2024-01-01").cast("date"), F.col("user_id").cast("int")))
    want = {}
    for i in (1, 2, 3):
        train, block = df.where(F.coalesce("test_fold", F.lit(0)) < i), df.where(F.col("test_fold") == i)
        weighted = T.with_weights(train, "y", T.class_weights(train, "y"))
        fits = {name: T.learner(name, NAMES, "y", weighted.count()).fit(weighted) for name in ("logistic_regression", "sgd_classifier")}
        fits["random_forest"] = fit_forest(T.sized(train, train.count()), NAMES, "y", n_trees=250, max_depth=12, min_leaf=2)
        for name, m in fits.items():
            want |= {(i, name, r["user_id"]): (r["y"], int(r["prediction"])) for r in m.transform(block).select("user_id", "y", "prediction").collect()}
    # A fit for each fold in Spark ML took hundreds of jobs.
    monkeypatch.setattr(T, "learner", lambda *a, **k: pytest.fail("a fit of its own for a fold"))
    monkeypatch.setattr(EV, "folds_of", lambda *a: df)
    monkeypatch.setattr(EV, "N_SPLITS", 3)
    monkeypatch.setattr(P, "FLOW_FEATURES_31", NAMES)
    monkeypatch.setattr(P, "TARGET", "y")
    rows = P.out_of_fold(spark, "own rows").collect()
    got = {(r["fold"], r["model"], r["user_id"]): (r["y"], r["p"]) for r in rows}
    assert len(rows) == len(got) == 3 * 675 and got.keys() == want.keys()
    apart = [k for k in got if got[k] != want[k]]
    assert all(k[1] != "random_forest" for k in apart) and len(apart) <= 4        # Spark ML stops earlier
