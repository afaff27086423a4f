"""Spark ML training and scoring.

Linear estimators are Spark ML's distributed learners, forests are in ``forest.py``; the linear parameter
search and the log-loss classifier fit all folds, settings and classes in shared passes (``logistic.py``).  Penalties
are rescaled so the objectives match the reference's definitions:

* logistic regression with C and balanced weights: ``regParam = 1 / (C * n)``
* log-loss SGD with alpha: one-vs-rest logistic regression, ``regParam = alpha``
* ridge alpha: ``regParam = alpha * std(y) / n`` (Spark divides the L2 part by std(y))
* elastic net (a, r): ``lambda = a*r + std(y)*a*(1-r)``, ``elasticNetParam = a*r / lambda``
"""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import count_if
from .forest import Forest, fit_forest
from .logistic import confusions, fit_all, packed


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_c) per class (one row per class)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    tot = df.count()
    k = c.count()
    return c.withColumn("weight", F.lit(float(tot)) / (F.lit(float(k)) * F.col("n_c")))


def with_weights(df: DataFrame, label: str, weights: DataFrame, out: str = "w") -> DataFrame:
    """Attach class weights; the weight table has one row per class, so it is broadcast."""
    return df.join(F.broadcast(weights.select(label, F.col("weight").alias(out))), label, "left")


def sized(df: DataFrame, n_rows: int, rows_per_partition: int = 20_000) -> DataFrame:
    """``df`` in as many partitions as its rows need: a fit runs a job per iteration, whose tasks should hold some rows each."""
    return df.coalesce(max(1, -(-n_rows // rows_per_partition)))


def population_scaler(source: str, out: str, width: int, n_rows: int) -> list:
    """Standardisation by mean and population deviation (Spark's scaler divides by the sample one)."""
    factor = (max(n_rows, 2) / (max(n_rows, 2) - 1.0)) ** 0.5
    return [StandardScaler(inputCol=source, outputCol=f"{source}_std", withMean=True, withStd=True),
            ElementwiseProduct(inputCol=f"{source}_std", outputCol=out, scalingVec=Vectors.dense([factor] * width))]


def logistic_regression(features: list[str], label: str, n_rows: int, C: float = 1.0,
                        weight: str | None = "w", max_iter: int = 1200) -> Pipeline:
    """L2: standardised multinomial logistic regression with L2 penalty from C."""
    lr = LogisticRegression(featuresCol="scaled", labelCol=label, family="multinomial",
                            regParam=1.0 / (C * max(n_rows, 1)), elasticNetParam=0.0, maxIter=max_iter,
                            standardization=False)
    if weight:
        lr.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"),
                            *population_scaler("features", "scaled", len(features), n_rows), lr])


def sgd_log_loss(features: list[str], label: str, n_rows: int, alpha: float = 1e-3, weight: str | None = "w",
                 max_iter: int = 1500) -> Pipeline:
    """L3: the log-loss objective with L2 alpha, one-vs-rest (the step schedule is not reproduced)."""
    base = LogisticRegression(featuresCol="scaled", labelCol=label, regParam=alpha, elasticNetParam=0.0,
                              maxIter=max_iter, standardization=False)
    ovr = OneVsRest(classifier=base, featuresCol="scaled", labelCol=label)
    if weight:
        ovr.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"),
                            *population_scaler("features", "scaled", len(features), n_rows), ovr])


def preprocessor(numeric: list[str], categorical: list[str], n_rows: int) -> list:
    """Numeric columns scaled, categoricals one-hot (unknown -> the extra 'keep' slot)."""
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep") for c in categorical]
    ohe = OneHotEncoder(inputCols=[f"{c}_idx" for c in categorical], outputCols=[f"{c}_ohe" for c in categorical],
                        handleInvalid="keep")
    num = VectorAssembler(inputCols=numeric, outputCol="num_vec", handleInvalid="keep")
    sc = population_scaler("num_vec", "num_scaled", len(numeric), n_rows)
    allv = VectorAssembler(inputCols=["num_scaled"] + [f"{c}_ohe" for c in categorical], outputCol="features")
    return idx + [ohe, num, *sc, allv]


def linear_regressor(numeric: list[str], categorical: list[str], label: str, kind: str, n_rows: int,
                     y_std: float, alpha: float = 1.0, l1_ratio: float = 0.2) -> Pipeline:
    """L4: ridge, elastic net or SGD-like squared loss with rescaled penalties."""
    if kind == "ridge":
        reg, en = alpha * y_std / max(n_rows, 1), 0.0
    elif kind == "elasticnet":
        lam = alpha * l1_ratio + y_std * alpha * (1 - l1_ratio)
        reg, en = lam, (alpha * l1_ratio / lam if lam else 0.0)
    else:
        reg, en = alpha * y_std, 0.0
    lr = LinearRegression(featuresCol="features", labelCol=label, regParam=reg, elasticNetParam=en,
                          standardization=False, maxIter=5000)
    return Pipeline(stages=preprocessor(numeric, categorical, n_rows) + [lr])


def scaler_table(df: DataFrame, features: list[str]) -> DataFrame:
    """Mean and population std per feature (the reference's scaler), one pass."""
    one = df.agg(*[F.avg(c).alias(f"{c}__m") for c in features], *[F.stddev_pop(c).alias(f"{c}__s") for c in features])
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.col(f"{c}__m").alias("mean"),
                              F.col(f"{c}__s").alias("scale")) for i, c in enumerate(features)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def score_probabilities(model: PipelineModel, df: DataFrame, keep: list[str], n_classes: int = 4) -> DataFrame:
    """Class probabilities as columns and the argmax class."""
    out = model.transform(df)
    if "probability" in out.columns:
        arr = F.col("probability") if dict(out.dtypes)["probability"].startswith("array") else vector_to_array("probability")
    else:  # one-vs-rest has no probability column: normalised raw margins via softmax
        raw = F.col("rawPrediction") if dict(out.dtypes)["rawPrediction"].startswith("array") else vector_to_array("rawPrediction")
        mx = F.array_max(raw)
        ex = F.transform(raw, lambda v: F.exp(v - mx))
        arr = F.transform(ex, lambda v: v / F.aggregate(ex, F.lit(0.0), lambda a, b: a + b))
    out = out.withColumn("_p", arr)
    probs = [F.coalesce(F.col("_p")[i], F.lit(0.0)).alias(f"proba_class_{i}") for i in range(n_classes)]
    return out.select(*keep, *probs, F.col("prediction").cast("int").alias("predicted_class"))


def feature_importance(model: Forest, spark) -> DataFrame:
    """Random-forest importances, largest first."""
    rows = sorted(zip(model.features, model.importances), key=lambda t: (-t[1], t[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


def coefficients(model: PipelineModel, features: list[str], spark) -> DataFrame:
    """Logistic coefficients per class and feature, ordered by absolute value."""
    lr = model.stages[-1]
    m = lr.coefficientMatrix.toArray()
    rows = [(int(k), f, float(m[k][j]), abs(float(m[k][j]))) for k in range(m.shape[0]) for j, f in enumerate(features)]
    return spark.createDataFrame(rows, "class int, feature string, coefficient double, abs_coefficient double").orderBy(
        F.desc("abs_coefficient"), "class", "feature")


def expanding_fold(frame: DataFrame, i: int, n_splits: int, label: str, weight: str = "w") -> tuple[DataFrame, DataFrame]:
    """Train rows before test block ``i`` with class weights of their own, and the block."""
    train = frame.where(F.coalesce("test_fold", F.lit(0)) < i)
    return with_weights(train, label, class_weights(train, label), weight), frame.where(F.col("test_fold") == i)


def cv_expanding(frame: DataFrame, make, label: str, n_splits: int, evaluate) -> list[tuple[int, DataFrame]]:
    """Fit on rows before each test block, score the block (frame holds test_fold).

    Class weights come from the rows a fold trains on, so nothing later leaks into a fit.
    """
    out = []
    for i in range(1, n_splits + 1):
        train, test = expanding_fold(frame, i, n_splits, label)
        train = sized(train, train.count())
        out.append((i, evaluate(make(train).fit(train).transform(test))))
    return out


#: Learners whose out-of-fold predictions are kept.
LEARNERS = ("random_forest", "logistic_regression", "sgd_classifier")


def out_of_fold(frame: DataFrame, features: list[str], label: str, n_splits: int, keep: list[str], **forest) -> DataFrame:
    """``(fold, keep..., y, <learner>...)``: the class that each learner says of a block's rows, fitted on all rows before the block.

    ``frame`` holds test_fold.  The linear fits of all folds share their passes; the forests of the folds, the longest first,
    are distributed jobs of their own.
    """
    folds = range(1, n_splits + 1)
    rows = packed(frame, features, label, F.coalesce("test_fold", F.lit(0)))
    models = {name: dict(zip(folds, fit_all(rows, features, [(i, penalty(name)) for i in folds], KINDS[name]))) for name in LEARNERS if name in KINDS}
    rows.unpersist()

    def grown(i: int) -> Forest:
        train = frame.where(F.coalesce("test_fold", F.lit(0)) < i)
        return fit_forest(sized(train, train.count()), features, label, **forest)

    with ThreadPoolExecutor(max_workers=4) as pool:
        models["random_forest"] = dict(zip(reversed(folds), pool.map(grown, reversed(folds))))
    parts = []
    for i in folds:
        out = frame.where(F.col("test_fold") == i).withColumns({"fold": F.lit(i), "y": F.col(label).cast("int")})
        for name in LEARNERS:
            out = models[name][i].transform(out).withColumn(name, F.col("prediction").cast("int"))
        parts.append(out.select("fold", *keep, "y", *LEARNERS))
    return reduce(DataFrame.unionByName, parts)


# The settings searched per learner (solver, step size and iteration variants that
# leave a converged optimum unchanged are not repeated).
SEARCH = {
    "logistic_regression": [{"C": c} for c in (0.001, 0.01, 0.1, 1.0, 10.0, 100.0)],
    "sgd_classifier": [{"alpha": a} for a in (0.0001, 0.001, 0.01, 0.1)],
    "random_forest": [{"n_trees": t, "max_depth": d, "min_split": s, "min_leaf": m, "max_features": f}
                      for t in (100, 150, 200) for d in (12, 18, 24) for s in (5, 10, 15) for m in (2, 4, 6) for f in ("sqrt", "log2")],
}
RF_SETTINGS = 50


def learner(name: str, features: list[str], label: str, n_rows: int, **setting) -> Pipeline:
    if name == "logistic_regression":
        return logistic_regression(features, label, n_rows, **setting)
    return sgd_log_loss(features, label, n_rows, **setting)


def penalty(name: str, C: float = 1.0, alpha: float = 1e-3):
    """Penalty of a linear learner by its number of rows, as in ``logistic_regression`` and ``sgd_log_loss``."""
    return (lambda n: 1.0 / (C * max(n, 1))) if name == "logistic_regression" else (lambda n: alpha)


#: How the linear learners see the classes.
KINDS = {"logistic_regression": "multinomial", "sgd_classifier": "one_vs_rest"}


def search(rows: DataFrame, name: str, features: list[str], n_splits: int, seed: int = 42,
           settings: list[dict] | None = None) -> tuple[list[dict], DataFrame]:
    """The settings, and ``(setting, fold, y_true, y_pred, n)`` of each on every expanding fold (forests: ``forest.search_confusions``).

    ``rows`` are ``logistic.packed`` by test block; every setting learns from all rows before a block, with class weights and
    scaling of their own, and all fits of all folds share their passes.  The caller refits the setting with the best mean.
    """
    settings = sampled_settings(settings or SEARCH[name], RF_SETTINGS, seed)
    jobs = [(k, i) for k in range(len(settings)) for i in range(1, n_splits + 1)]
    models = fit_all(rows, features, [(i, penalty(name, **settings[k])) for k, i in jobs], KINDS[name])
    counts = confusions(rows, models, [i for _, i in jobs])
    of = F.array(*[F.struct(F.lit(k).alias("setting"), F.lit(i).alias("fold")) for k, i in jobs])
    return settings, counts.select(of[F.col("model")].alias("_j"), "y_true", "y_pred", "n").select("_j.*", "y_true", "y_pred", "n")


def sampled_settings(grid: list[dict], n_iter: int, seed: int) -> list[dict]:
    """Seeded sample of the grid, all of it when smaller."""
    return random.Random(seed).sample(list(grid), n_iter) if n_iter < len(grid) else list(grid)


def hash_order(key: list[str], seed: int = 42) -> F.Column:
    """md5 of the row key and a seed: an order that looks random and that any engine repeats."""
    return F.md5(F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key], F.lit(str(seed))).cast("binary"))


def cap_rows(df: DataFrame, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """Sample of n rows, the first by ``hash_order`` (same rows on every run and engine)."""
    return df.orderBy(hash_order(key, seed), *key).limit(n)


def replay(stored: DataFrame, again: DataFrame, key: list[str], n_classes: int = 4, tol: float = 1e-9) -> DataFrame:
    """Stored predictions against new ones by row key: rows, rows missing on either side, equal classes, equal probabilities."""
    a = stored.select(*key, F.array(*[f"proba_class_{i}" for i in range(n_classes)]).alias("_pa"), F.col("predicted_class").alias("_a"))
    b = again.select(*key, F.array(*[f"proba_class_{i}" for i in range(n_classes)]).alias("_pb"), F.col("predicted_class").alias("_b"))
    j = a.join(b, key, "full_outer")
    apart = F.aggregate(F.zip_with("_pa", "_pb", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: F.greatest(s, v))
    return j.agg(count_if(F.col("_a").isNotNull()).alias("rows"), count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("unmatched"),
                 F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("match_rate"), count_if(apart > tol).alias("changed_probabilities"))


def save_model(model: PipelineModel, path: str) -> None:
    """Persist a fitted pipeline (a forest: ``forest.save_forest``)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def prediction_parity(a: DataFrame, b: DataFrame, key: list[str], n_classes: int = 4, votes: float = 1.0) -> DataFrame:
    """Agreement of two scored sets joined on the row key, and whether the second may stand in.

    ``b`` may hold raw votes that sum to ``votes``; its argmax, cosine and rank order are taken
    after division by the row's sum.  Kept: sums near 1 or ``votes``, at least 90 % equal classes
    after normalisation, and a mean cosine of 0.95 or nine rows in the same rank order.
    """
    idx = range(n_classes)
    sa = a.select(*key, F.array(*[F.col(f"proba_class_{i}") for i in idx]).alias("_pa"), F.col("predicted_class").alias("ca"))
    sb = b.select(*key, F.array(*[F.col(f"proba_class_{i}") for i in idx]).alias("_raw"), F.col("predicted_class").alias("cb"))

    def total(arr):
        return F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)

    def order(arr):
        cells = F.transform(arr, lambda v, i: F.struct((-v).alias("v"), i.alias("i")))
        return F.transform(F.array_sort(cells), lambda s: s["i"])

    j = sa.join(sb, key, "inner").withColumn("_sum", total(F.col("_raw")))
    j = j.withColumn("_pb", F.transform("_raw", lambda v: F.try_divide(v, F.col("_sum"))))
    j = j.withColumns({"_oa": order(F.col("_pa")), "_ob": order(F.col("_pb"))})
    norm = F.sqrt(total(F.transform("_pa", lambda x: x * x))) * F.sqrt(total(F.transform("_pb", lambda x: x * x)))
    cos = F.try_divide(total(F.zip_with("_pa", "_pb", lambda x, y: x * y)), norm)
    same = F.col("_oa") == F.col("_ob")
    out = j.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg((F.col("ca") == F.col("cb")).cast("double")).alias("class_match_rate"),
        F.avg((F.col("_ob")[0] == F.col("ca")).cast("double")).alias("argmax_norm_match_rate"),
        F.avg(cos).alias("mean_cosine"),
        count_if(same).alias("rank_order_match_count"), F.avg(same.cast("double")).alias("rank_order_agreement"),
        F.min("_sum").alias("prob_sum_min"), F.avg("_sum").alias("prob_sum_mean"), F.max("_sum").alias("prob_sum_max"),
        F.min_by(F.struct(*key), F.when(F.col("ca") != F.col("cb"), F.struct(*key))).alias("first_mismatch"),
    )
    mean = F.col("prob_sum_mean")
    sum_ok = F.least(F.abs(mean - 1.0) / F.greatest(mean, F.lit(1.0)),
                     F.abs(mean - votes) / F.greatest(mean, F.lit(float(votes)))) <= 0.01
    keep = sum_ok & (F.col("argmax_norm_match_rate") >= 0.9) & ((F.col("mean_cosine") >= 0.95) | (F.col("rank_order_match_count") >= 9))
    cause = (F.when(keep, "normalized_votes").when(~sum_ok, "raw_votes_not_normalized")
             .when(F.col("argmax_norm_match_rate") <= 0.6, "low_parity").otherwise("borderline_parity"))
    return out.withColumn("decision", F.when(keep, "KEEP").otherwise("ABANDON")).withColumn("root_cause", cause)


def probability_sum_check(scored: DataFrame, n_classes: int = 4, tol: float = 0.05) -> DataFrame:
    """Rows whose class probabilities do not sum to 1 within tol, or hold NaN."""
    s = None
    nan = None
    for i in range(n_classes):
        c = F.col(f"proba_class_{i}")
        s = c if s is None else s + c
        nan = F.isnan(c) if nan is None else (nan | F.isnan(c))
    return scored.agg(F.count(F.lit(1)).alias("rows"), count_if((F.abs(s - 1.0) > tol) | nan).alias("bad_rows"),
                      F.min(s).alias("sum_min"), F.max(s).alias("sum_max"))


def normalize_votes(votes_map) -> "F.Column":
    """Keep classes 0-3 of an int -> votes map and divide by their sum."""
    kept = F.map_filter(votes_map, lambda k, v: k.isin(0, 1, 2, 3))
    tot = F.aggregate(F.map_values(kept), F.lit(0.0), lambda s, v: s + v.cast("double"))
    return F.transform_values(kept, lambda k, v: F.try_divide(v.cast("double"), tot))
