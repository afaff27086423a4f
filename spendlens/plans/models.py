"""Spark ML training, scoring, parity and personalisation on the signed-flow frames.

Model outputs are not reproducible in SQL, so these queries are checked by rows
(and by unit tests); L6 and L14 are plain aggregates and carry an oracle.
"""

from __future__ import annotations

import hashlib
import os
import statistics
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bucketing as B
from ..operators import metrics as M
from ..operators import personalize as P
from ..operators import train as T
from ..operators.categories import collapse_categories, tfidf_clusters
from ..operators.flow_features import FLOW_FEATURES_31, REGRESSION_NUMERIC
from ..operators.forest import fit_forest, forest_confusion, load_forest, save_forest, search_confusions
from ..operators.gram import design, solve
from ..operators.kmeans import kmeans_sql
from ..operators.logistic import confusions, fit_all, packed
from ..session import checkpointed, ensure_checkpoint_dir
from ..sources.tables import table
from . import evaluation as EV
from . import flow_weekly as FW
from . import shared
from .registry import register, rounded

TARGET = "bucket_spend_t_plus_1"
REGRESSION_FOLDS = 3
#: Rows of a fold that the forests of the parameter search learn from.
SEARCH_ROWS = 3_000
# Penalty of each regressor.
REGRESSORS = (("ridge", 1.0), ("elasticnet", 0.001), ("sgd", 0.0005))


def train_test(spark, sf_dir):
    feats, _ = FW.features_31(spark, sf_dir)
    return feats.where("is_test = 0"), feats.where("is_test = 1")


def weights_of(spark, sf_dir):
    return shared.frame(spark, "flow_class_weights", sf_dir, lambda: T.class_weights(train_test(spark, sf_dir)[0], TARGET))


def weighted_train(spark, sf_dir):
    tr, _ = train_test(spark, sf_dir)
    return T.with_weights(tr, TARGET, weights_of(spark, sf_dir))


def fitted(spark, sf_dir, name):
    def build():
        if name == "random_forest":
            return fit_forest(train_test(spark, sf_dir)[0], FLOW_FEATURES_31, TARGET, n_trees=250, max_depth=12, min_leaf=2)
        if name == "sgd_classifier":
            rows = packed(train_test(spark, sf_dir)[0], FLOW_FEATURES_31, TARGET)
            model = fit_all(rows, FLOW_FEATURES_31, [(1, T.penalty(name, alpha=1e-3))], T.KINDS[name])[0]
            rows.unpersist()
            return model
        tr = weighted_train(spark, sf_dir)
        n = tr.count()
        return T.logistic_regression(FLOW_FEATURES_31, TARGET, n, C=1.0).fit(T.sized(tr, n))
    return shared.value(spark, f"model_{name}", sf_dir, build)


KEYS = ["user_id", "week_start", "week_t"]


def scored(spark, sf_dir, name):
    _, te = train_test(spark, sf_dir)
    return T.score_probabilities(fitted(spark, sf_dir, name), te, KEYS + [TARGET, "bucket_spend_t"])


@register("L14_class_weights", EV._FLOW_TEST + """,
c AS (SELECT bucket_spend_t_plus_1, count(*) AS n_c FROM ftr GROUP BY 1)
SELECT bucket_spend_t_plus_1, n_c, round((SELECT count(*) FROM ftr) / ((SELECT count(*) FROM c) * n_c), 6) AS weight FROM c""")
def l14(spark, sf_dir):
    return rounded(weights_of(spark, sf_dir), 6)


@register("L6_scaler_table", EV._FLOW_TEST + "\n" + " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS feature, round(avg({c}), 4) + 0.0 AS mean, round(stddev_pop({c}), 4) + 0.0 AS scale FROM ftr"
    for i, c in enumerate(FLOW_FEATURES_31)))
def l6(spark, sf_dir):
    return rounded(T.scaler_table(train_test(spark, sf_dir)[0], FLOW_FEATURES_31))


def _test_summary(spark, sf_dir, name):
    s = scored(spark, sf_dir, name)
    return M.classification_summary(s, TARGET, "predicted_class").withColumn("model", F.lit(name))


@register("L1_rf_classifier")
def l1(spark, sf_dir):
    return _test_summary(spark, sf_dir, "random_forest")


@register("L2_logistic_regression")
def l2(spark, sf_dir):
    return _test_summary(spark, sf_dir, "logistic_regression")


@register("L3_sgd_classifier")
def l3(spark, sf_dir):
    return _test_summary(spark, sf_dir, "sgd_classifier")


@register("M15_model_comparison")
def m15(spark, sf_dir):
    rf = _test_summary(spark, sf_dir, "random_forest").select(F.col("f1_macro").alias("rf"))
    lr = _test_summary(spark, sf_dir, "logistic_regression").select(F.col("f1_macro").alias("lr")).first()["lr"]
    margin = F.col("rf") - F.lit(lr)
    winner = (F.when(margin > 0.05, "random_forest_clear_winner").when(margin >= 0.02, "random_forest_better")
              .when(margin >= 0, "comparable_prefer_simpler").otherwise("logistic_regression_better"))
    return rf.select("rf", F.lit(lr).alias("lr"), margin.alias("margin"), winner.alias("winner"))


@register("L10_score_probabilities")
def l10(spark, sf_dir):
    return scored(spark, sf_dir, "random_forest")


@register("M19_probability_sum_check")
def m19(spark, sf_dir):
    return T.probability_sum_check(scored(spark, sf_dir, "random_forest"))


@register("M17_prediction_parity")
def m17(spark, sf_dir):
    return T.prediction_parity(scored(spark, sf_dir, "random_forest"), scored(spark, sf_dir, "logistic_regression"),
                               ["user_id", "week_start"])


@register("M18_normalize_votes")
def m18(spark, sf_dir):
    s = scored(spark, sf_dir, "random_forest")
    votes = F.map_from_arrays(F.array(*[F.lit(i) for i in range(5)]),
                              F.array(*[F.col(f"proba_class_{i}") * 250 for i in range(4)], F.lit(0.0)))
    return s.select("user_id", "week_start", T.normalize_votes(votes).alias("normalized"))


@register("M20_golden_sample")
def m20(spark, sf_dir):
    _, te = train_test(spark, sf_dir)
    gold = T.cap_rows(te, 10, ["user_id", "week_start"])
    return T.score_probabilities(fitted(spark, sf_dir, "random_forest"), gold, KEYS + [TARGET] + FLOW_FEATURES_31)


@register("M21_golden_replay")
def m21(spark, sf_dir):
    """S10 round trip: save the forest to the shared checkpoint folder, load it, re-score the golden rows."""
    model = fitted(spark, sf_dir, "random_forest")
    path = os.path.join(ensure_checkpoint_dir(spark), "models", "random_forest_" + hashlib.sha1(sf_dir.encode()).hexdigest()[:12])
    save_forest(spark, model, path)
    again = load_forest(spark, path)
    _, te = train_test(spark, sf_dir)
    gold = T.cap_rows(te, 10, ["user_id", "week_start"])
    a = T.score_probabilities(model, gold, ["user_id", "week_start"])
    b = T.score_probabilities(again, gold, ["user_id", "week_start"]).select(
        "user_id", "week_start", F.col("predicted_class").alias("replayed"))
    j = a.join(b, ["user_id", "week_start"])
    return j.agg(F.count(F.lit(1)).alias("rows"),
                 F.avg((F.col("predicted_class") == F.col("replayed")).cast("double")).alias("match_rate"))


@register("M28_feature_importance")
def m28(spark, sf_dir):
    return T.feature_importance(fitted(spark, sf_dir, "random_forest"), spark)


@register("M28_coefficients")
def m28c(spark, sf_dir):
    return T.coefficients(fitted(spark, sf_dir, "logistic_regression"), FLOW_FEATURES_31, spark)


@register("L7_cv_expanding")
def l7(spark, sf_dir):
    fx = EV.folds_of(spark, sf_dir)

    def make(tr):
        return T.logistic_regression(FLOW_FEATURES_31, TARGET, tr.count(), C=1.0)

    def evaluate(pred):
        return M.classification_summary(pred.withColumn("p", F.col("prediction").cast("int")), TARGET, "p")

    parts = [df.withColumn("fold", F.lit(i)) for i, df in T.cv_expanding(fx, make, TARGET, EV.N_SPLITS, evaluate)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def out_of_fold(spark, sf_dir):
    """``(fold, model, user_id, week_start, y, p)``: each learner's predictions on the block after the rows it was fitted on.

    Kept once, a row for the predictions of all learners; period, metrics, confusion and classes of all folds are read from it.
    """
    said = shared.frame(spark, "out_of_fold", sf_dir, lambda: T.out_of_fold(
        EV.folds_of(spark, sf_dir), FLOW_FEATURES_31, TARGET, EV.N_SPLITS, ["user_id", "week_start"], n_trees=250, max_depth=12, min_leaf=2))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("model"), F.col(name).alias("p")) for name in T.LEARNERS]))
    return said.select("fold", "user_id", "week_start", "y", each.alias("_m")).select("fold", "_m.model", "user_id", "week_start", "y", "_m.p")


@register("M11_model_folds")
def m11m(spark, sf_dir):
    """Period and metrics of every learner on every fold."""
    return M.fold_summary(out_of_fold(spark, sf_dir))


@register("M11_model_confusion")
def m11mc(spark, sf_dir):
    return M.confusion(out_of_fold(spark, sf_dir), by=["fold", "model"])


@register("M11_model_classes")
def m11mk(spark, sf_dir):
    return M.per_class_prf(out_of_fold(spark, sf_dir), by=["fold", "model"])


@register("L7_fold_class_weights", EV._FLOW_TEST + f""",
ix AS (SELECT *, row_number() OVER (ORDER BY week_start, user_id) - 1 AS i, count(*) OVER () AS n FROM ftr),
fo AS (SELECT f.fold, ix.bucket_spend_t_plus_1, count(*) AS n_c FROM ix, range(1, {EV.N_SPLITS} + 1) AS f(fold)
       WHERE i < n - ({EV.N_SPLITS} - f.fold + 1) * (n // ({EV.N_SPLITS} + 1)) GROUP BY ALL)
SELECT CAST(fold AS INT) AS fold, bucket_spend_t_plus_1, n_c,
       round(sum(n_c) OVER (PARTITION BY fold) / (count(*) OVER (PARTITION BY fold) * n_c), 6) AS weight FROM fo""")
def l7w(spark, sf_dir):
    """Class weights of every expanding fold, from the rows it trains on."""
    fx = EV.fold_labels(spark, sf_dir)
    out = None
    for i in range(1, EV.N_SPLITS + 1):
        train, _ = T.expanding_fold(fx, i, EV.N_SPLITS, TARGET)
        w = T.class_weights(train, TARGET).withColumn("fold", F.lit(i))
        out = w if out is None else out.unionByName(w)
    return rounded(out, 6)


def _searched(spark, sf_dir, name):
    """Every setting's folds, and the refitted best on the test rows."""
    last = EV.N_SPLITS + 1
    train, (_, te) = EV.folds_of(spark, sf_dir), train_test(spark, sf_dir)
    block = F.coalesce("test_fold", F.lit(0))
    rows = packed(train.select(*FLOW_FEATURES_31, TARGET, block.alias("_b")).unionByName(te.select(*FLOW_FEATURES_31, TARGET, F.lit(last).alias("_b"))),
                  FLOW_FEATURES_31, TARGET, F.col("_b"))
    settings, counts = T.search(rows, name, FLOW_FEATURES_31, EV.N_SPLITS)
    found = [[0.0] * EV.N_SPLITS for _ in settings]
    for r in M.summary_of_counts(counts, ["setting", "fold"]).collect():
        found[r["setting"]][r["fold"] - 1] = r["f1_macro"] or 0.0
    best = max(range(len(settings)), key=lambda k: statistics.mean(found[k]))
    again = fit_all(rows, FLOW_FEATURES_31, [(last, T.penalty(name, **settings[best]))], T.KINDS[name])
    test = M.summary_of_counts(confusions(rows, again, [last]), []).first()["f1_macro"] or 0.0
    rows.unpersist()
    out = [(name, str(s), [float(v) for v in f], statistics.mean(f), statistics.pstdev(f), k == best, test if k == best else None)
           for k, (s, f) in enumerate(zip(settings, found))]
    return spark.createDataFrame(out, "model string, setting string, fold_f1_macro array<double>, mean_f1_macro double, "
                                      "std_f1_macro double, best boolean, test_f1_macro double")


@register("L8_random_search")
def l8(spark, sf_dir):
    """Full logistic grid; the best setting is refitted and scored on the test rows."""
    return _searched(spark, sf_dir, "logistic_regression")


@register("L8_sgd_search")
def l8s(spark, sf_dir):
    return _searched(spark, sf_dir, "sgd_classifier")


@register("L8_forest_search")
def l8f(spark, sf_dir):
    """Fifty sampled forest settings on five expanding folds; the best is refitted on all rows and scored on the test rows.

    A fold's forests learn from a hashed sample of at most ``SEARCH_ROWS`` of its train rows and are scored on its whole block.
    """
    fx = EV.folds_of(spark, sf_dir)
    folds = [(fx.where(F.coalesce("test_fold", F.lit(0)) < i), fx.where(F.col("test_fold") == i)) for i in range(1, EV.N_SPLITS + 1)]
    settings = T.sampled_settings(T.SEARCH["random_forest"], T.RF_SETTINGS, 42)
    counts = search_confusions(fx, folds, FLOW_FEATURES_31, TARGET, settings, rows_per_group=SEARCH_ROWS)
    per = M.summary_of_counts(counts, ["setting", "fold"]).groupBy("setting").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("fold", "f1_macro"))), lambda r: r["f1_macro"]).alias("fold_f1_macro"),
        F.avg("f1_macro").alias("mean_f1_macro"), F.stddev_pop("f1_macro").alias("std_f1_macro"))
    names = spark.createDataFrame([(k, *[str(s[c]) for c in s]) for k, s in enumerate(settings)],
                                  "setting int, " + ", ".join(f"{c} string" for c in settings[0]))
    rows = checkpointed(per.join(F.broadcast(names), "setting"))        # fifty rows
    best = rows.orderBy(F.desc("mean_f1_macro"), "setting").first()["setting"]
    tr, te = train_test(spark, sf_dir)
    test = M.summary_of_counts(forest_confusion(tr, te, FLOW_FEATURES_31, TARGET, **settings[best]), []).first()["f1_macro"]
    return rows.withColumns({"best": F.col("setting") == best, "test_f1_macro": F.when(F.col("setting") == best, F.lit(test))})


CATEGORICAL, AMOUNT = ["category", "flow_direction"], "amount_cat_t_plus_1"


def _linear_errors(df, models: dict, by: list[str]):
    """Errors of several linear models, each a column expression, over one scan of ``df``."""
    said = F.explode(F.array(*[F.struct(F.lit(k).alias("model"), m.prediction().alias("said")) for k, m in models.items()]))
    rows = df.select(*by, AMOUNT, said.alias("_m")).select(*by, AMOUNT, "_m.model", "_m.said")
    return M.regression_metrics(rows, AMOUNT, "said", by=[*by, "model"])


@register("L4_regressors")
def l4(spark, sf_dir):
    """Test errors of the three regressors, solved on one matrix of sums of the train rows."""
    reg, _ = FW.regression_rows(spark, sf_dir)
    d = design(reg.where("is_test = 0"), REGRESSION_NUMERIC, CATEGORICAL, AMOUNT)
    return _linear_errors(reg.where("is_test = 1"), {k: solve(d, d.upto(1), k, a) for k, a in REGRESSORS}, [])


@register("L4_fold_mae")
def l4f(spark, sf_dir):
    """Regression folds: MAE of each regressor on three expanding blocks, and mean and spread.

    One pass makes the matrices of all blocks, which add up to those of the folds; one more scores all models.
    """
    reg, _ = FW.regression_rows(spark, sf_dir)
    fx = B.expanding_folds(reg.where("is_test = 0"), ["week_start", "user_id", "category"], REGRESSION_FOLDS, index=False)
    d = design(fx, REGRESSION_NUMERIC, CATEGORICAL, AMOUNT, F.coalesce("test_fold", F.lit(0)))
    per = None
    for i in range(1, REGRESSION_FOLDS + 1):
        models = {k: solve(d, d.upto(i), k, a) for k, a in REGRESSORS}
        one = _linear_errors(fx.where(F.col("test_fold") == i), models, []).withColumn("fold", F.lit(i))
        per = one if per is None else per.unionByName(one)
    return per.groupBy("model").agg(F.sort_array(F.collect_list(F.struct("fold", "mae"))).alias("folds"), F.avg("mae").alias("cv_mae"),
                                    F.stddev_pop("mae").alias("cv_mae_std"))


def personalized(spark, sf_dir):
    def build():
        feats, _ = FW.features_31(spark, sf_dir)
        s = T.score_probabilities(fitted(spark, sf_dir, "random_forest"), feats,
                                  ["user_id", "week_start", "week_t", "is_test", TARGET])
        return P.personalize(s, TARGET)
    return shared.frame(spark, "personalized", sf_dir, build)


@register("L13_personalize")
def l13(spark, sf_dir):
    return personalized(spark, sf_dir)


@register("M22_per_user_delta")
def m22(spark, sf_dir):
    pu = M.per_user_f1(personalized(spark, sf_dir), "user_id", "y_true", ["y_pred_base", "y_pred_cal", "y_pred_blend"])
    return M.per_user_delta_summary(pu, "f1_y_pred_base", "f1_y_pred_cal")


@register("M3_personalization_summary")
def m3p(spark, sf_dir):
    ev = personalized(spark, sf_dir)
    parts = [M.classification_summary(ev, "y_true", p).withColumn("predictor", F.lit(p))
             for p in ("y_pred_base", "y_pred_cal", "y_pred_blend")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("M23_time_to_benefit")
def m23(spark, sf_dir):
    return P.time_to_benefit(personalized(spark, sf_dir))


@register("M25_confidence_curve")
def m25(spark, sf_dir):
    return M.confidence_curve(personalized(spark, sf_dir), "y_true", "y_pred_blend", "confidence")


@register("M26_small_history_slice")
def m26(spark, sf_dir):
    ev = personalized(spark, sf_dir).where((F.col("user_total_history") >= 12) & (F.col("user_total_history") <= 20))
    return M.classification_summary(ev, "y_true", "y_pred_blend")


@register("M27_pick_users")
def m27(spark, sf_dir):
    from .reports import picked_users
    return picked_users(personalized(spark, sf_dir))


_TFIDF_SQL = """
WITH lab AS (SELECT p_name, count(*) AS rows FROM part WHERE p_name IS NOT NULL GROUP BY 1),
word AS (SELECT p_name, rows, ' ' || w || ' ' AS w
         FROM (SELECT p_name, rows, unnest(string_split_regex(lower(p_name), '\\s+')) AS w FROM lab) WHERE w <> ''),
gram AS (SELECT p_name, rows, substr(w, i, n) AS term
         FROM word, unnest([3, 4, 5]) AS a(n), unnest(range(1, length(w) - n + 2)) AS b(i)),
tf AS (SELECT p_name, rows, term, count(*) AS tf FROM gram GROUP BY ALL),
df AS (SELECT term, sum(rows) AS df FROM tf GROUP BY 1 HAVING sum(rows) >= 2),
x AS (SELECT p_name, term, tf * (ln((1.0 + (SELECT sum(rows) FROM lab))::DOUBLE / (1.0 + df)::DOUBLE) + 1) AS x FROM tf JOIN df USING (term))"""
N_CLUSTERS, KMEANS_STEPS = 15, 20
#: At the driver's scales ``part`` has more distinct names than clusters, which fixes the number of clusters here.
_KMEANS_SQL = _TFIDF_SQL + """,
v AS MATERIALIZED (SELECT p_name AS label, term, x / sqrt(sum(x * x) OVER (PARTITION BY p_name)) AS weight FROM x),
l AS (SELECT p_name AS label, rows FROM lab),
""" + kmeans_sql(N_CLUSTERS, iterations=KMEANS_STEPS)


@register("P10_tfidf_weights", _TFIDF_SQL + """
SELECT p_name, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY p_name)), 6) AS weight FROM x""")
def p10w(spark, sf_dir):
    from ..operators.categories import tfidf_weights
    return rounded(tfidf_weights(table(spark, sf_dir, "part", ["p_name"]), "p_name"), 6)


def part_clusters(spark, sf_dir):
    return shared.frame(spark, "part_clusters", sf_dir, lambda: tfidf_clusters(
        table(spark, sf_dir, "part", ["p_name"]), N_CLUSTERS, "p_name", iterations=KMEANS_STEPS))


@register("P10_collapse_tfidf", _KMEANS_SQL + """
SELECT p_partkey, p_name, printf('cluster_%02d', cluster) AS category FROM part LEFT JOIN km ON km.label = part.p_name""")
def p10(spark, sf_dir):
    part = table(spark, sf_dir, "part", ["p_partkey", "p_name"])
    return collapse_categories(part, "tfidf", n_clusters=N_CLUSTERS, src="p_name").select("p_partkey", "p_name", "category")


@register("P10_cluster_profile", _KMEANS_SQL + """
SELECT cluster, count(*) AS n_labels, sum(rows)::BIGINT AS n_rows, round(sum(rows * d), 4) + 0.0 AS inertia, any_value(try)::INT AS best_try,
       round(any_value(cost), 4) AS cost, min(label) AS first_label FROM km GROUP BY cluster""")
def p10c(spark, sf_dir):
    """Sizes and inertia of the clusters of the best try."""
    return rounded(part_clusters(spark, sf_dir).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n_labels"), F.sum("rows").alias("n_rows"), F.sum(F.col("rows") * F.col("d")).alias("inertia"),
        F.first("try").alias("best_try"), F.first("cost").alias("cost"), F.min("label").alias("first_label")))


@register("K6_top_improved_users")
def k6(spark, sf_dir):
    """K6: ten most improved and ten most worsened users (calibrated vs base), user tie-break."""
    pu = M.per_user_f1(personalized(spark, sf_dir), "user_id", "y_true", ["y_pred_base", "y_pred_cal"])
    d = pu.withColumn("delta", F.col("f1_y_pred_cal") - F.col("f1_y_pred_base"))
    up = d.orderBy(F.desc("delta"), "user_id").limit(10).withColumn("side", F.lit("improved"))
    down = d.orderBy(F.asc("delta"), "user_id").limit(10).withColumn("side", F.lit("worsened"))
    return up.unionByName(down)


@register("Q16_feasibility_verdict")
def q16(spark, sf_dir):
    """Q16: classification gain of the best model over persistence (>= .03 GO, >= .01 BORDERLINE)
    and regression relative MAE gain over persistence (>= .05 GO, >= .01 BORDERLINE)."""
    models = reduce(DataFrame.unionByName, [_test_summary(spark, sf_dir, n) for n in ("random_forest", "logistic_regression", "sgd_classifier")])
    base = M.classification_summary(train_test(spark, sf_dir)[1], TARGET, "bucket_spend_t")
    r, _ = FW.regression_rows(spark, sf_dir)
    naive = M.regression_metrics(r.where("is_test = 1"), AMOUNT, "amount_cat_t")
    return M.feasibility_verdict(models, base, l4(spark, sf_dir), naive)


@register("Q14_intensity_verdict")
def q14(spark, sf_dir):
    """Q14 on the daily model frame (L15): class separation, RF weighted-F1 lift over the
    majority class, best per-category Spearman; GO with two of three."""
    from ..operators import stats as S
    from . import intensity as I
    mf = I.model_frame(spark, sf_dir)
    tr, te = mf.where("is_test = 0"), mf.where("is_test = 1")
    model = fit_forest(tr, I.MODEL_FEATURES, "bucket", n_trees=120, max_depth=14)
    pred = model.transform(te).withColumn("p", F.col("prediction").cast("int"))
    majority = te.crossJoin(F.broadcast(M.majority_class(tr, "bucket").select(F.col("bucket").alias("p"))))
    g, _ = I.bucketed(spark, sf_dir)
    ranks = S.spearman(I.transitions(spark, sf_dir).where(F.col("category").isin(*I.FOCUS)), "bucket", "bucket_t_plus_7", by="category")
    return M.intensity_verdict(I.B.class_distribution(g, "bucket", "target_7d_sum"), M.classification_summary(pred, "bucket", "p"),
                               M.classification_summary(majority, "bucket", "p"), ranks)
