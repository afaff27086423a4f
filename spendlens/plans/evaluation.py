"""Evaluation tables with deterministic predictors (labels, persistence, majority,
rolling mean), expanding folds, stability and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import count_if
from ..operators import bucketing as B
from ..operators import metrics as M
from ..sources.tables import label_pairs, oracle_with
from . import card_weekly as CW
from . import flow_weekly as FW
from . import shared
from .registry import register, rounded
from .sqlfmt import select_rounded, summary_sql

N_SPLITS = 5


_summary_sql = summary_sql


# ---------------------------------------------------------------- label pairs (labels table)
@register("M1_confusion", oracle_with("label_pairs") + """
SELECT a.y_true, b.y_pred, count(lp.doc_id) AS n
FROM (SELECT unnest([0, 1]) AS y_true) a CROSS JOIN (SELECT unnest([0, 1]) AS y_pred) b
LEFT JOIN label_pairs lp ON lp.y = a.y_true AND lp.p = b.y_pred GROUP BY ALL""")
def m1(spark, sf_dir):
    return M.confusion(label_pairs(spark, sf_dir), labels=[0, 1])


@register("M2_per_class_prf", oracle_with("label_pairs") + """,
pl AS (SELECT l.label, count(*) FILTER (WHERE y = l.label AND p = l.label) AS tp, count(*) FILTER (WHERE y = l.label) AS support,
              count(*) FILTER (WHERE p = l.label) AS predicted FROM label_pairs CROSS JOIN (SELECT unnest([0, 1]) AS label) l GROUP BY l.label)
SELECT label, round(coalesce(tp / nullif(predicted, 0), 0.0), 6) AS precision, round(coalesce(tp / nullif(support, 0), 0.0), 6) AS recall,
       round(coalesce(2.0 * tp / nullif(support + predicted, 0), 0.0), 6) AS f1, support FROM pl""")
def m2(spark, sf_dir):
    return rounded(M.per_class_prf(label_pairs(spark, sf_dir), labels=[0, 1]), 6)


@register("M3_classification_summary", oracle_with("label_pairs") + "\nSELECT * FROM " + _summary_sql("label_pairs", "y", "p", [0, 1, 2, 3]))
def m3(spark, sf_dir):
    return rounded(M.classification_summary(label_pairs(spark, sf_dir)), 6)


# ---------------------------------------------------------------- card weekly: persistence
@register("M6_persistence_card", CW._LAG_SQL + ",\nlt AS (SELECT * FROM lagf WHERE split = 'test')\nSELECT * FROM "
          + _summary_sql("lt", "bucket_t_plus_1", "bucket_t", M.LABELS))
def m6c(spark, sf_dir):
    lag = CW.lag_rows_of(spark, sf_dir).where(F.col("split") == "test")
    return rounded(M.classification_summary(lag, "bucket_t_plus_1", "bucket_t"), 6)


# ---------------------------------------------------------------- signed flows: persistence, majority
_FLOW_TEST = FW._FEATURES_SQL + """,
ft AS (SELECT * FROM f WHERE bucket_spend_t_plus_1 IS NOT NULL AND target_spend_t_plus_1 IS NOT NULL),
fte AS (SELECT * FROM ft WHERE is_test = 1),
ftr AS (SELECT * FROM ft WHERE is_test = 0),
maj AS (SELECT bucket_spend_t_plus_1 AS m FROM ftr GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
majn AS (SELECT bucket_net_t_plus_1 AS m FROM ftr GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
scored AS (SELECT fte.*, (SELECT m FROM maj) AS majority_spend, (SELECT m FROM majn) AS majority_net FROM fte)"""


def flow_scored(spark, sf_dir):
    def build():
        feats = FW.labels_of(spark, sf_dir)
        tr = feats.where("is_test = 0")
        ms = M.majority_class(tr, "bucket_spend_t_plus_1").first()[0]
        mn = M.majority_class(tr, "bucket_net_t_plus_1").first()[0]
        return feats.where("is_test = 1").withColumn("majority_spend", F.lit(ms)).withColumn("majority_net", F.lit(mn))
    return shared.frame(spark, "flow_scored_baselines", sf_dir, build)


@register("M6_persistence_flow", _FLOW_TEST + "\nSELECT * FROM " + _summary_sql("fte", "bucket_spend_t_plus_1", "bucket_spend_t", M.LABELS))
def m6f(spark, sf_dir):
    return rounded(M.classification_summary(flow_scored(spark, sf_dir), "bucket_spend_t_plus_1", "bucket_spend_t"), 6)


@register("M7_majority_baseline", _FLOW_TEST + "\nSELECT * FROM " + _summary_sql("scored", "bucket_spend_t_plus_1", "majority_spend", M.LABELS))
def m7(spark, sf_dir):
    return rounded(M.classification_summary(flow_scored(spark, sf_dir), "bucket_spend_t_plus_1", "majority_spend"), 6)


@register("M1_confusion_persistence_flow", _FLOW_TEST + """
SELECT a.y_true, b.y_pred, count(fte.user_id) AS n
FROM (SELECT unnest([0, 1, 2, 3]) AS y_true) a CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS y_pred) b
LEFT JOIN fte ON fte.bucket_spend_t_plus_1 = a.y_true AND fte.bucket_spend_t = b.y_pred GROUP BY ALL""")
def m1f(spark, sf_dir):
    return M.confusion(flow_scored(spark, sf_dir), "bucket_spend_t_plus_1", "bucket_spend_t")


@register("M24_slice_accuracy", _FLOW_TEST + """
SELECT bucket_spend_t_plus_1 <> bucket_spend_t AS was_transition, count(*) AS n_rows,
       round(avg(CAST(bucket_spend_t = bucket_spend_t_plus_1 AS DOUBLE)), 6) AS acc_bucket_spend_t,
       round(avg(CAST(majority_spend = bucket_spend_t_plus_1 AS DOUBLE)), 6) AS acc_majority_spend
FROM scored GROUP BY 1""")
def m24(spark, sf_dir):
    return rounded(M.slice_accuracy(flow_scored(spark, sf_dir), "bucket_spend_t_plus_1",
                                    ["bucket_spend_t", "majority_spend"], "bucket_spend_t"), 6)


@register("A34_metrics_pivot", _FLOW_TEST + """,
s AS (SELECT 'persistence' AS model, 'spend' AS target, f1_macro FROM """ + _summary_sql("fte", "bucket_spend_t_plus_1", "bucket_spend_t", M.LABELS) + """
      UNION ALL SELECT 'persistence', 'net', f1_macro FROM """ + _summary_sql("fte", "bucket_net_t_plus_1", "bucket_net_t", M.LABELS) + """
      UNION ALL SELECT 'majority', 'spend', f1_macro FROM """ + _summary_sql("scored", "bucket_spend_t_plus_1", "majority_spend", M.LABELS) + """
      UNION ALL SELECT 'majority', 'net', f1_macro FROM """ + _summary_sql("scored", "bucket_net_t_plus_1", "majority_net", M.LABELS) + """)
SELECT model, any_value(f1_macro) FILTER (WHERE target = 'net') AS net, any_value(f1_macro) FILTER (WHERE target = 'spend') AS spend,
       round(any_value(f1_macro) FILTER (WHERE target = 'spend') - any_value(f1_macro) FILTER (WHERE target = 'net'), 6) AS delta
FROM s GROUP BY model""")
def a34(spark, sf_dir):
    sc = flow_scored(spark, sf_dir)
    runs = [("persistence", "spend", "bucket_spend_t_plus_1", "bucket_spend_t"),
            ("persistence", "net", "bucket_net_t_plus_1", "bucket_net_t"),
            ("majority", "spend", "bucket_spend_t_plus_1", "majority_spend"),
            ("majority", "net", "bucket_net_t_plus_1", "majority_net")]
    parts = [M.classification_summary(sc, y, p).select(F.lit(m).alias("model"), F.lit(t).alias("target"), "f1_macro")
             for m, t, y, p in runs]
    allm = parts[0]
    for p in parts[1:]:
        allm = allm.unionByName(p)
    allm = rounded(allm, 6)
    pv = allm.groupBy("model").pivot("target", ["net", "spend"]).agg(F.first("f1_macro"))
    return rounded(pv.withColumn("delta", F.col("spend") - F.col("net")), 6)


# ---------------------------------------------------------------- expanding folds on the flow train rows
_FOLD_SQL = _FLOW_TEST + f""",
ix AS (SELECT ftr.*, row_number() OVER (ORDER BY week_start, user_id) - 1 AS row_index, count(*) OVER () AS n_rows FROM ftr),
fs AS (SELECT *, n_rows // {N_SPLITS + 1} AS test_size, n_rows - {N_SPLITS} * (n_rows // {N_SPLITS + 1}) AS t0 FROM ix),
fx AS (SELECT *, CASE WHEN row_index >= t0 THEN CAST(floor((row_index - t0) / greatest(test_size, 1)) + 1 AS INT) END AS test_fold FROM fs)"""


def folds_of(spark, sf_dir):
    """All columns of the train rows with their folds, a filter and a comparison on the frame that is kept."""
    def build():
        feats, _ = FW.features_31(spark, sf_dir)
        return B.expanding_folds(feats.where("is_test = 0"), ["week_start", "user_id"], N_SPLITS, index=False)
    return shared.value(spark, "flow_folds", sf_dir, build)


def fold_labels(spark, sf_dir):
    """Keys and buckets of the train rows with their folds."""
    return shared.value(spark, "flow_fold_labels", sf_dir, lambda: B.expanding_folds(
        FW.labels_of(spark, sf_dir).where("is_test = 0"), ["week_start", "user_id"], N_SPLITS, index=False))


@register("B12_expanding_folds", _FOLD_SQL + f"""
SELECT test_fold AS fold, CAST(any_value(t0) + (test_fold - 1) * any_value(test_size) AS BIGINT) AS train_rows,
       count(*) AS test_rows, min(week_start) AS test_start_week, max(week_start) AS test_end_week
FROM fx WHERE test_fold IS NOT NULL GROUP BY test_fold""")
def b12(spark, sf_dir):
    fx = fold_labels(spark, sf_dir)
    size, n = fx.select("test_size", "n_rows").first()
    t0 = n - N_SPLITS * size
    return (fx.where(F.col("test_fold").isNotNull()).groupBy(F.col("test_fold").alias("fold"))
            .agg(F.count(F.lit(1)).alias("test_rows"), F.min("week_start").alias("test_start_week"),
                 F.max("week_start").alias("test_end_week"))
            .withColumn("train_rows", (F.lit(t0) + (F.col("fold") - 1) * F.lit(size)).cast("bigint")))


def fold_metrics(spark, sf_dir):
    """Persistence and fold-trained majority predictors on every test block."""
    fx = fold_labels(spark, sf_dir)
    y = F.col("bucket_spend_t_plus_1")
    counts = fx.agg(*[count_if((F.coalesce("test_fold", F.lit(0)) < i) & (y == c)).alias(f"c{i}_{c}")
                      for i in range(1, N_SPLITS + 1) for c in M.LABELS]).first()
    maj = {i: sorted(M.LABELS, key=lambda c: (-counts[f"c{i}_{c}"], c))[0] for i in range(1, N_SPLITS + 1)}
    mexpr = None
    for i, c in maj.items():
        mexpr = F.when(F.col("test_fold") == i, F.lit(c)) if mexpr is None else mexpr.when(F.col("test_fold") == i, F.lit(c))
    blocks = fx.where(F.col("test_fold").isNotNull()).withColumn("majority", mexpr).withColumnRenamed("test_fold", "fold")
    a = M.classification_summary(blocks, "bucket_spend_t_plus_1", "bucket_spend_t", by=["fold"]).withColumn("model", F.lit("persistence"))
    b = M.classification_summary(blocks, "bucket_spend_t_plus_1", "majority", by=["fold"]).withColumn("model", F.lit("majority"))
    return a.unionByName(b)


_FM_SQL = _FOLD_SQL + """,
fb AS (SELECT * FROM fx WHERE test_fold IS NOT NULL),
mc AS (SELECT f.fold, x.bucket_spend_t_plus_1 AS c, count(*) AS n
       FROM (SELECT DISTINCT test_fold AS fold, t0, test_size FROM fb) f JOIN fx x ON x.row_index < f.t0 + (f.fold - 1) * f.test_size
       GROUP BY ALL),
mj AS (SELECT fold, arg_max(c, n * 10 - c) AS majority FROM mc GROUP BY fold),
fbm AS (SELECT fb.*, mj.majority FROM fb JOIN mj ON mj.fold = fb.test_fold),
fm AS (SELECT 'persistence' AS model, * FROM """ + _summary_sql("fbm", "bucket_spend_t_plus_1", "bucket_spend_t", M.LABELS, by="test_fold") + """
       UNION ALL SELECT 'majority', * FROM """ + _summary_sql("fbm", "bucket_spend_t_plus_1", "majority", M.LABELS, by="test_fold") + """)"""


@register("M11_fold_metrics", _FM_SQL + """
SELECT model, test_fold AS fold, n_rows, f1_macro, f1_macro_fixed, f1_weighted, accuracy, balanced_accuracy FROM fm""")
def m11(spark, sf_dir):
    return rounded(fold_metrics(spark, sf_dir), 6)


@register("M11_fold_confusion", _FOLD_SQL + """,
fb AS (SELECT * FROM fx WHERE test_fold IS NOT NULL),
fp AS (SELECT test_fold AS fold, min(week_start) AS test_start_week, max(week_start) AS test_end_week FROM fb GROUP BY 1)
SELECT fp.fold, test_start_week, test_end_week, a.y_true, b.y_pred, count(fb.user_id) AS n
FROM fp CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS y_true) a CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS y_pred) b
LEFT JOIN fb ON fb.test_fold = fp.fold AND fb.bucket_spend_t_plus_1 = a.y_true AND fb.bucket_spend_t = b.y_pred GROUP BY ALL""")
def m11c(spark, sf_dir):
    """Period and 4 x 4 confusion of the persistence predictor on every test block."""
    fb = fold_labels(spark, sf_dir).where(F.col("test_fold").isNotNull()).withColumnRenamed("test_fold", "fold")
    period = fb.groupBy("fold").agg(F.min("week_start").alias("test_start_week"), F.max("week_start").alias("test_end_week"))
    return period.join(M.confusion(fb, "bucket_spend_t_plus_1", "bucket_spend_t", by=["fold"]), "fold")


@register("M12_stability", _FM_SQL + """,
r AS (SELECT model, f1_macro, row_number() OVER (PARTITION BY model ORDER BY test_fold) AS a,
             row_number() OVER (PARTITION BY model ORDER BY test_fold DESC) AS b FROM fm),
g AS (SELECT model, count(*) AS n_folds, avg(CASE WHEN a <= 2 THEN f1_macro END) AS first2, avg(CASE WHEN b <= 2 THEN f1_macro END) AS last2
      FROM r GROUP BY model)
SELECT model, n_folds, round(first2, 6) AS first2, round(last2, 6) AS last2, round((first2 - last2) / nullif(abs(first2), 0), 6) AS relative_drop,
       CASE WHEN n_folds < 3 THEN 'insufficient_folds' WHEN (first2 - last2) / nullif(abs(first2), 0) > 0.10 THEN 'degraded' ELSE 'stable' END AS stability
FROM g""")
def m12(spark, sf_dir):
    fm = rounded(fold_metrics(spark, sf_dir), 6)
    return rounded(M.stability(fm, "f1_macro", ["model"]), 6)


@register("M13_fold_spread", _FM_SQL + """
SELECT model, round(avg(f1_macro), 6) AS mean, round(stddev_pop(f1_macro), 6) AS std,
       round(arg_min(f1_macro, test_fold) - arg_max(f1_macro, test_fold), 6) AS first_to_last_drop FROM fm GROUP BY model""")
def m13(spark, sf_dir):
    fm = rounded(fold_metrics(spark, sf_dir), 6)
    return rounded(M.fold_spread(fm, "f1_macro", ["model"]), 6)


@register("M16_leaderboard", _FM_SQL + """,
r AS (SELECT model, f1_macro, row_number() OVER (PARTITION BY model ORDER BY test_fold) AS a,
             row_number() OVER (PARTITION BY model ORDER BY test_fold DESC) AS b FROM fm),
st AS (SELECT model, (avg(CASE WHEN a <= 2 THEN f1_macro END) - avg(CASE WHEN b <= 2 THEN f1_macro END))
                     / nullif(abs(avg(CASE WHEN a <= 2 THEN f1_macro END)), 0) AS relative_drop FROM r GROUP BY model),
te AS (SELECT 'persistence' AS run, f1_macro, balanced_accuracy FROM """ + _summary_sql("scored", "bucket_spend_t_plus_1", "bucket_spend_t", M.LABELS) + """
       UNION ALL SELECT 'majority', f1_macro, balanced_accuracy FROM """ + _summary_sql("scored", "bucket_spend_t_plus_1", "majority_spend", M.LABELS) + """),
j AS (SELECT te.run, te.f1_macro, te.balanced_accuracy, round(st.relative_drop, 6) AS relative_drop FROM te JOIN st ON st.model = te.run)
SELECT *, row_number() OVER (ORDER BY f1_macro DESC, balanced_accuracy DESC, relative_drop ASC NULLS LAST, run ASC) AS rank FROM j""")
def m16(spark, sf_dir):
    sc = flow_scored(spark, sf_dir)
    te = (M.classification_summary(sc, "bucket_spend_t_plus_1", "bucket_spend_t").select(F.lit("persistence").alias("run"), "f1_macro", "balanced_accuracy")
          .unionByName(M.classification_summary(sc, "bucket_spend_t_plus_1", "majority_spend")
                       .select(F.lit("majority").alias("run"), "f1_macro", "balanced_accuracy")))
    te = rounded(te, 6)
    st = rounded(M.stability(rounded(fold_metrics(spark, sf_dir), 6), "f1_macro", ["model"]), 6)
    j = te.join(st.select(F.col("model").alias("run"), "relative_drop"), "run")
    return M.leaderboard(j)


# ---------------------------------------------------------------- regression baselines on category rows
_REG_SQL = FW._CAT_SQL + ",\nrt AS (SELECT * FROM reg WHERE is_test = 1)"


@register("M8_regression_baselines", _REG_SQL + """,
l AS (SELECT 'persistence' AS model, amount_cat_t_plus_1 AS y, amount_cat_t AS pred FROM rt
      UNION ALL SELECT 'rolling_mean_4', amount_cat_t_plus_1, rolling_mean_4 FROM rt),
m AS (SELECT model, count(*) AS n_rows, avg(abs(pred - y)) AS mae, sqrt(avg((pred - y) * (pred - y))) AS rmse,
             avg(CASE WHEN y > 0 THEN abs(pred - y) / y END) AS mape FROM l GROUP BY model)
SELECT model, n_rows, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(mape, 6) AS mape,
       round(mae / (SELECT mae FROM m WHERE model = 'persistence'), 6) AS skill FROM m""")
def m8(spark, sf_dir):
    reg, _ = FW.regression_rows(spark, sf_dir)
    rt = reg.where("is_test = 1")
    a = M.regression_metrics(rt, "amount_cat_t_plus_1", "amount_cat_t").withColumn("model", F.lit("persistence"))
    b = M.regression_metrics(rt, "amount_cat_t_plus_1", "rolling_mean_4").withColumn("model", F.lit("rolling_mean_4"))
    m = a.unionByName(b)
    pm = a.select("mae").first()["mae"]
    return rounded(m.withColumn("skill", F.col("mae") / F.lit(pm)), 4, {"mape": 6, "skill": 6})


@register("M10_top_category_errors", _REG_SQL + """,
top AS (SELECT category FROM rt GROUP BY category ORDER BY count(*) DESC, category LIMIT 5)
SELECT category, count(*) AS n_rows, round(avg(abs(amount_cat_t - amount_cat_t_plus_1)), 4) AS mae,
       round(sqrt(avg((amount_cat_t - amount_cat_t_plus_1) * (amount_cat_t - amount_cat_t_plus_1))), 4) AS rmse
FROM rt WHERE category IN (SELECT category FROM top) GROUP BY category""")
def m10(spark, sf_dir):
    from ..operators.categories import top_labels
    reg, _ = FW.regression_rows(spark, sf_dir)
    rt = reg.where("is_test = 1")
    top = top_labels(rt, "category", 5).select("category")
    m = M.regression_metrics(rt.join(F.broadcast(top), "category", "left_semi"), "amount_cat_t_plus_1", "amount_cat_t",
                             by=["category"])
    return rounded(m.select("category", "n_rows", "mae", "rmse"))


@register("M14_acceptance_gain", _REG_SQL + """,
m AS (SELECT avg(abs(amount_cat_t - amount_cat_t_plus_1)) AS p, avg(abs(rolling_mean_4 - amount_cat_t_plus_1)) AS r FROM rt)
SELECT 'rolling_mean_4' AS model, round((p - r) / abs(p), 6) AS relative_gain, (p - r) / abs(p) >= 0.5 AS gain_ge_50pct,
       (p - r) / abs(p) >= 0.7 AS gain_ge_70pct FROM m""")
def m14(spark, sf_dir):
    reg = FW.regression_plan(spark, sf_dir)
    rt = reg.where("is_test = 1")
    m = rt.agg(F.avg(F.abs(F.col("amount_cat_t") - F.col("amount_cat_t_plus_1"))).alias("p"),
               F.avg(F.abs(F.col("rolling_mean_4") - F.col("amount_cat_t_plus_1"))).alias("r"))
    g = M.acceptance_gain(F.col("r"), F.col("p"), higher_is_better=False)
    return rounded(m.select(F.lit("rolling_mean_4").alias("model"), *[v.alias(k) for k, v in g.items()]), 6)


@register("J16_before_after", _FLOW_TEST + """,
bef AS (SELECT 'persistence' AS model, * FROM """ + _summary_sql("fte", "bucket_net_t_plus_1", "bucket_net_t", M.LABELS) + """
        UNION ALL SELECT 'majority', * FROM """ + _summary_sql("scored", "bucket_net_t_plus_1", "majority_net", M.LABELS) + """),
aft AS (SELECT 'persistence' AS model, * FROM """ + _summary_sql("fte", "bucket_spend_t_plus_1", "bucket_spend_t", M.LABELS) + """
        UNION ALL SELECT 'majority', * FROM """ + _summary_sql("scored", "bucket_spend_t_plus_1", "majority_spend", M.LABELS) + """)
SELECT b.model, round(a.f1_macro - b.f1_macro, 6) AS delta_f1_macro,
       round(a.balanced_accuracy - b.balanced_accuracy, 6) AS delta_balanced_accuracy,
       (a.f1_macro - b.f1_macro >= 0.02 OR a.balanced_accuracy - b.balanced_accuracy >= 0.02) AS keep
FROM bef b JOIN aft a ON a.model = b.model""")
def j16(spark, sf_dir):
    """Per-model deltas between two metric sets (net target = before, spend = after)."""
    sc = flow_scored(spark, sf_dir)
    runs = {"persistence": (("bucket_net_t_plus_1", "bucket_net_t"), ("bucket_spend_t_plus_1", "bucket_spend_t")),
            "majority": (("bucket_net_t_plus_1", "majority_net"), ("bucket_spend_t_plus_1", "majority_spend"))}
    bef = aft = None
    for m, ((yb, pb), (ya, pa)) in runs.items():
        b = rounded(M.classification_summary(sc, yb, pb), 6).select(F.lit(m).alias("model"), F.col("f1_macro").alias("bf"),
                                                                     F.col("balanced_accuracy").alias("bb"))
        a = rounded(M.classification_summary(sc, ya, pa), 6).select(F.lit(m).alias("model"), F.col("f1_macro").alias("af"),
                                                                     F.col("balanced_accuracy").alias("ab"))
        bef = b if bef is None else bef.unionByName(b)
        aft = a if aft is None else aft.unionByName(a)
    j = bef.join(aft, "model")
    df1, db = F.col("af") - F.col("bf"), F.col("ab") - F.col("bb")
    return rounded(j.select("model", df1.alias("delta_f1_macro"), db.alias("delta_balanced_accuracy"),
                            ((df1 >= 0.02) | (db >= 0.02)).alias("keep")), 6)


def _class_sql(frame: str, y: str, p: str) -> str:
    return (f"SELECT l.label, coalesce(2.0 * count(*) FILTER ({y} = l.label AND {p} = l.label) / nullif(count(*) FILTER ({y} = l.label)"
            f" + count(*) FILTER ({p} = l.label), 0), 0.0) AS f1, count(*) FILTER ({y} = l.label) AS support"
            f" FROM {frame} CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS label) l GROUP BY l.label")


@register("J16_per_class_deltas", _FLOW_TEST + f""",
bef AS ({_class_sql("fte", "bucket_net_t_plus_1", "bucket_net_t")}),
aft AS ({_class_sql("fte", "bucket_spend_t_plus_1", "bucket_spend_t")})
SELECT label, round(a.f1 - b.f1, 6) AS delta_f1, a.support - b.support AS delta_support FROM aft a JOIN bef b USING (label)""")
def j16c(spark, sf_dir):
    """J16 per class: F1 and support of the spend target minus those of the net target, persistence."""
    sc = flow_scored(spark, sf_dir)
    bef = M.per_class_prf(sc, "bucket_net_t_plus_1", "bucket_net_t").select("label", F.col("f1").alias("bf"), F.col("support").alias("bs"))
    aft = M.per_class_prf(sc, "bucket_spend_t_plus_1", "bucket_spend_t").select("label", "f1", "support")
    return rounded(aft.join(bef, "label").select("label", (F.col("f1") - F.col("bf")).alias("delta_f1"),
                                                 (F.col("support") - F.col("bs")).alias("delta_support")), 6)
