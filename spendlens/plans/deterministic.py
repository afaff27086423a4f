"""The model and personalisation operators on scorers that SQL can repeat (``*_det`` queries).

Two scorers give class probabilities for the weekly spend bucket: the smoothed train transition row
of the current bucket, and the smoothed train class shares.  A per-user predictor that adds up the
labels already seen takes the calibrated model's place.  The forest versions of the same queries
stay registered; these prove the operators behind them value by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import personalize as P
from ..operators import train as T
from . import evaluation as EV
from . import flow_weekly as FW
from . import shared
from .registry import register, rounded

Y, NOW = "bucket_spend_t_plus_1", "bucket_spend_t"
KEYS = ["user_id", "week_start", "week_t"]
CLASSES = range(4)
VOTES = 250


def _rows(spark, sf_dir) -> DataFrame:
    return FW.labels_of(spark, sf_dir).select(*KEYS, "is_test", NOW, Y)


def _argmax(cells: list) -> F.Column:
    """Lowest class with the largest value."""
    best = F.greatest(*cells)
    out = F.lit(len(cells) - 1)
    for i in reversed(range(len(cells) - 1)):
        out = F.when(cells[i] == best, F.lit(i)).otherwise(out)
    return out


def _smoothed(counts: DataFrame, total: str, prefix: str) -> list:
    return [((F.col(f"{prefix}{c}") + 1.0) / (F.col(total) + 4.0)).alias(f"proba_class_{c}") for c in CLASSES]


def scored(spark, sf_dir) -> DataFrame:
    """Every row with its transition probabilities and their argmax (a bucket unseen in train: 1/4 each)."""
    def build():
        rows = _rows(spark, sf_dir)
        table = rows.where("is_test = 0").groupBy(F.col(NOW).alias("_b")).agg(
            F.count(F.lit(1)).alias("_n"), *[F.count(F.when(F.col(Y) == c, 1)).alias(f"_c{c}") for c in CLASSES])
        j = rows.join(F.broadcast(table), F.col(NOW) == F.col("_b"), "left").na.fill(0, ["_n", *[f"_c{c}" for c in CLASSES]])
        out = j.select(*KEYS, "is_test", NOW, Y, *_smoothed(j, "_n", "_c"))
        return out.withColumn("predicted_class", _argmax([F.col(f"proba_class_{c}") for c in CLASSES]))
    return shared.frame(spark, "det_scored", sf_dir, build)


def prior(spark, sf_dir, scale: float = 1.0) -> DataFrame:
    """Test rows with the smoothed train class shares, times ``scale``."""
    rows = _rows(spark, sf_dir)
    one = rows.where("is_test = 0").agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.when(F.col(Y) == c, 1)).alias(f"_c{c}") for c in CLASSES])
    j = rows.where("is_test = 1").crossJoin(F.broadcast(one))
    out = j.select(*KEYS, NOW, Y, *[(p * scale).alias(f"proba_class_{c}") for c, p in zip(CLASSES, _smoothed(j, "_n", "_c"))])
    return out.withColumn("predicted_class", _argmax([F.col(f"proba_class_{c}") for c in CLASSES]))


def evaluated(spark, sf_dir) -> DataFrame:
    """L13's output columns from the label counts of each user's earlier rows."""
    def build():
        user = Window.partitionBy("user_id").orderBy("week_start", "week_t")
        before = user.rowsBetween(Window.unboundedPreceding, -1)
        s = scored(spark, sf_dir).select(
            "*", F.row_number().over(user).alias("week_order"), F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("total"),
            *[F.coalesce(F.sum(F.when(F.col(Y) == c, 1).otherwise(0)).over(before), F.lit(0)).alias(f"_h{c}") for c in CLASSES])
        seen = F.col("week_order") - 1
        cal = [F.col(f"_h{c}") + F.col(f"proba_class_{c}") for c in CLASSES]
        blend = [F.when(seen >= 8, 0.8 * F.col(f"proba_class_{c}") + 0.2 * (F.col(f"_h{c}") / seen.cast("double")))
                 .otherwise(F.col(f"proba_class_{c}")) for c in CLASSES]
        updates = F.when(seen >= 8, F.floor((seen - 8) / 2) + 1).otherwise(0).cast("int")
        return s.where("is_test = 1").select(
            "user_id", "week_t", "week_order", F.col(Y).cast("int").alias("y_true"), F.col("predicted_class").alias("y_pred_base"),
            _argmax(cal).alias("y_pred_cal"), _argmax(blend).alias("y_pred_blend"), F.greatest(*blend).alias("confidence"),
            updates.alias("update_count"), F.col("total").cast("int").alias("user_total_history"))
    return shared.frame(spark, "det_evaluated", sf_dir, build)


def _arg_sql(cells: list[str]) -> str:
    best = f"greatest({', '.join(cells)})"
    return "CASE " + " ".join(f"WHEN {c} = {best} THEN {i}" for i, c in enumerate(cells[:-1])) + f" ELSE {len(cells) - 1} END"


_P = [f"p{c}" for c in CLASSES]
_DET = EV._FLOW_TEST + f""",
tt AS (SELECT {NOW} AS b, count(*) AS n, {", ".join(f"count(*) FILTER ({Y} = {c}) AS c{c}" for c in CLASSES)} FROM ftr GROUP BY 1),
ds0 AS (SELECT ft.user_id, ft.week_start, ft.week_t, ft.is_test, ft.{NOW} AS now, ft.{Y} AS y,
        {", ".join(f"(coalesce(c{c}, 0) + 1.0::DOUBLE) / (coalesce(n, 0) + 4.0::DOUBLE) AS p{c}" for c in CLASSES)}
        FROM ft LEFT JOIN tt ON tt.b = ft.{NOW}),
ds AS (SELECT *, {_arg_sql(_P)} AS k FROM ds0),
dt AS (SELECT * FROM ds WHERE is_test = 1),
pr AS (SELECT {", ".join(f"(count(*) FILTER ({Y} = {c}) + 1.0::DOUBLE) / (count(*) + 4.0::DOUBLE) AS q{c}" for c in CLASSES)} FROM ftr),
dp AS (SELECT *, {_arg_sql([f"q{c}" for c in CLASSES])} AS kq FROM dt, pr),
hi AS (SELECT *, row_number() OVER u AS week_order, count(*) OVER (PARTITION BY user_id) AS total, row_number() OVER u - 1 AS seen,
        {", ".join(f"coalesce(sum((y = {c})::INT) OVER (PARTITION BY user_id ORDER BY week_start, week_t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS h{c}" for c in CLASSES)}
        FROM ds WINDOW u AS (PARTITION BY user_id ORDER BY week_start, week_t)),
bl AS (SELECT *, {", ".join(f"CASE WHEN seen >= 8 THEN 0.8::DOUBLE * p{c} + 0.2::DOUBLE * (h{c}::DOUBLE / seen::DOUBLE) ELSE p{c} END AS b{c}" for c in CLASSES)} FROM hi),
ev AS (SELECT user_id, week_t, week_order, y AS y_true, k AS y_pred_base, {_arg_sql([f"(h{c} + p{c})" for c in CLASSES])} AS y_pred_cal,
        {_arg_sql([f"b{c}" for c in CLASSES])} AS y_pred_blend, greatest(b0, b1, b2, b3) AS confidence,
        CASE WHEN seen >= 8 THEN (seen - 8) // 2 + 1 ELSE 0 END AS update_count, total AS user_total_history FROM bl WHERE is_test = 1)"""


def out_of_fold(spark, sf_dir) -> DataFrame:
    """Out-of-fold predictions of three learners that counts fit: the bucket itself, the train rows' largest class, and the
    largest class after the current bucket.  Counts by block add up to those of every fold, so one pass fits all folds.
    """
    def build():
        fx = EV.fold_labels(spark, sf_dir)
        block = F.coalesce("test_fold", F.lit(0))
        counts = fx.groupBy(block.alias("_block"), F.col(NOW).alias("_b")).agg(*[F.count(F.when(F.col(Y) == c, 1)).alias(f"_c{c}") for c in CLASSES])
        folds = F.explode(F.sequence(F.lit(1), F.lit(EV.N_SPLITS)))
        fitted = counts.withColumn("fold", folds).where("_block < fold").groupBy("fold", "_b").agg(*[F.sum(f"_c{c}").alias(f"_c{c}") for c in CLASSES])
        whole = fitted.groupBy("fold").agg(*[F.sum(f"_c{c}").alias(f"_m{c}") for c in CLASSES])
        rows = fx.where("test_fold IS NOT NULL").select(F.col("test_fold").alias("fold"), "user_id", "week_start", NOW, F.col(Y).cast("int").alias("y"))
        rows = rows.join(F.broadcast(whole), "fold")            # a row per fold, then one per fold and bucket
        fitted = fitted.withColumnRenamed("fold", "_f")
        rows = rows.join(F.broadcast(fitted), (F.col("fold") == F.col("_f")) & (F.col(NOW) == F.col("_b")), "left")
        said = {"persistence": F.col(NOW).cast("int"), "majority": _argmax([F.col(f"_m{c}") for c in CLASSES]),
                "transition": _argmax([F.coalesce(f"_c{c}", F.lit(0)) for c in CLASSES])}
        models = F.explode(F.array(*[F.struct(F.lit(k).alias("model"), v.alias("p")) for k, v in said.items()]))
        return rows.select("fold", "user_id", "week_start", "y", models.alias("_s")).select("fold", "_s.model", "user_id", "week_start", "y", "_s.p")
    return shared.frame(spark, "det_out_of_fold", sf_dir, build)


_OOF = EV._FOLD_SQL + f""",
oc AS (SELECT f.fold, x.{NOW} AS b, {", ".join(f"count(*) FILTER (x.{Y} = {c}) AS c{c}" for c in CLASSES)}
       FROM range(1, {EV.N_SPLITS} + 1) AS f(fold) JOIN fx x ON coalesce(x.test_fold, 0) < f.fold GROUP BY ALL),
om AS (SELECT fold, {", ".join(f"sum(c{c}) AS m{c}" for c in CLASSES)} FROM oc GROUP BY fold),
oj AS (SELECT x.test_fold AS fold, x.week_start, x.{Y} AS y, x.{NOW} AS now, {_arg_sql([f"m{c}" for c in CLASSES])} AS maj,
       {_arg_sql([f"coalesce(c{c}, 0)" for c in CLASSES])} AS tra FROM fx x JOIN om ON om.fold = x.test_fold LEFT JOIN oc ON oc.fold = x.test_fold AND oc.b = x.{NOW}
       WHERE x.test_fold IS NOT NULL),
oo AS (SELECT fold, 'persistence' AS model, week_start, y, now AS p FROM oj UNION ALL SELECT fold, 'majority', week_start, y, maj FROM oj
       UNION ALL SELECT fold, 'transition', week_start, y, tra FROM oj),
ol AS (SELECT fold, model, l.label, count(*) FILTER (y = l.label AND p = l.label) AS tp, count(*) FILTER (y = l.label) AS support,
       count(*) FILTER (p = l.label) AS predicted FROM oo, (SELECT unnest([0, 1, 2, 3]) AS label) l GROUP BY ALL)"""


@register("M11_model_folds_det", _OOF + """,
os AS (SELECT fold, model, count(*) AS n_rows, min(week_start) AS test_start_week, max(week_start) AS test_end_week FROM oo GROUP BY ALL)
SELECT fold, model, any_value(n_rows) AS n_rows, any_value(test_start_week) AS test_start_week, any_value(test_end_week) AS test_end_week,
       round(avg(coalesce(2.0 * tp / nullif(support + predicted, 0), 0)) FILTER (support + predicted > 0), 6) AS f1_macro,
       round(avg(coalesce(2.0 * tp / nullif(support + predicted, 0), 0)), 6) AS f1_macro_fixed,
       round(sum(coalesce(2.0 * tp / nullif(support + predicted, 0), 0) * support) / sum(support), 6) AS f1_weighted,
       round(sum(tp) / any_value(n_rows), 6) AS accuracy, round(avg(tp / nullif(support, 0)), 6) AS balanced_accuracy
FROM ol JOIN os USING (fold, model) GROUP BY fold, model""")
def m11_folds(spark, sf_dir):
    return rounded(M.fold_summary(out_of_fold(spark, sf_dir)), 6)


@register("M11_model_confusion_det", _OOF + """
SELECT o.fold, o.model, a.y_true, b.y_pred, count(*) FILTER (o.y = a.y_true AND o.p = b.y_pred) AS n
FROM oo o, (SELECT unnest([0, 1, 2, 3]) AS y_true) a, (SELECT unnest([0, 1, 2, 3]) AS y_pred) b GROUP BY ALL""")
def m11_confusion(spark, sf_dir):
    return M.confusion(out_of_fold(spark, sf_dir), by=["fold", "model"])


@register("M11_model_classes_det", _OOF + """
SELECT fold, model, label, round(coalesce(tp / nullif(predicted, 0), 0.0), 6) AS precision, round(coalesce(tp / nullif(support, 0), 0.0), 6) AS recall,
       round(coalesce(2.0 * tp / nullif(support + predicted, 0), 0.0), 6) AS f1, support FROM ol""")
def m11_classes(spark, sf_dir):
    return rounded(M.per_class_prf(out_of_fold(spark, sf_dir), by=["fold", "model"]), 6)


@register("L10_score_probabilities_det", _DET + f"""
SELECT user_id, week_t, now AS {NOW}, y AS {Y}, {", ".join(f"round(p{c}, 6) AS proba_class_{c}" for c in CLASSES)}, k AS predicted_class FROM dt""")
def l10(spark, sf_dir):
    return rounded(scored(spark, sf_dir).where("is_test = 1").drop("week_start", "is_test"), 6)


@register("L13_evaluation_rows_det", _DET + """
SELECT user_id, week_t, week_order::INT AS week_order, y_true::INT AS y_true, y_pred_base, y_pred_cal, y_pred_blend,
       round(confidence, 6) AS confidence, update_count::INT AS update_count, user_total_history::INT AS user_total_history FROM ev""")
def l13(spark, sf_dir):
    return rounded(evaluated(spark, sf_dir), 6)


@register("M15_model_comparison_det", _DET + ",\nm AS (SELECT (SELECT f1_macro FROM " + EV._summary_sql("dt", "y", "k", M.LABELS)
          + ") AS a, (SELECT f1_macro FROM " + EV._summary_sql("dp", "y", "kq", M.LABELS) + """) AS b)
SELECT round(a, 6) AS transition, round(b, 6) AS prior, round(a - b, 6) AS margin,
       CASE WHEN a - b > 0.05 THEN 'clear_winner' WHEN a - b >= 0.02 THEN 'better' WHEN a - b >= 0 THEN 'comparable' ELSE 'worse' END AS verdict
FROM m""")
def m15(spark, sf_dir):
    a = M.classification_summary(scored(spark, sf_dir).where("is_test = 1"), Y, "predicted_class").select(F.col("f1_macro").alias("transition"))
    b = M.classification_summary(prior(spark, sf_dir), Y, "predicted_class").select(F.col("f1_macro").alias("prior"))
    a, b = rounded(a, 6), rounded(b, 6)
    margin = F.round(F.col("transition") - F.col("prior"), 6)
    verdict = F.when(margin > 0.05, "clear_winner").when(margin >= 0.02, "better").when(margin >= 0, "comparable").otherwise("worse")
    return a.crossJoin(F.broadcast(b)).select("transition", "prior", margin.alias("margin"), verdict.alias("verdict"))


@register("M17_prediction_parity_det", _DET + f""",
x AS (SELECT user_id, week_start, week_t, k, kq, [p0, p1, p2, p3] AS a, [{", ".join(f"q{c} * {VOTES}.0::DOUBLE" for c in CLASSES)}] AS r FROM dp),
z AS (SELECT *, r[1] + r[2] + r[3] + r[4] AS s, list_transform(r, lambda v: v / (r[1] + r[2] + r[3] + r[4])) AS b FROM x),
o AS (SELECT *, list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) AS c,
        list_transform(list_sort(list_transform([0, 1, 2, 3], lambda i: {{'v': -a[i + 1], 'i': i}})), lambda e: e.i) AS oa,
        list_transform(list_sort(list_transform([0, 1, 2, 3], lambda i: {{'v': -b[i + 1], 'i': i}})), lambda e: e.i) AS ob FROM z),
g AS (SELECT count(*) AS rows, avg((k = kq)::INT) AS class_match_rate, avg((ob[1] = k)::INT) AS argmax_norm_match_rate, avg(c) AS mean_cosine,
        count(*) FILTER (oa = ob) AS rank_order_match_count, avg((oa = ob)::INT) AS rank_order_agreement, min(s) AS prob_sum_min,
        avg(s) AS prob_sum_mean, max(s) AS prob_sum_max, min((user_id, week_start, week_t)) FILTER (k <> kq) AS f FROM o),
h AS (SELECT *, least(abs(prob_sum_mean - 1) / greatest(prob_sum_mean, 1), abs(prob_sum_mean - {VOTES}) / greatest(prob_sum_mean, {VOTES})) <= 0.01 AS ok FROM g),
i AS (SELECT *, ok AND argmax_norm_match_rate >= 0.9 AND (mean_cosine >= 0.95 OR rank_order_match_count >= 9) AS keep FROM h)
SELECT rows, round(class_match_rate, 6) AS class_match_rate, round(argmax_norm_match_rate, 6) AS argmax_norm_match_rate,
       round(mean_cosine, 6) AS mean_cosine, rank_order_match_count, round(rank_order_agreement, 6) AS rank_order_agreement,
       round(prob_sum_min, 6) AS prob_sum_min, round(prob_sum_mean, 6) AS prob_sum_mean, round(prob_sum_max, 6) AS prob_sum_max,
       CASE WHEN keep THEN 'KEEP' ELSE 'ABANDON' END AS decision,
       CASE WHEN keep THEN 'normalized_votes' WHEN NOT ok THEN 'raw_votes_not_normalized' WHEN argmax_norm_match_rate <= 0.6 THEN 'low_parity'
            ELSE 'borderline_parity' END AS root_cause, f[1] AS first_mismatch_user, f[3] AS first_mismatch_week FROM i""")
def m17(spark, sf_dir):
    out = T.prediction_parity(scored(spark, sf_dir).where("is_test = 1"), prior(spark, sf_dir, float(VOTES)), KEYS, votes=float(VOTES))
    first = [F.col("first_mismatch.user_id").alias("first_mismatch_user"), F.col("first_mismatch.week_t").alias("first_mismatch_week")]
    return rounded(out.select(*[c for c in out.columns if c != "first_mismatch"], *first), 6)


@register("M18_normalize_votes_det", _DET + f"""
SELECT user_id, week_t, {", ".join(f"round(q{c} * {VOTES}.0 / ((q0 + q1 + q2 + q3) * {VOTES}.0), 6) AS share_{c}" for c in CLASSES)} FROM dp""")
def m18(spark, sf_dir):
    s = prior(spark, sf_dir, float(VOTES))
    votes = F.map_from_arrays(F.array(*[F.lit(i) for i in range(5)]), F.array(*[F.col(f"proba_class_{i}") for i in CLASSES], F.lit(7.0)))
    s = s.withColumn("_v", T.normalize_votes(votes))
    return rounded(s.select("user_id", "week_t", *[F.element_at("_v", F.lit(c)).alias(f"share_{c}") for c in CLASSES]), 6)


@register("M19_probability_sum_check_det", _DET + """
SELECT count(*) AS rows, count(*) FILTER (abs(p0 + p1 + p2 + p3 - 1) > 0.05) AS bad_rows, round(min(p0 + p1 + p2 + p3), 6) AS sum_min,
       round(max(p0 + p1 + p2 + p3), 6) AS sum_max FROM dt""")
def m19(spark, sf_dir):
    return rounded(T.probability_sum_check(scored(spark, sf_dir).where("is_test = 1")), 6)


@register("M3_personalization_det", _DET + "\n" + " UNION ALL ".join(
    f"SELECT '{p}' AS predictor, * FROM " + EV._summary_sql("ev", "y_true", p, M.LABELS)
    for p in ("y_pred_base", "y_pred_cal", "y_pred_blend")))
def m3(spark, sf_dir):
    ev = evaluated(spark, sf_dir).select("y_true", F.explode(F.array(*[
        F.struct(F.lit(p).alias("predictor"), F.col(p).alias("p")) for p in ("y_pred_base", "y_pred_cal", "y_pred_blend")])).alias("s"))
    return rounded(M.classification_summary(ev.select("y_true", "s.*"), "y_true", "p", by=["predictor"]), 6)


def _user_f1_sql(p: str) -> str:
    cells = [f"coalesce(2.0 * count(*) FILTER (y_true = {c} AND {p} = {c}) / nullif(count(*) FILTER (y_true = {c}) + count(*) FILTER ({p} = {c}), 0), 0.0)"
             for c in CLASSES]
    return f"(((({cells[0]} + {cells[1]}) + {cells[2]}) + {cells[3]}) / 4)"


_USER = _DET + f""",
pu AS (SELECT user_id, {_user_f1_sql("y_pred_base")} AS fb, {_user_f1_sql("y_pred_cal")} AS fc FROM ev GROUP BY 1)"""


@register("M22_per_user_delta_det", _USER + """
SELECT count(*) FILTER (fc - fb > 1e-12) AS users_improved, count(*) FILTER (fc - fb < -1e-12) AS users_worsened,
       count(*) FILTER (abs(fc - fb) <= 1e-12) AS users_unchanged, """ + ", ".join(
    f"round(quantile_cont(fc - fb, {q}), 6) AS delta_p{int(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9)) + " FROM pu")
def m22(spark, sf_dir):
    pu = M.per_user_f1(evaluated(spark, sf_dir), "user_id", "y_true", ["y_pred_base", "y_pred_cal"])
    return rounded(M.per_user_delta_summary(pu, "f1_y_pred_base", "f1_y_pred_cal"), 6)


@register("M23_time_to_benefit_det", _DET + """,
ra AS (SELECT user_id, update_count, row_number() OVER w AS n, avg((y_pred_base = y_true)::INT) OVER w AS a, avg((y_pred_cal = y_true)::INT) OVER w AS b
       FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY week_order ROWS UNBOUNDED PRECEDING)),
fi AS (SELECT user_id, min(n) AS n, arg_min(update_count, n) AS u FROM ra WHERE b > a GROUP BY 1)
SELECT count(*) AS users_with_benefit, round(quantile_cont(n, 0.5), 4) AS median_rows_to_benefit, round(quantile_cont(u, 0.5), 4) AS median_updates_to_benefit FROM fi""")
def m23(spark, sf_dir):
    return rounded(P.time_to_benefit(evaluated(spark, sf_dir)))


@register("M25_confidence_curve_det", _DET + """
SELECT lo AS bin_lo, hi AS bin_hi, count(ev.user_id) AS n, round(coalesce(avg((y_true = y_pred_blend)::INT), 0.0), 6) AS accuracy
FROM (SELECT unnest([0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.95]::DOUBLE[]) AS lo,
             unnest([0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.95, 1.001]::DOUBLE[]) AS hi) b
LEFT JOIN ev ON confidence >= lo AND confidence < hi GROUP BY 1, 2""")
def m25(spark, sf_dir):
    return rounded(M.confidence_curve(evaluated(spark, sf_dir), "y_true", "y_pred_blend", "confidence"), 6)


@register("M26_small_history_slice_det", _DET + ",\nsm AS (SELECT * FROM ev WHERE user_total_history <= (SELECT avg(user_total_history) FROM ev))\nSELECT * FROM "
          + EV._summary_sql("sm", "y_true", "y_pred_blend", M.LABELS))
def m26(spark, sf_dir):
    ev = evaluated(spark, sf_dir)
    ev = ev.where(F.col("user_total_history") <= ev.agg(F.avg("user_total_history")).first()[0])
    return rounded(M.classification_summary(ev, "y_true", "y_pred_blend"), 6)


@register("K6_top_improved_users_det", _USER + """,
de AS (SELECT user_id, round(fc - fb, 9) AS delta FROM pu)
(SELECT user_id, round(delta, 6) AS delta, 'improved' AS side FROM de ORDER BY delta DESC, user_id LIMIT 10)
UNION ALL (SELECT user_id, round(delta, 6) AS delta, 'worsened' AS side FROM de ORDER BY delta, user_id LIMIT 10)""")
def k6(spark, sf_dir):
    pu = M.per_user_f1(evaluated(spark, sf_dir), "user_id", "y_true", ["y_pred_base", "y_pred_cal"])
    d = pu.select("user_id", F.round(F.col("f1_y_pred_cal") - F.col("f1_y_pred_base"), 9).alias("delta"))
    up = d.orderBy(F.desc("delta"), "user_id").limit(10).withColumn("side", F.lit("improved"))
    down = d.orderBy(F.asc("delta"), "user_id").limit(10).withColumn("side", F.lit("worsened"))
    return rounded(up.unionByName(down), 6)
