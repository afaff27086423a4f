"""Reports, replays and verdicts whose values SQL can repeat: JSON run reports to the mode comparison (S9, S7, A34), golden rows
and their replay by key (L9, M20, M21, M27), and the verdicts Q14 and Q16 on scorers made of counts."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import stats as S
from ..operators import train as T
from ..session import ensure_checkpoint_dir
from ..sources import io as IO
from . import deterministic as D
from . import evaluation as EV
from . import flow_weekly as FW
from . import intensity as I
from .registry import ORACLE, register, rounded
from .sqlfmt import summary_sql

TARGETS = ("spend", "net")
#: A quick run is fitted on the train rows whose hash begins with one of these, about a quarter of them.
QUICK = "0123"


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def run_scores(spark, sf_dir) -> DataFrame:
    """``(target, run_mode, model, y, p)``: the test rows under three scorers made of counts, fitted on all or a quarter of the train rows."""
    feats = FW.features_31(spark, sf_dir)[0]
    hashed = T.hash_order(["user_id", "week_start"])
    cells = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"bucket_{t}_t").cast("int").alias("now"), F.col(f"bucket_{t}_t_plus_1").cast("int").alias("y"))
                                for t in TARGETS]))
    rows = feats.select("is_test", hashed.substr(1, 1).alias("_h"), cells.alias("_c")).select("is_test", "_h", "_c.*")
    mode = F.explode(F.when(F.col("_h").isin(*QUICK), F.array(F.lit("full"), F.lit("quick"))).otherwise(F.array(F.lit("full"))))
    counts = rows.where("is_test = 0").select("target", "now", "y", mode.alias("run_mode")).groupBy("target", "run_mode", "now").agg(
        *[F.count(F.when(F.col("y") == c, 1)).alias(f"_c{c}") for c in D.CLASSES])
    whole = counts.groupBy("target", "run_mode").agg(*[F.sum(f"_c{c}").alias(f"_m{c}") for c in D.CLASSES])
    test = rows.where("is_test = 1").select("target", "now", "y").join(F.broadcast(whole), "target")        # a row per target and mode
    test = test.join(F.broadcast(counts), ["target", "run_mode", "now"], "left")                            # and per bucket
    said = {"persistence": F.col("now"), "majority": D._argmax([F.col(f"_m{c}") for c in D.CLASSES]),
            "transition": D._argmax([F.coalesce(f"_c{c}", F.lit(0)) for c in D.CLASSES])}
    models = F.explode(F.array(*[F.struct(F.lit(k).alias("model"), v.cast("int").alias("p")) for k, v in said.items()]))
    return test.select("target", "run_mode", "y", models.alias("_s")).select("target", "run_mode", "_s.model", "y", "_s.p")


_RUNS = EV._FLOW_TEST + """,
rx AS (SELECT is_test, substr(md5(user_id::VARCHAR || ':' || CAST(week_start AS DATE)::VARCHAR || ':42'), 1, 1) AS h, 'spend' AS target,
       bucket_spend_t AS now, bucket_spend_t_plus_1 AS y FROM ft
       UNION ALL SELECT is_test, substr(md5(user_id::VARCHAR || ':' || CAST(week_start AS DATE)::VARCHAR || ':42'), 1, 1), 'net', bucket_net_t, bucket_net_t_plus_1 FROM ft),
rc AS (SELECT target, m AS run_mode, now, """ + ", ".join(f"count(*) FILTER (y = {c}) AS c{c}" for c in D.CLASSES) + f"""
       FROM rx, (SELECT unnest(['full', 'quick']) AS m) WHERE is_test = 0 AND (m = 'full' OR contains('{QUICK}', h)) GROUP BY ALL),
rm AS (SELECT target, run_mode, """ + ", ".join(f"sum(c{c}) AS m{c}" for c in D.CLASSES) + """ FROM rc GROUP BY ALL),
rj AS (SELECT target, run_mode, y, now, """ + D._arg_sql([f"m{c}" for c in D.CLASSES]) + " AS maj, " + D._arg_sql([f"coalesce(c{c}, 0)" for c in D.CLASSES]) + """ AS tra
       FROM rx JOIN rm USING (target) LEFT JOIN rc USING (target, run_mode, now) WHERE is_test = 1),
rr AS (SELECT target || '|' || run_mode || '|persistence' AS run, y, now AS p FROM rj UNION ALL SELECT target || '|' || run_mode || '|majority', y, maj FROM rj
       UNION ALL SELECT target || '|' || run_mode || '|transition', y, tra FROM rj),
rs AS (SELECT split_part(run, '|', 1) AS target, split_part(run, '|', 2) AS run_mode, split_part(run, '|', 3) AS model, f1_macro, balanced_accuracy
       FROM """ + summary_sql("rr", "y", "p", M.LABELS, by="run") + """),
rg AS (SELECT s.*, (s.f1_macro - b.f1_macro) / greatest(b.f1_macro, 1e-9) AS gain FROM rs s
       JOIN rs b ON b.target = s.target AND b.run_mode = s.run_mode AND b.model = 'persistence' WHERE s.model <> 'persistence')"""


@register("A34_quick_vs_full", _RUNS + "\nSELECT target, model, " + ", ".join(
    f"round(any_value({c}) FILTER (run_mode = '{mode}'), 4) + 0.0 AS {m}_{mode}" for m, c in zip(M.MODE_METRICS, ("f1_macro", "balanced_accuracy", "gain")) for mode in ("full", "quick"))
    + ", round(any_value(f1_macro) FILTER (run_mode = 'full') - any_value(f1_macro) FILTER (run_mode = 'quick'), 4) + 0.0 AS f1_delta_full_minus_quick FROM rg GROUP BY target, model")
def a34q(spark, sf_dir):
    """One nested JSON report per target and run mode is written (S9), all are scanned (S7), flattened and pivoted."""
    scores = rounded(M.classification_summary(run_scores(spark, sf_dir), by=["target", "run_mode", "model"]), 6)
    report = scores.groupBy("target", "run_mode").pivot("model", ["persistence", "majority", "transition"]).agg(
        F.first(F.struct("f1_macro", "balanced_accuracy")))
    models = [c for c in report.columns if c not in ("target", "run_mode")]
    report = report.select("target", "run_mode", F.struct(*models).alias("test")).persist()       # a row per target and run mode
    top = _folder(spark, "reports")
    for t in TARGETS:
        for mode in ("full", "quick"):
            IO.sink_report(report.where((F.col("target") == t) & (F.col("run_mode") == mode)), f"{top}/{mode}_{t}")
    report.unpersist()
    return rounded(M.modes_pivot(IO.report_metrics(IO.scan_metrics(spark, f"{top}/*/*.json"))))


_GOLD = "md5(user_id::VARCHAR || ':' || CAST(week_start AS DATE)::VARCHAR || ':42')"


@register("L9_cap_rows", EV._FLOW_TEST + f"""
SELECT user_id, week_start, week_t, bucket_spend_t_plus_1 FROM ftr ORDER BY {_GOLD}, user_id, week_start LIMIT 500""")
def l9(spark, sf_dir):
    train = FW.features_31(spark, sf_dir)[0].where("is_test = 0")
    return T.cap_rows(train, 500, ["user_id", "week_start"]).select("user_id", "week_start", "week_t", "bucket_spend_t_plus_1")


def _golden(spark, sf_dir, n: int = 10) -> DataFrame:
    return T.cap_rows(D.scored(spark, sf_dir).where("is_test = 1"), n, ["user_id", "week_start"])


@register("M20_golden_sample_det", D._DET + f"""
SELECT user_id, week_start, week_t, y AS bucket_spend_t_plus_1, {", ".join(f"round(p{c}, 6) AS proba_class_{c}" for c in D.CLASSES)}, k AS predicted_class
FROM dt ORDER BY {_GOLD}, user_id, week_start LIMIT 10""")
def m20(spark, sf_dir):
    return rounded(_golden(spark, sf_dir).select(*D.KEYS, D.Y, *[f"proba_class_{c}" for c in D.CLASSES], "predicted_class"), 6)


@register("M21_golden_replay_det", D._DET + f""",
g AS (SELECT * FROM dt ORDER BY {_GOLD}, user_id, week_start LIMIT 200)
SELECT count(*) AS rows, 0::BIGINT AS unmatched, 1.0::DOUBLE AS match_rate, 0::BIGINT AS changed_probabilities FROM g""")
def m21(spark, sf_dir):
    """Golden predictions are stored as a table and met by key with predictions made anew."""
    path = _folder(spark, "golden")
    IO.sink_table(_golden(spark, sf_dir, 200), path)
    stored = IO.scan_stage(spark, path)
    again = D.scored(spark, sf_dir).join(F.broadcast(stored.select("user_id", "week_start")), ["user_id", "week_start"], "left_semi")     # 200 rows
    return T.replay(stored, again, ["user_id", "week_start"])


@register("M27_pick_users_det", D._DET + """,
us AS (SELECT DISTINCT user_id, user_total_history FROM ev),
lo AS (SELECT user_id FROM us ORDER BY user_total_history DESC, user_id LIMIT 3),
se AS (SELECT user_id FROM us WHERE user_id NOT IN (SELECT user_id FROM lo) ORDER BY md5(user_id::VARCHAR || ':42'), user_id LIMIT 3)
SELECT user_id, week_t, week_order, y_true, y_pred_base, y_pred_cal, y_pred_blend, update_count FROM ev
WHERE user_id IN (SELECT user_id FROM lo UNION ALL SELECT user_id FROM se)""")
def m27(spark, sf_dir):
    return picked_users(D.evaluated(spark, sf_dir))


def picked_users(ev: DataFrame, n: int = 3) -> DataFrame:
    """Rows of the ``n`` users with the longest history and of ``n`` others in hash order."""
    users = ev.select("user_id", "user_total_history").distinct()
    longest = users.orderBy(F.desc("user_total_history"), "user_id").limit(n)
    seeded = T.cap_rows(users.join(longest, "user_id", "left_anti"), n, ["user_id"])
    pick = longest.unionByName(seeded).select("user_id")
    return ev.join(F.broadcast(pick), "user_id", "left_semi").select(
        "user_id", "week_t", "week_order", "y_true", "y_pred_base", "y_pred_cal", "y_pred_blend", "update_count")


def _verdict_sql(gain: str, go: float, border: float) -> str:
    return f"CASE WHEN {gain} >= {go} THEN 'GO' WHEN {gain} >= {border} THEN 'BORDERLINE' ELSE 'NO_GO' END"


@register("Q16_feasibility_verdict_det", D._DET + """,
q AS (SELECT greatest((SELECT f1_macro FROM """ + summary_sql("dt", "y", "k", M.LABELS) + "), (SELECT f1_macro FROM " + summary_sql("dp", "y", "kq", M.LABELS)
    + ")) AS m, (SELECT f1_macro FROM " + summary_sql("dt", "y", "now", M.LABELS) + """) AS b,
  (SELECT least(avg(abs(outflow_rolling_mean_8w - target_spend_t_plus_1)), avg(abs(weekly_outflow_t_minus_1 - target_spend_t_plus_1))) FROM fte) AS r,
  (SELECT avg(abs(weekly_outflow_t - target_spend_t_plus_1)) FROM fte) AS n)
SELECT round(m - b, 4) + 0.0 AS classification_gain, """ + _verdict_sql("m - b", 0.03, 0.01) + """ AS classification_verdict,
  round((n - r) / greatest(n, 1e-9), 4) + 0.0 AS regression_gain, """ + _verdict_sql("(n - r) / greatest(n, 1e-9)", 0.05, 0.01) + " AS regression_verdict FROM q")
def q16(spark, sf_dir):
    """The verdict plan over the count-made classifiers and two naive regressors of the weekly spend."""
    test = D.scored(spark, sf_dir).where("is_test = 1")
    models = M.classification_summary(test, D.Y, "predicted_class").unionByName(M.classification_summary(D.prior(spark, sf_dir), D.Y, "predicted_class"))
    rows = FW.features_31(spark, sf_dir)[0].where("is_test = 1")
    errors = {c: M.regression_metrics(rows, "target_spend_t_plus_1", c) for c in ("outflow_rolling_mean_8w", "weekly_outflow_t_minus_1", "weekly_outflow_t")}
    naive = errors.pop("weekly_outflow_t")
    return rounded(M.feasibility_verdict(rounded(models, 6), rounded(M.classification_summary(test, D.Y, D.NOW), 6),
                                         reduce(DataFrame.unionByName, errors.values()), naive))


@register("Q14_intensity_verdict_det", "WITH mf0 AS (" + ORACLE["L15_model_frame"] + """),
te14 AS (SELECT bucket, prev_bucket_1, (SELECT bucket FROM mf0 WHERE is_test = 0 GROUP BY bucket ORDER BY count(*) DESC, bucket LIMIT 1) AS majority
         FROM mf0 WHERE is_test = 1),
q AS (SELECT (SELECT any_value(mean_value) FILTER (bucket = 2) / nullif(any_value(mean_value) FILTER (bucket = 1), 0) FROM (""" + ORACLE["A23_class_distribution"] + """)) AS s,
  (SELECT f1_weighted FROM """ + summary_sql("te14", "bucket", "prev_bucket_1", M.LABELS) + ") AS m, (SELECT f1_weighted FROM "
    + summary_sql("te14", "bucket", "majority", M.LABELS) + ") AS b, (SELECT max(spearman) FROM (" + ORACLE["Q6_spearman"] + """) WHERE scope <> 'global') AS k),
c AS (SELECT *, coalesce(s >= 2.0, false)::INT + coalesce(b > 0 AND m >= b * 1.10, false)::INT + coalesce(k >= 0.15, false)::INT AS n FROM q)
SELECT round(s, 4) + 0.0 AS class_separation_ratio_c2_c1, round(m, 4) + 0.0 AS model_f1_weighted, round(b, 4) + 0.0 AS baseline_f1_weighted,
  round(k, 4) + 0.0 AS best_category_spearman, n AS criteria_passed, CASE WHEN n >= 2 THEN 'GO' ELSE 'NO GO' END AS verdict FROM c""")
def q14(spark, sf_dir):
    """The verdict plan with yesterday's bucket in the model's place."""
    mf = I.model_frame(spark, sf_dir)
    majority = M.majority_class(mf.where("is_test = 0"), "bucket").select(F.col("bucket").alias("_majority"))
    te = mf.where("is_test = 1").select("bucket", "prev_bucket_1").crossJoin(F.broadcast(majority))         # one row
    g, _ = I.bucketed(spark, sf_dir)
    ranks = S.spearman(I.transitions(spark, sf_dir).where(F.col("category").isin(*I.FOCUS)), "bucket", "bucket_t_plus_7", by="category")
    return rounded(M.intensity_verdict(rounded(I.B.class_distribution(g, "bucket", "target_7d_sum")), rounded(M.classification_summary(te, "bucket", "prev_bucket_1"), 6),
                                       rounded(M.classification_summary(te, "bucket", "_majority"), 6), rounded(ranks, 6)))
