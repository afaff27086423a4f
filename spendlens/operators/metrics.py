"""Evaluation operators.

Classification metrics are derived from the (y, p) count table, which has at
most labels^2 rows however many predictions are scored: one distributed
``groupBy(y, p).count()`` with map-side combine, then per-label algebra.
F1 uses 2tp / (support + predicted), zero when undefined (scikit-learn's
zero_division=0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import count_if
from .ordering import exact_quantiles

LABELS = [0, 1, 2, 3]


def confusion(df: DataFrame, y: str = "y", p: str = "p", labels=LABELS, by: list[str] | None = None) -> DataFrame:
    """M1: counts for every (true, predicted) label pair, zero filled, long form."""
    by = by or []
    aggs = [count_if((F.col(y) == a) & (F.col(p) == b)).alias(f"_c{a}_{b}") for a in labels for b in labels]
    one = df.groupBy(*by).agg(*aggs)
    cells = F.array(*[F.struct(F.lit(a).alias("y_true"), F.lit(b).alias("y_pred"), F.col(f"_c{a}_{b}").alias("n"))
                      for a in labels for b in labels])
    return one.select(*by, F.explode(cells).alias("c")).select(*by, "c.*")


def per_label_counts(df: DataFrame, y: str = "y", p: str = "p", labels=LABELS, by: list[str] | None = None) -> DataFrame:
    """tp, support and predicted per label (one aggregate, stacked)."""
    by = by or []
    aggs = []
    for c in labels:
        aggs += [count_if((F.col(y) == c) & (F.col(p) == c)).alias(f"_tp{c}"),
                 count_if(F.col(y) == c).alias(f"_s{c}"), count_if(F.col(p) == c).alias(f"_p{c}")]
    one = df.groupBy(*by).agg(*aggs, F.count(F.lit(1)).alias("_n"))
    rows = F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"_tp{c}").alias("tp"), F.col(f"_s{c}").alias("support"),
                              F.col(f"_p{c}").alias("predicted")) for c in labels])
    return one.select(*by, "_n", F.explode(rows).alias("r")).select(*by, "_n", "r.*")


def per_class_prf(df: DataFrame, y: str = "y", p: str = "p", labels=LABELS, by: list[str] | None = None) -> DataFrame:
    """M2: precision, recall, F1, support per label; 0/0 -> 0."""
    by = by or []
    c = per_label_counts(df, y, p, labels, by)
    z = F.lit(0.0)
    return c.select(
        *by, "label",
        F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted")), z).alias("precision"),
        F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), z).alias("recall"),
        F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("predicted")), z).alias("f1"),
        F.col("support"))


def classification_summary(df: DataFrame, y: str = "y", p: str = "p", labels=LABELS,
                           by: list[str] | None = None) -> DataFrame:
    """M3-M5: macro F1 over labels present in y or p, macro F1 over the fixed label list,
    support-weighted F1, accuracy and balanced accuracy (mean recall over labels in y)."""
    by = by or []
    return _summary(per_label_counts(df, y, p, labels, by), by)


def _summary(c: DataFrame, by: list[str]) -> DataFrame:
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0))
    rec = F.try_divide(F.col("tp").cast("double"), F.col("support"))
    present = (F.col("support") + F.col("predicted")) > 0
    return c.groupBy(*by).agg(
        F.first("_n").alias("n_rows"),
        F.avg(F.when(present, f1)).alias("f1_macro"),
        F.avg(f1).alias("f1_macro_fixed"),
        F.try_divide(F.sum(f1 * F.col("support")), F.sum("support")).alias("f1_weighted"),
        F.try_divide(F.sum("tp").cast("double"), F.first("_n")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, rec)).alias("balanced_accuracy"),
    )


def summary_of_counts(counts: DataFrame, by: list[str], labels=LABELS) -> DataFrame:
    """M3-M5 from confusion counts ``(by..., y_true, y_pred, n)`` in place of rows."""
    aggs = []
    for c in labels:
        y, p = F.col("y_true") == c, F.col("y_pred") == c
        aggs += [F.coalesce(F.sum(F.when(k, F.col("n"))), F.lit(0)).alias(f"_{name}{c}") for name, k in (("tp", y & p), ("s", y), ("p", p))]
    one = counts.groupBy(*by).agg(*aggs, F.sum("n").alias("_n"))
    rows = F.array(*[F.struct(F.col(f"_tp{c}").alias("tp"), F.col(f"_s{c}").alias("support"), F.col(f"_p{c}").alias("predicted")) for c in labels])
    return _summary(one.select(*by, "_n", F.explode(rows).alias("r")).select(*by, "_n", "r.*"), by)


def fold_summary(oof: DataFrame) -> DataFrame:
    """Period and metrics by fold and model from out-of-fold predictions ``(fold, model, week_start, y, p)``."""
    keys = ["fold", "model"]
    period = oof.groupBy(*keys).agg(F.min("week_start").alias("test_start_week"), F.max("week_start").alias("test_end_week"))
    return classification_summary(oof, by=keys).join(period, keys)


def majority_class(train: DataFrame, y: str) -> DataFrame:
    """M7: most frequent class, lowest label on ties (one row)."""
    return train.groupBy(y).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(y)).limit(1)


def regression_metrics(df: DataFrame, y: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """M8: MAE, RMSE, MAPE over y > 0 (NULL when none)."""
    by = by or []
    e = F.col(pred) - F.col(y)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.when(F.col(y) > 0, F.abs(e) / F.col(y))).alias("mape"))


def stability(fold_metrics: DataFrame, metric: str, by: list[str], fold: str = "fold",
              higher_is_better: bool = True) -> DataFrame:
    """(mean of first two folds - mean of last two) / |first|; > 10 % -> degraded;
    fewer than 3 folds -> insufficient.  For errors (lower is better) the sign flips."""
    w1 = Window.partitionBy(*by).orderBy(F.asc(fold))
    w2 = Window.partitionBy(*by).orderBy(F.desc(fold))
    r = fold_metrics.select(*by, F.col(metric).alias("_m"), F.row_number().over(w1).alias("_a"),
                            F.row_number().over(w2).alias("_b"))
    g = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n_folds"), F.avg(F.when(F.col("_a") <= 2, F.col("_m"))).alias("first2"),
                           F.avg(F.when(F.col("_b") <= 2, F.col("_m"))).alias("last2"))
    drop = F.try_divide(F.col("first2") - F.col("last2"), F.abs(F.col("first2")))
    if not higher_is_better:
        drop = -drop
    return g.withColumn("relative_drop", drop).withColumn(
        "stability", F.when(F.col("n_folds") < 3, "insufficient_folds").when(drop > 0.10, "degraded").otherwise("stable"))


def fold_spread(fold_metrics: DataFrame, metric: str, by: list[str], fold: str = "fold") -> DataFrame:
    """Mean, population std and first-to-last drop of a metric over folds."""
    first = F.min_by(F.col(metric), F.col(fold))
    last = F.max_by(F.col(metric), F.col(fold))
    return fold_metrics.groupBy(*by).agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"),
                                         (first - last).alias("first_to_last_drop"))


def acceptance_gain(model_score, baseline_score, higher_is_better: bool = True) -> dict:
    """M14 columns: relative gain versus the persistence baseline and the 50 % / 70 % flags."""
    gain = F.try_divide(model_score - baseline_score, F.abs(baseline_score))
    if not higher_is_better:
        gain = F.try_divide(baseline_score - model_score, F.abs(baseline_score))
    return {"relative_gain": gain, "gain_ge_50pct": gain >= 0.5, "gain_ge_70pct": gain >= 0.7}


def leaderboard(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rank runs by F1 desc, balanced accuracy desc, relative drop asc; rank 1 wins."""
    by = by or []
    w = Window.partitionBy(*by).orderBy(F.desc("f1_macro"), F.desc("balanced_accuracy"),
                                        F.asc_nulls_last("relative_drop"), F.asc("run"))
    return metrics.withColumn("rank", F.row_number().over(w))


MODE_METRICS = ("f1_macro", "balanced_accuracy", "relative_gain_vs_persistence")


def modes_pivot(rows: DataFrame, baseline: str = "persistence", modes=("full", "quick")) -> DataFrame:
    """``(target, run_mode, model, f1_macro, balanced_accuracy)`` -> one row per target and model with each metric by run
    mode, and the F1 that the full run has over the quick one.  Gains are relative to the baseline of the same report."""
    base = rows.where(F.col("model") == baseline).select("target", "run_mode", F.col("f1_macro").alias("_base"))
    gain = (F.col("f1_macro") - F.col("_base")) / F.greatest(F.col("_base"), F.lit(1e-9))
    j = rows.where(F.col("model") != baseline).join(base, ["target", "run_mode"]).withColumn("relative_gain_vs_persistence", gain)
    wide = j.groupBy("target", "model").pivot("run_mode", list(modes)).agg(*[F.first(m).alias(m) for m in MODE_METRICS])
    out = wide.select("target", "model", *[F.col(f"{mode}_{m}").alias(f"{m}_{mode}") for m in MODE_METRICS for mode in modes])
    return out.withColumn("f1_delta_full_minus_quick", F.col("f1_macro_full") - F.col("f1_macro_quick"))


def _graded(gain, go: float, border: float):
    return F.when(gain >= go, "GO").when(gain >= border, "BORDERLINE").otherwise("NO_GO")


def feasibility_verdict(models: DataFrame, baseline: DataFrame, regressors: DataFrame, naive: DataFrame) -> DataFrame:
    """Q16 as one plan: best ``f1_macro`` of ``models`` over the baseline's, and least ``mae`` of ``regressors`` under the naive one's.

    ``baseline`` and ``naive`` are one-row frames, the others aggregate to one row.
    """
    one = (models.agg(F.max("f1_macro").alias("_m")).crossJoin(baseline.select(F.col("f1_macro").alias("_b")))
           .crossJoin(regressors.agg(F.min("mae").alias("_r"))).crossJoin(naive.select(F.col("mae").alias("_n"))))
    c, r = F.col("_m") - F.col("_b"), (F.col("_n") - F.col("_r")) / F.greatest(F.col("_n"), F.lit(1e-9))
    return one.select(c.alias("classification_gain"), _graded(c, 0.03, 0.01).alias("classification_verdict"),
                      r.alias("regression_gain"), _graded(r, 0.05, 0.01).alias("regression_verdict"))


def intensity_verdict(distribution: DataFrame, model: DataFrame, baseline: DataFrame, correlations: DataFrame) -> DataFrame:
    """Q14 as one plan: class means two times apart, weighted F1 a tenth over the baseline, best rank correlation of 0.15; GO with two."""
    means = distribution.agg(F.max(F.when(F.col("bucket") == 1, F.col("mean_value"))).alias("_c1"), F.max(F.when(F.col("bucket") == 2, F.col("mean_value"))).alias("_c2"))
    one = (means.crossJoin(model.select(F.col("f1_weighted").alias("_m"))).crossJoin(baseline.select(F.col("f1_weighted").alias("_b")))
           .crossJoin(correlations.agg(F.max("spearman").alias("_s"))))
    ratio = F.try_divide(F.col("_c2"), F.col("_c1"))
    passed = sum((F.coalesce(k, F.lit(False)).cast("int") for k in (ratio >= 2.0, (F.col("_b") > 0) & (F.col("_m") >= F.col("_b") * 1.10), F.col("_s") >= 0.15)), F.lit(0))
    return one.select(ratio.alias("class_separation_ratio_c2_c1"), F.col("_m").alias("model_f1_weighted"), F.col("_b").alias("baseline_f1_weighted"),
                      F.col("_s").alias("best_category_spearman"), passed.alias("criteria_passed")).withColumn(
        "verdict", F.when(F.col("criteria_passed") >= 2, "GO").otherwise("NO GO"))


def slice_accuracy(df: DataFrame, y: str, preds: list[str], base: str) -> DataFrame:
    """Accuracy of each predictor on transition rows (y != base) and stable rows."""
    return df.groupBy((F.col(y) != F.col(base)).alias("was_transition")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.avg((F.col(p) == F.col(y)).cast("double")).alias(f"acc_{p}") for p in preds])


def confidence_curve(df: DataFrame, y: str, pred: str, confidence: str) -> DataFrame:
    """Rows and accuracy per confidence bin, zero for empty bins (B6 edges)."""
    from ..functions.buckets import CONFIDENCE_EDGES
    edges = CONFIDENCE_EDGES
    aggs = []
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        inb = (F.col(confidence) >= lo) & (F.col(confidence) < hi)
        aggs += [count_if(inb).alias(f"_n{i}"), count_if(inb & (F.col(y) == F.col(pred))).alias(f"_k{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(lo).alias("bin_lo"), F.lit(hi).alias("bin_hi"), F.col(f"_n{i}").alias("n"),
                              F.coalesce(F.try_divide(F.col(f"_k{i}").cast("double"), F.col(f"_n{i}")), F.lit(0.0)).alias("accuracy"))
                     for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:]))])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def per_user_f1(df: DataFrame, user: str, y: str, preds: list[str], labels=LABELS) -> DataFrame:
    """M22 input: fixed-label macro F1 per user for each predictor (4 x 3 conditional sums each)."""
    aggs = []
    for pr in preds:
        for c in labels:
            aggs += [count_if((F.col(y) == c) & (F.col(pr) == c)).alias(f"_{pr}_tp{c}"),
                     count_if(F.col(y) == c).alias(f"_{pr}_s{c}"), count_if(F.col(pr) == c).alias(f"_{pr}_p{c}")]
    g = df.groupBy(user).agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
    cols = [user, "n_rows"]
    for pr in preds:
        f1s = [F.coalesce(F.try_divide(2.0 * F.col(f"_{pr}_tp{c}"), F.col(f"_{pr}_s{c}") + F.col(f"_{pr}_p{c}")), F.lit(0.0))
               for c in labels]
        tot = f1s[0]
        for x in f1s[1:]:
            tot = tot + x
        cols.append((tot / len(labels)).alias(f"f1_{pr}"))
    return g.select(*cols)


def per_user_delta_summary(pu: DataFrame, a: str, b: str, tol: float = 1e-12) -> DataFrame:
    """Improved / worsened / unchanged users (|delta| <= tol) and delta deciles."""
    d = F.col(b) - F.col(a)
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    found = exact_quantiles(pu.select(d.alias("delta")), "delta", probs)
    return pu.agg(count_if(d > tol).alias("users_improved"), count_if(d < -tol).alias("users_worsened"),
                  count_if(F.abs(d) <= tol).alias("users_unchanged"),
                  *[F.lit(v).cast("double").alias(f"delta_p{int(q * 100)}") for q, v in zip(probs, found)])
