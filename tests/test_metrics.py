"""Evaluation operators on hand-computed cases."""

from spendlens.operators import metrics as M
from pyspark.sql import functions as F


def test_macro_f1_variants_and_balanced_accuracy(spark):
    # class 3 absent in truth, present in prediction
    pairs = [(0, 0), (0, 0), (0, 1), (1, 1), (1, 1), (2, 2), (2, 3), (1, 0)]
    df = spark.createDataFrame(pairs, "y int, p int")
    r = M.classification_summary(df, "y", "p").first()
    f1 = {0: 2 * 2 / (3 + 3), 1: 2 * 2 / (3 + 3), 2: 2 * 1 / (2 + 1), 3: 0.0}
    assert abs(r["f1_macro"] - sum(f1.values()) / 4) < 1e-12            # labels present in y or p: 0..3
    assert abs(r["f1_macro_fixed"] - sum(f1.values()) / 4) < 1e-12
    assert abs(r["accuracy"] - 5 / 8) < 1e-12
    assert abs(r["balanced_accuracy"] - (2 / 3 + 2 / 3 + 1 / 2) / 3) < 1e-12
    df2 = spark.createDataFrame([(0, 0), (1, 0), (1, 1)], "y int, p int")
    r2 = M.classification_summary(df2, "y", "p").first()
    assert abs(r2["f1_macro"] - r2["f1_macro_fixed"] * 2) < 1e-12       # fixed 0-3 halves it


def test_per_class_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    rows = {r["label"]: r for r in M.per_class_prf(df, "y", "p").collect()}
    assert rows[0]["f1"] == 1.0 and rows[1]["precision"] == 0.0 and rows[1]["support"] == 0


def test_majority_tie_breaks_low_label(spark):
    df = spark.createDataFrame([(2,), (1,), (2,), (1,)], "y int")
    assert M.majority_class(df, "y").first()["y"] == 1


def test_stability_and_spread(spark):
    fm = spark.createDataFrame([("m", i, v) for i, v in enumerate([0.6, 0.6, 0.5, 0.5, 0.5], 1)],
                               "model string, fold int, f1_macro double")
    s = M.stability(fm, "f1_macro", ["model"]).first()
    assert abs(s["relative_drop"] - (0.6 - 0.5) / 0.6) < 1e-12 and s["stability"] == "degraded"
    sp = M.fold_spread(fm, "f1_macro", ["model"]).first()
    assert abs(sp["first_to_last_drop"] - 0.1) < 1e-12


def test_regression_metrics_mape_only_positive(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "y double, p double")
    r = M.regression_metrics(df, "y", "p").first()
    assert r["mae"] == 1.0 and r["mape"] == 0.5


def test_dataset_verdict_reaches_every_branch(spark):
    from spendlens.operators import card_features as C

    def said(status="PASS", rate=0.9, valid=200, both=190, shift=3.0, f1=0.4):
        one = lambda **v: spark.range(0, 1, 1, 1).select(*[F.lit(x).alias(k) for k, x in v.items()])
        r = C.dataset_verdict(one(status=status), one(retention_rate=rate, valid_users_count=valid), one(overlapping_users=both),
                              one(max_shift_pp=shift), one(f1_macro=f1)).first()
        return r["failed_checks"], r["verdict"]

    assert said() == (0, "GO") and said(f1=0.25) == (1, "BORDERLINE") and said(shift=15.0, both=159) == (2, "BORDERLINE")
    assert said(shift=20.0, both=1, rate=0.4) == (3, "NO_GO") and said(status="FAIL") == (1, "NO_GO") and said(valid=99, both=99) == (0, "NO_GO")


def test_largest_shift_of_shares(spark):
    from spendlens.operators import card_features as C
    rows = [("train", 0)] * 3 + [("train", 2)] + [("test", 0)] + [("test", 3)] * 3 + [("test", None)]
    df = spark.createDataFrame(rows, "split string, bucket int")
    assert C.largest_shift(df).first()["max_shift_pp"] == 75.0
    assert C.largest_shift(df.where("split = 'train'")).first()["max_shift_pp"] is None
