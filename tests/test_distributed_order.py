"""Two-level prefix sums, exact quantiles, KS and expanding folds against brute force."""

import datetime
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from spendlens.operators import bucketing as B
from spendlens.operators import ordering as O
from spendlens.operators import stats as S


def test_exact_quantiles_linear_interpolation(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    assert O.exact_quantiles(df, "v", [0.25]) == [1.75]


def test_exact_quantiles_random_vs_numpy(spark):
    rnd = random.Random(11)
    vals = [round(rnd.uniform(-50, 500), 2) for _ in range(3000)] + [7.0] * 400
    df = spark.createDataFrame([(v, v * 2) for v in vals], "a double, b double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = O.exact_quantiles_multi(df, ["a", "b"], probs, n_buckets=7)
    assert np.allclose(got["a"], np.quantile(vals, probs))
    assert np.allclose(got["b"], np.quantile([2 * v for v in vals], probs))


def test_prefix_sum_is_global_row_index(spark):
    rnd = random.Random(5)
    pdf = pd.DataFrame({"week": [rnd.randint(0, 30) for _ in range(500)], "user": list(range(500))})
    df = spark.createDataFrame(pdf)
    got = O.with_prefix_sum(df, [], "week", ["user"], out="i", n_buckets=5).toPandas()
    ref = pdf.sort_values(["week", "user"]).reset_index(drop=True)
    ref["i"] = range(len(ref))
    m = got.merge(ref, on=["week", "user"])
    assert (m["i_x"] == m["i_y"]).all()


def test_date_quantile(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (1, 2, 3, 10)], "d date")
    q = B.date_quantile(df, "d", 0.25)
    assert abs(q - (dt.date(2024, 1, 1) - dt.date(1970, 1, 1)).days - 0.75) < 1e-9


def test_ks_statistic_vs_ecdf(spark):
    rnd = random.Random(2)
    a = [rnd.randint(0, 40) for _ in range(700)]
    b = [rnd.randint(5, 45) for _ in range(500)]
    pdf = pd.DataFrame({"split": ["a"] * len(a) + ["b"] * len(b), "x": a + b})
    got = S.ks_two_sample_multi(spark.createDataFrame(pdf), "split", "a", "b", ["x"], n_buckets=4).first()["ks_statistic"]
    grid = np.unique(a + b)
    fa = np.searchsorted(np.sort(a), grid, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), grid, side="right") / len(b)
    assert abs(got - np.max(np.abs(fa - fb))) < 1e-12


def test_expanding_folds_layout(spark):
    n = 379
    pdf = pd.DataFrame({"week": [i // 13 for i in range(n)], "user": [i % 13 for i in range(n)]})
    fx = B.expanding_folds(spark.createDataFrame(pdf), ["week", "user"], 5).toPandas()
    size = n // 6
    start = n - 5 * size
    for i in range(1, 6):
        idx = sorted(fx.loc[fx["test_fold"] == i, "row_index"])
        assert idx == list(range(start + (i - 1) * size, start + i * size))
    assert fx["test_fold"].isna().sum() == start


def test_tune_thresholds_matches_exhaustive(spark):
    rnd = random.Random(9)
    ys = [0.0 if rnd.random() < 0.15 else round(rnd.expovariate(1 / 50), 2) for _ in range(4000)]
    df = spark.createDataFrame([(y,) for y in ys], "y double")
    thr = B.tune_thresholds(df, "y")
    pos = pd.Series([y for y in ys if y > 0])
    q25, q75 = pos.quantile(0.25), pos.quantile(0.75)
    assert abs(thr["low"] - q25) < 1e-9 and abs(thr["high"] - q75) < 1e-9 and thr["mode"] == "default"


def test_chi2_yates_only_at_one_dof(spark):
    from spendlens.operators.card_features import chi2_bucket_shift
    a = spark.createDataFrame([(0,)] * 30 + [(1,)] * 10, "bucket int")
    b = spark.createDataFrame([(0,)] * 20 + [(1,)] * 20, "bucket int")
    r = chi2_bucket_shift(a, b).first()
    # 2x2 table with Yates: sum((|o-e|-0.5)^2/e)
    exp = [(30, 25), (10, 15), (20, 25), (20, 15)]
    ref = sum((abs(o - e) - 0.5) ** 2 / e for o, e in exp)
    assert abs(r["chi2"] - ref) < 1e-9 and r["dof"] == 1
    assert 0 < r["p_value"] < 0.05


def test_one_hot_week_is_cut_by_the_second_key(spark):
    rows = [(1, u) for u in range(990)] + [(2, u) for u in range(10)]
    df = spark.createDataFrame(rows, "week int, user int")
    dealt = O.range_buckets(df, ["week", "user"], 8)
    assert dealt.where("week = 1").select("_bkt").distinct().count() > 3
    got = {(r["week"], r["user"]): r["i"] for r in O.with_prefix_sum(df, [], "week", ["user"], out="i", n_buckets=8).collect()}
    assert all(got[r] == i for i, r in enumerate(rows))


def test_quantiles_by_group_with_nulls(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, float("nan"), rnd.uniform(0, 9)])) for _ in range(400)] + [("void", None)]
    got = {r["g"]: r["q"] for r in O.quantile_table(spark.createDataFrame(rows, "g string, v double"), ["v"], [0.1, 0.5], by=["g"]).collect()}
    assert set(got) == {"a", "b", None}
    for g, q in got.items():
        assert np.allclose(q, np.quantile([v for k, v in rows if k == g and v is not None and v == v], [0.1, 0.5]))


def test_spearman_beyond_the_former_limit(spark):
    n = 100_500
    df = spark.range(n).select(F.col("id").alias("a"), F.when(F.col("id") < n - 1, F.col("id")).otherwise(-1).alias("b"))
    r = S.spearman(df, "a", "b").first()
    assert r["n_pairs"] == n and 0.9999 < r["spearman"] < 1
    assert S.spearman(df.limit(2), "a", "b").first()["spearman"] is None


def test_spearman_with_ties_against_pandas(spark):
    rnd = random.Random(3)
    pdf = pd.DataFrame({"g": [rnd.choice("xy") for _ in range(300)], "a": [rnd.randint(0, 5) for _ in range(300)],
                        "b": [rnd.randint(0, 4) for _ in range(300)]})
    got = {r["g"]: r["spearman"] for r in S.spearman(spark.createDataFrame(pdf), "a", "b", by="g").collect()}
    for g, part in pdf.groupby("g"):
        assert abs(got[g] - part["a"].rank().corr(part["b"].rank())) < 1e-12


def test_folds_by_keys_equal_those_by_index_and_leave_rows_in_place(spark):
    rnd = random.Random(4)
    rows = [(datetime.date(2024, 1, 1) + datetime.timedelta(weeks=int(rnd.random() ** 3 * 9)), u) for u in range(400)]
    df = spark.createDataFrame([*rows, (None, 1), (None, 2)], "week date, user long").repartition(7)
    for n_splits in (1, 3, 5):
        a = B.expanding_folds(df, ["week", "user"], n_splits).drop("row_index")
        b = B.expanding_folds(df, ["week", "user"], n_splits, index=False)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
        # No row is shuffled for its fold.
        assert "Window" not in b._jdf.queryExecution().optimizedPlan().toString()
    few = B.expanding_folds(df.limit(3), ["week", "user"], 5, index=False).collect()
    assert [r["test_fold"] for r in few] == [None] * 3 and {r["test_size"] for r in few} == {0}
