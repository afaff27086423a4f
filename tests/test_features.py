"""Grid, bucketing, as-of and leakage properties."""

import datetime as dt

from pyspark.sql import functions as F

from spendlens.operators import bucketing as B
from spendlens.operators import card_features as C
from spendlens.operators import flow_features as FF
from spendlens.operators.grid import daily_grid_full, daily_grid_observed
from spendlens.sources.tables import tx_flow


def test_grid_rows_are_pairs_times_days(spark):
    tx = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.0, "x"), ("a", dt.date(2024, 1, 5), 2.0, "y"),
                                ("b", dt.date(2024, 1, 3), 3.0, "x"), ("b", dt.date(2024, 1, 3), 4.0, "x")],
                               "user_id string, event_date date, amount double, category string")
    obs = daily_grid_observed(tx)
    full = daily_grid_full(tx)
    assert obs.count() == 3 * 5 and full.count() == 2 * 2 * 5
    assert obs.where((F.col("user_id") == "b") & (F.col("event_date") == dt.date(2024, 1, 3))).first()["amount"] == 7.0
    assert full.where("user_id = 'b' AND category = 'y'").agg(F.sum("amount")).first()[0] == 0.0


def test_recency_is_strictly_before_monday(spark):
    rows = spark.createDataFrame([("u", dt.date(2024, 1, 8)), ("u", dt.date(2024, 1, 15)), ("v", dt.date(2024, 1, 8))],
                                 "user_id string, week_monday date")
    tx = spark.createDataFrame([("u", dt.date(2024, 1, 8)), ("u", dt.date(2024, 1, 3))], "user_id string, event_date date")
    got = {(r["user_id"], r["week_monday"]): r["recency_days"] for r in C.recency_asof(rows, tx).collect()}
    assert got[("u", dt.date(2024, 1, 8))] == 5.0      # the Monday's own transaction is not counted
    assert got[("u", dt.date(2024, 1, 15))] == 7.0
    assert got[("v", dt.date(2024, 1, 8))] == 180.0


def test_user_thresholds_fallback_and_widening(spark):
    train = spark.createDataFrame([("a", 5.0)] * 4 + [("b", 1.0), ("b", 2.0)] + [("c", float(i)) for i in range(8)],
                                  "user_id string, v double")
    thr, glob = B.user_quantile_thresholds(train, "v")
    t = {r["user_id"]: r for r in thr.collect()}
    assert t["a"]["q25"] == 5.0 - 0.05 and t["a"]["q75"] == 5.0 + 0.05   # equal pair widened by 1 %
    assert t["b"]["fallback"] and (t["b"]["q25"], t["b"]["q75"]) == glob
    df = spark.createDataFrame([("a", 4.0), ("zz", -3.0)], "user_id string, v double")
    out = {r["user_id"]: r["b"] for r in B.apply_user_buckets(df, thr, glob, "v", "b").collect()}
    assert out == {"a": 1, "zz": 1}


def test_weekly_features_do_not_leak(spark):
    """Changing transactions after week t leaves every feature at or before t unchanged."""
    tx = tx_flow(spark, "/root/testdata/sf0.001").cache()
    weekly = FF.weekly_flows(tx)
    split = FF.holdout_split_week(weekly, 12)
    thr = FF.train_thresholds(weekly, split)
    cut = dt.date(1998, 1, 5)
    a = FF.weekly_features_31(weekly, split, thr)
    tx2 = tx.withColumn("amount_abs", F.when(F.col("transaction_date") >= F.lit(cut), F.col("amount_abs") * 3)
                        .otherwise(F.col("amount_abs")))
    b = FF.weekly_features_31(FF.weekly_flows(tx2), split, thr)
    cols = [c for c in FF.FLOW_FEATURES_31 if c != "bucket_spend_t" and c != "bucket_net_t"]
    ka = a.where(F.col("week_start") < F.lit(cut)).select("user_id", "week_start", *cols)
    kb = b.where(F.col("week_start") < F.lit(cut)).select("user_id", "week_start", *cols)
    assert ka.exceptAll(kb).count() == 0


def test_contract_checks(spark):
    import pytest
    from spendlens.operators import checks as K
    df = spark.createDataFrame([(1, 0, 0.5), (2, 3, 1.5), (2, 5, None)], "k int, b int, r double")
    res = K.check_frame(df, no_null=["r"], ranges={"r": (0, 1)}, keys=["k"], labels=("b", [0, 1, 2, 3]))
    assert res == {"rows": 3, "null__r": 1, "range__r": 1, "label__b": 1, "duplicate_keys": 1}
    with pytest.raises(K.ContractError):
        K.assert_frame(df, no_null=["r"])
    assert K.schema_diff(["a", "c"], ["a", "b"]) == {"missing": ["b"], "extra": ["c"]}
    with pytest.raises(K.ContractError):
        K.assert_schema(df, ["k", "r", "b"])


def test_tfidf_collapse_rules(spark):
    from spendlens.operators.categories import collapse_categories
    two = spark.createDataFrame([("coffee bar",), ("gas station",), ("coffee bar",)], "raw_category string")
    out = collapse_categories(two, "tfidf", n_clusters=15)
    assert sorted(r["category"] for r in out.collect()) == ["coffee bar", "coffee bar", "gas station"]
    names = ["coffee bar", "coffee shop", "gas station", "gas stop", "city hotel", "hotel city", "coffee bar"]
    df = spark.createDataFrame([(n,) for n in names], "raw_category string")
    got = {r["raw_category"]: r["category"] for r in collapse_categories(df, "tfidf", n_clusters=3).collect()}
    assert all(v.startswith("cluster_") and len(v) == 10 for v in got.values())
    assert len(set(got.values())) <= 3


def test_full_grid_beyond_the_former_category_limit(spark):
    import datetime as dt
    from pyspark.sql import functions as F
    tx = spark.range(10_050).select(F.lit(1).alias("user_id"), F.concat(F.lit("c"), F.col("id")).alias("category"),
                                    F.lit(dt.date(2024, 1, 1)).alias("event_date"), F.lit(2.0).alias("amount"))
    from spendlens.operators.grid import daily_grid_full
    r = daily_grid_full(tx).agg(F.count("*"), F.sum("amount")).first()
    assert tuple(r) == (10_050, 20_100.0)


def test_user_stats_fail_or_exclude(spark):
    import pytest
    from spendlens.operators import card_features as C
    lag = spark.createDataFrame([(1, "w"), (2, "w"), (2, "x")], "user_id long, week_t string")
    stats = spark.createDataFrame([(1, 3.0)], "user_id long, user_mean_amount double")
    with pytest.raises(RuntimeError, match="2 rows"):
        C.attach_user_stats(lag, stats)
    assert C.attach_user_stats(lag, stats, missing="exclude").count() == 1
    assert C.rows_without_stats(lag, stats).count() == 2


def test_word_grams_of_short_words(spark):
    from spendlens.operators.categories import word_grams
    from pyspark.sql import functions as F
    got = spark.createDataFrame([("A at  cat",)], "t string").select(word_grams(F.col("t")).alias("g")).first()["g"]
    assert sorted(got) == sorted([" a ", " at", "at ", " at ", " ca", "cat", "at ", " cat", "cat ", " cat "])


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def _exchanges_above_explode(df):
    """Exchanges of the physical plan that stand above the node which lays out the days."""
    lines = _plan(df)[1].split("== Initial Plan ==")[-1].split("\n")
    at = next(i for i, x in enumerate(lines) if "Generate posexplode" in x)
    return [x for x in lines[:at] if "Exchange" in x]


def _random_tx(spark, seed=0):
    import datetime as dt
    import random
    rnd = random.Random(seed)
    rows = [(f"u{rnd.randint(0, 5)}", rnd.choice("abc"), dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randint(0, 50)), rnd.choice([0.5, 1.25, 4.0, -2.0]))
            for _ in range(400)]
    return rows, spark.createDataFrame(rows, "user_id string, category string, event_date date, amount double")


def test_dense_rows_are_not_shuffled(spark):
    from spendlens.operators import windows as W
    from spendlens.operators.grid import daily_grid_full, daily_grid_observed, daily_grid_with_user_sum
    _, tx = _random_tx(spark)
    for grid in (daily_grid_full(tx), daily_grid_observed(tx), daily_grid_with_user_sum(tx)):
        w = W.spec(["user_id", "category"], "event_date")
        assert _exchanges_above_explode(grid) == []
        assert _exchanges_above_explode(grid.withColumn("s", W.trailing_sum("amount", w, 7))) == []


def test_model_frame_is_not_shuffled_on_its_dense_rows(spark):
    from spendlens.plans import intensity, shared
    shared.clear()
    g = intensity.with_target(intensity.daily_grid_with_user_sum(intensity.tx_of(spark, "/root/testdata/sf0.001")))
    assert _exchanges_above_explode(g) == [] and "user_trailing_sum_30" in g.columns


def test_user_sums_against_brute_force(spark):
    import datetime as dt
    from spendlens.operators.grid import daily_grid_observed, daily_grid_with_user_sum, user_daily_grid
    rows, tx = _random_tx(spark, 3)
    day = {}
    for u, _, d, a in rows:
        day[u, d] = day.get((u, d), 0.0) + a
    first = min(d for _, _, d, _ in rows)
    got = daily_grid_with_user_sum(tx, 10).collect()
    assert sorted((r[0], r[1], r[2], r[3]) for r in got) == sorted(tuple(r) for r in daily_grid_observed(tx).collect())
    for r in got:
        want = None if r["event_date"] == first else sum(day.get((r["user_id"], r["event_date"] - dt.timedelta(days=i)), 0.0) for i in range(1, 11))
        assert r["user_trailing_sum_30"] == want
    assert {(r["user_id"], r["event_date"]): r["amount"] for r in user_daily_grid(tx).collect() if r["amount"]} == {k: v for k, v in day.items() if v}
    assert daily_grid_with_user_sum(tx.where("false")).count() == 0 and user_daily_grid(tx.where("false")).count() == 0


def test_category_rows_take_user_lags_from_windows_as_from_the_join(spark):
    import datetime
    import random
    rnd = random.Random(3)
    rows = [(u, datetime.date(2020, 1, 6) + datetime.timedelta(days=int(rnd.random() ** 2 * 70)), float(rnd.randint(1, 900)), f"{d}:{k}", d)
            for u in range(5) for _ in range(60) for d, k in [(rnd.choice(["inflow", "outflow"]), rnd.choice("xyz"))]]
    tx = spark.createDataFrame(rows, "user_id long, transaction_date date, amount_abs double, category string, flow_direction string")
    split = datetime.date(2020, 2, 10)
    joined = FF.category_regression_frame(tx, FF.weekly_flows(tx), split)
    dealt = FF.category_regression_frame(tx, None, split)
    assert dealt.columns == joined.columns
    assert sorted(map(str, dealt.collect())) == sorted(map(str, joined.collect()))
    assert "Join" not in dealt._jdf.queryExecution().optimizedPlan().toString()


def test_target_rows_without_the_columns_that_are_not_read(spark):
    """A27 reads the same targets from a plan without medians, mixes and windows as from the whole frame."""
    from collections import Counter

    from spendlens.plans import card_weekly as CW
    from spendlens.plans import shared
    sf = "/root/testdata/sf0.001"
    shared.clear()
    few = CW.feature_targets(spark, sf)
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "dominant_category_ratio" not in plan and "_entropy" not in plan and "percentile(weekly_amount" not in plan
    whole = CW.features_21(spark, sf).select("split", "bucket_t_plus_1")
    assert Counter(map(tuple, few.collect())) == Counter(map(tuple, whole.collect()))
    own = C.user_coverage(CW.tx_of(spark, sf), middle=False)
    assert set(C.user_coverage(CW.tx_of(spark, sf)).columns) - set(own.columns) == {"median_transaction_amount"}
