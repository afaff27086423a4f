"""Column-expression semantics on hand literals."""

import datetime as dt

from pyspark.sql import functions as F

from spendlens.functions import buckets as Bk
from spendlens.functions import calendar as Cal
from spendlens.functions import clean as Cl
from spendlens.functions.expr import clip, guarded_corr, safe_div


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_compact_dates(spark):
    df = spark.createDataFrame([("930101",), ("680101",), ("690101",), ("1234567",), ("19930105",), ("abc",),
                                ("931341",), (None,)], "d string")
    got = [r[0] for r in df.select(Cl.parse_compact_date("d")).collect()]
    assert got == [dt.date(1993, 1, 1), dt.date(2068, 1, 1), dt.date(1969, 1, 1), None, dt.date(1993, 1, 5),
                   None, None, None]


def test_iso_week_label_and_inverse(spark):
    df = spark.createDataFrame([(dt.date(1992, 12, 31),), (dt.date(1993, 1, 1),), (dt.date(1993, 1, 4),)], "d date")
    labels = [r[0] for r in df.select(Cal.iso_week_label("d")).collect()]
    assert labels == ["1992-W53", "1992-W53", "1993-W01"]
    back = df.select(Cal.week_label_to_monday(Cal.iso_week_label("d")).alias("m"), Cal.week_start("d").alias("w")).collect()
    assert all(r["m"] == r["w"] for r in back)


def test_calendar_features_month_end(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 22),), (dt.date(2024, 1, 1),)], "ws date")
    r = df.select(*[v.alias(k) for k, v in Cal.calendar_features("ws").items()]).collect()
    assert r[0]["is_month_end_week"] == 1 and r[0]["week_of_month"] == 4
    assert r[1]["is_month_start_week"] == 1 and r[1]["is_month_end_week"] == 0


def test_manual_collapse_literals(spark):
    names = ["Fresh Market", "Gas Station", "Coffee Bar", "Online Store", "gas_transport", "smart tv", "food_dining",
             "business"]
    df = spark.createDataFrame([(n,) for n in names], "c string")
    got = [r[0] for r in df.select(Cl.collapse_manual("c")).collect()]
    assert got == ["other", "fuel", "restaurants", "shopping", "fuel", "groceries", "restaurants", "transport"]


def test_weekly_clean_categories(spark):
    df = spark.createDataFrame([("u1", "2024-01-01", "1.5", None), ("u1", "2024-01-02", "2", "  "),
                                ("u2", "2024-01-03", "3", "  Food "), ("", "2024-01-03", "3", "x"),
                                ("u3", "bad", "3", "x")], "u string, t string, a string, c string")
    got = rows(Cl.clean_weekly_source(df, "u", "t", "a", "c").select("user_id", "category"))
    assert got == [("u1", "unknown"), ("u1", "unknown"), ("u2", "food")]


def test_flow_direction_sign_category(spark):
    df = spark.createDataFrame([(" prijem ", "", "VKLAD", 10.0), ("VYBER", None, None, 5.0), (None, "SIPO", "X", 1.0)],
                               "type string, k string, op string, a double")
    d = Cl.flow_direction("type")
    out = df.select(d.alias("d"), Cl.signed_amount("a", d).alias("s"),
                    Cl.flow_category("k", "op", "type", d).alias("c")).collect()
    assert [tuple(r) for r in out] == [("inflow", 10.0, "inflow:vklad"), ("outflow", -5.0, "outflow:vyber"),
                                       ("outflow", -1.0, "outflow:sipo")]


def test_bucket_rules_differ(spark):
    df = spark.createDataFrame([(0.0,), (-5.0,), (None,), (5.0,), (50.0,)], "y double")
    got = df.select(Bk.bucket_strict("y", 10.0, 20.0).alias("b1"), Bk.bucket_select("y", 10.0, 20.0).alias("b2"),
                    Bk.bucket_quantile_class("y", 10.0, 20.0).alias("b3")).collect()
    assert [tuple(r) for r in got] == [(0, 0, 1), (None, 1, 1), (None, 3, 1), (1, 1, 1), (3, 3, 3)]


def test_clip_keeps_null_and_safe_div(spark):
    df = spark.createDataFrame([(None, 0.0), (50.0, 2.0)], "x double, d double")
    got = df.select(clip("x", 0, 10).alias("c"), safe_div("x", "d").alias("q")).collect()
    assert got[0]["c"] is None and got[0]["q"] is None
    assert got[1]["c"] == 10.0 and got[1]["q"] == 25.0


def test_guarded_corr_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(guarded_corr("x", "y")).first()[0] is None
    df2 = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 7.0)], "x double, y double")
    assert abs(df2.agg(guarded_corr("x", "y")).first()[0] - 0.9933992677987828) < 1e-12


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(2.5,), (3.5,)], "x double")
    assert [r[0] for r in df.select(F.bround("x", 0)).collect()] == [2.0, 4.0]


def test_confidence_bins_and_entropy_levels(spark):
    df = spark.createDataFrame([(0.25,), (0.349,), (0.95,), (1.0,), (0.2,)], "p double")
    got = [r[0] for r in df.select(Bk.confidence_bin("p")).collect()]
    assert got == ["0.25-0.35", "0.25-0.35", "0.95-1.00", "0.95-1.00", None]
    e = spark.createDataFrame([(0.5,), (0.8,), (1.4,)], "e double")
    assert [r[0] for r in e.select(Bk.entropy_level("e")).collect()] == ["low", "medium", "high"]
