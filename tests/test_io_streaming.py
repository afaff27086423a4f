"""Sources, sinks and the streaming weekly aggregate."""

import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from spendlens.sources import io as IO


def test_detect_roles():
    cols = ["CC_NUM", "trans_date_trans_time", "Amt", "category", "merchant"]
    r = IO.detect_roles(cols)
    assert r == {"user": "CC_NUM", "date": "trans_date_trans_time", "amount": "Amt", "category": "category"}
    assert IO.detect_roles(["user", "time", "value"])["category"] is None
    with pytest.raises(ValueError):
        IO.detect_roles(["a", "b"], {"user": "missing"})


def test_csv_scans_and_sinks(spark):
    d = tempfile.mkdtemp(prefix="spendlens-io-")
    p = os.path.join(d, "tx.csv")
    with open(p, "w") as f:
        f.write("customer_id,timestamp,amount,merchant_name,extra\nu1,2024-01-01T10:00:00+02:00,3.5,Gas Station,z\n")
    df = IO.scan_csv_roles(spark, p)
    assert df.columns == ["customer_id", "timestamp", "amount", "merchant_name"]
    sp = os.path.join(d, "acc.csv")
    with open(sp, "w") as f:
        f.write("trans_id;account_id;date;type;operation;amount;balance;k_symbol\n1;7;930101;PRIJEM;VKLAD;10;0;\n")
    assert IO.scan_semicolon_csv(spark, sp).count() == 1
    with pytest.raises(RuntimeError):
        IO.scan_semicolon_csv(spark, sp, required=["nope"])
    out = os.path.join(d, "stage")
    IO.sink_table(df, out)
    assert IO.scan_stage(spark, out).count() == 1


def test_metrics_scan_skips_bad_files(spark):
    d = tempfile.mkdtemp(prefix="spendlens-metrics-")
    for i, t in enumerate(["bucket_spend_t_plus_1", "bucket_net_t_plus_1"]):
        with open(os.path.join(d, f"run{i}_classification_report.json"), "w") as f:
            json.dump({"target": t, "test": {"random_forest": {"f1_macro": 0.4 + i / 10}}}, f, indent=2)
    with open(os.path.join(d, "bad_classification_report.json"), "w") as f:
        f.write("{not json")
    m = IO.scan_metrics(spark, os.path.join(d, "*classification_report*.json"), "bucket_spend_t_plus_1")
    assert m.count() == 1 and m.first()["test"]["random_forest"]["f1_macro"] == 0.4


def test_report_sink_round_trip(spark):
    d = tempfile.mkdtemp(prefix="spendlens-report-")
    rep = spark.range(1).select(F.struct(F.lit(3).alias("train"), F.lit(1).alias("test")).alias("rows"),
                                F.lit("full").alias("run_mode"))
    IO.sink_report(rep, os.path.join(d, "r"))
    back = spark.read.json(os.path.join(d, "r"))
    assert back.first()["rows"]["train"] == 3


def test_streaming_weekly_matches_batch(spark):
    from spendlens.operators.flow_features import weekly_flows
    from spendlens.sources.tables import tx_flow
    from spendlens.streaming.weekly import start_weekly_flows
    src = tempfile.mkdtemp(prefix="spendlens-stream-src-")
    tx = tx_flow(spark, "/root/testdata/sf0.001")
    tx.write.mode("overwrite").parquet(os.path.join(src, "batch0"))
    q = start_weekly_flows(spark, os.path.join(src, "*"), query_name="wf_test")
    q.awaitTermination(120)
    got = spark.sql("SELECT * FROM wf_test")
    batch = weekly_flows(tx)
    assert got.count() > 0
    cols = ["user_id", "week_start", "txn_count_t", "category_diversity_t"]
    assert got.select(*cols).exceptAll(batch.select(*cols)).count() == 0
    max_week = batch.agg(F.max("week_start")).first()[0]
    old = batch.where(F.col("week_start") < F.lit(max_week - dt.timedelta(days=28)))
    assert old.select(*cols).exceptAll(got.select(*cols)).count() == 0


def test_scan_dir_takes_the_preferred_or_the_largest_file(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "small.csv").write_text("a,b\n1,2\n")
    (tmp_path / "sub" / "large.csv").write_text("x\n" + "7\n" * 50)
    (tmp_path / "notes.txt").write_text("z" * 5000)
    assert IO.scan_dir(spark, str(tmp_path)).columns == ["x"]
    assert IO.scan_dir(spark, str(tmp_path), preferred="small.csv").columns == ["a", "b"]
    with pytest.raises(FileNotFoundError):
        IO.scan_dir(spark, str(tmp_path), glob="*.tsv")


def test_malformed_rows_are_kept_aside(spark):
    d = tempfile.mkdtemp(prefix="spendlens-bad-")
    with open(os.path.join(d, "x.csv"), "w") as f:
        f.write("id,price,day\n1,2.5,2024-01-01\n2,cheap,2024-01-02\n3,4\n4,5,2024-01-03,extra\n5,,2024-01-04\nx,1,2024-01-05\n6,1,soon\n")
    good, bad = IO.scan_csv_checked(spark, d, "id long, price double, day date")
    assert sorted(r["id"] for r in good.collect()) == [1, 5]
    assert sorted(r["record"] for r in bad.collect()) == ["2,cheap,2024-01-02", "3,4", "4,5,2024-01-03,extra", "6,1,soon", "x,1,2024-01-05"]
    assert good.select("id").count() == 2 and bad.count() == 5


def test_reports_to_rows_and_modes(spark):
    from spendlens.operators import metrics as M
    d = tempfile.mkdtemp(prefix="spendlens-modes-")
    for mode, base, f1 in (("quick", 0.25, 0.5), ("full", 0.5, 0.75)):
        rep = spark.createDataFrame([("spend", mode)], "target string, run_mode string").select("*", F.struct(
            F.struct(F.lit(base).alias("f1_macro"), F.lit(0.1).alias("balanced_accuracy")).alias("persistence"),
            F.struct(F.lit(f1).alias("f1_macro"), F.lit(0.2).alias("balanced_accuracy")).alias("forest")).alias("test"))
        IO.sink_report(rep, os.path.join(d, mode))
    with open(os.path.join(d, "full", "broken.json"), "w") as f:
        f.write("{oops")
    rows = IO.report_metrics(IO.scan_metrics(spark, os.path.join(d, "*", "*.json")))
    assert rows.count() == 4
    r = M.modes_pivot(rows).first()
    assert (r["target"], r["model"], r["f1_macro_full"], r["f1_macro_quick"], r["f1_delta_full_minus_quick"]) == ("spend", "forest", 0.75, 0.5, 0.25)
    assert r["relative_gain_vs_persistence_full"] == 0.5 and r["relative_gain_vs_persistence_quick"] == 1.0


def test_replay_counts_changes_and_missing_rows(spark):
    from spendlens.operators import train as T
    cols = "k long, proba_class_0 double, proba_class_1 double, predicted_class int"
    a = spark.createDataFrame([(1, 0.5, 0.5, 0), (2, 0.9, 0.1, 0), (3, 0.2, 0.8, 1)], cols)
    b = spark.createDataFrame([(1, 0.5, 0.5, 0), (2, 0.4, 0.6, 1), (4, 0.2, 0.8, 1)], cols)
    r = T.replay(a, b, ["k"], 2).first()
    assert tuple(r) == (3, 2, 0.5, 1)
    many = spark.range(100).select(F.col("id").alias("k"))
    assert sorted(r["k"] for r in T.cap_rows(many, 7, ["k"]).collect()) == sorted(r["k"] for r in T.cap_rows(many.repartition(5), 7, ["k"]).collect())


def test_verdicts_by_threshold(spark):
    from spendlens.operators import metrics as M
    one = lambda name, *v: spark.createDataFrame([(x,) for x in v], f"{name} double").coalesce(1)
    r = M.feasibility_verdict(one("f1_macro", 0.3, 0.32), one("f1_macro", 0.3), one("mae", 9.0, 9.8), one("mae", 10.0)).first()
    assert (r["classification_verdict"], r["regression_verdict"]) == ("BORDERLINE", "GO") and abs(r["regression_gain"] - 0.1) < 1e-12
    dist = spark.createDataFrame([(1, 2.0), (2, 5.0)], "bucket int, mean_value double")
    for m, s, n, said in ((0.5, 0.1, 1, "NO GO"), (0.56, 0.1, 2, "GO"), (0.56, 0.2, 3, "GO")):
        r = M.intensity_verdict(dist, one("f1_weighted", m), one("f1_weighted", 0.5), one("spearman", s, None)).first()
        assert (r["criteria_passed"], r["verdict"], r["class_separation_ratio_c2_c1"]) == (n, said, 2.5)
