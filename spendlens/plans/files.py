"""Sources and sinks on files that a query writes first: a given table goes out as text or Parquet to the shared folder, is
scanned like an export from elsewhere, and has to equal the table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import normalize_flows, normalize_transactions
from ..session import ensure_checkpoint_dir
from ..sources import io as IO
from ..sources.tables import flow_raw, oracle_with, table
from .registry import register, rounded

ORDERS = "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate date, o_orderpriority string"


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files-{name}-{uuid.uuid4().hex}"


def _csv(df: DataFrame, path: str, sep: str = ",") -> str:
    df.write.option("header", True).option("sep", sep).csv(path)
    return path


def _orders(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"])
    return o.withColumn("o_orderdate", F.col("o_orderdate").cast("date"))


_ORDERS_SQL = "SELECT o_orderkey, o_custkey, round(o_totalprice, 4) + 0.0 AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders"


@register("S1_scan_csv", _ORDERS_SQL)
def s1(spark, sf_dir):
    """Every column of a CSV with a header, types from an explicit schema."""
    path = _csv(_orders(spark, sf_dir), _folder(spark, "csv"))
    return rounded(IO.scan_csv(spark, path, ORDERS))


@register("S1_malformed_rows", """
SELECT o_orderkey % 7 = 3 AS malformed, count(*) AS n_rows, round(sum(CASE WHEN o_orderkey % 7 <> 3 THEN o_totalprice END), 2) AS total,
       min(CASE WHEN o_orderkey % 7 = 3 THEN o_orderkey END)::VARCHAR AS first_record FROM orders GROUP BY 1""")
def s1m(spark, sf_dir):
    """Rows of another type or length are kept aside whole and counted: here one in seven has a price in words."""
    o = _orders(spark, sf_dir)
    price = F.when(F.col("o_orderkey") % 7 == 3, F.concat(F.lit("about "), F.col("o_totalprice").cast("string"))).otherwise(F.col("o_totalprice").cast("string"))
    good, bad = IO.scan_csv_checked(spark, _csv(o.withColumn("o_totalprice", price), _folder(spark, "malformed")), ORDERS)
    kept = good.agg(F.lit(False).alias("malformed"), F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total"),
                    F.lit(None).cast("string").alias("first_record"))
    aside = bad.agg(F.lit(True).alias("malformed"), F.count(F.lit(1)).alias("n_rows"), F.lit(None).cast("double").alias("total"),
                    F.min(F.split("record", ",")[0].cast("bigint")).cast("string").alias("first_record"))
    return kept.unionByName(aside).where("n_rows > 0")


@register("S2_scan_csv_roles", oracle_with("tx_daily") + """
SELECT user_id, event_date, round(amount, 4) + 0.0 AS amount, raw_category FROM tx_daily""")
def s2(spark, sf_dir):
    """Roles are found in the header, only their columns are read, and the rows are normalised."""
    ev = table(spark, sf_dir, "events", ["event_id", "user_id", "ts", "value", "event_type"])
    out = ev.select(F.col("event_id").alias("row"), F.col("user_id").alias("Customer_ID"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("Timestamp"),
                    F.col("value").alias("Amt"), F.col("event_type").alias("Merchant"))
    df = IO.scan_csv_roles(spark, _csv(out, _folder(spark, "roles")))
    roles = IO.detect_roles(df.columns)
    tx = normalize_transactions(df, roles["user"], roles["date"], roles["amount"], roles["category"])
    return rounded(tx.select("user_id", "event_date", "amount", "raw_category"))


@register("S3_scan_semicolon_csv", oracle_with("tx_flow") + """
SELECT user_id, transaction_date, round(amount, 4) + 0.0 AS amount, category, flow_direction FROM tx_flow""")
def s3(spark, sf_dir):
    """The semicolon-separated account export with its required columns, normalised."""
    raw = flow_raw(spark, sf_dir).withColumn("balance", F.lit(0.0)).select(*IO.ACCOUNT_REQUIRED)
    df = IO.scan_semicolon_csv(spark, _csv(raw, _folder(spark, "export"), ";"))
    return rounded(normalize_flows(df).select(F.col("user_id").cast("bigint").alias("user_id"), "transaction_date", "amount", "category", "flow_direction"))


@register("S4_stage_round_trip", _ORDERS_SQL)
def s4(spark, sf_dir):
    """A stage table written by priority (S8) and read again with its types."""
    path = _folder(spark, "stage")
    IO.sink_table(_orders(spark, sf_dir), path, partition_by=["o_orderpriority"])
    return rounded(IO.scan_stage(spark, path).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"))


@register("S5_scan_dir", "SELECT count(*) AS n_rows, sum(CAST(c_custkey AS BIGINT))::BIGINT AS keys FROM customer")
def s5(spark, sf_dir):
    """Of the CSV files below a folder the largest one is scanned: here all customers beside a few nations."""
    top = _folder(spark, "tree")
    _csv(table(spark, sf_dir, "customer", ["c_custkey", "c_name"]).coalesce(1), f"{top}/a/customers")       # one file is the feature
    _csv(table(spark, sf_dir, "nation").coalesce(1), f"{top}/b/nations")
    return IO.scan_dir(spark, top).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("c_custkey").cast("bigint")).alias("keys"))
