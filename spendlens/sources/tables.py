"""Driver tables mapped onto the transaction data model.

* ``tx_daily``  <- events   (user, timestamp, amount, category)    card-style daily series
* ``flow_raw``  <- lineitem (account rows with type codes, YYMMDD)  signed-flow data
* ``tx_sparse`` <- orders   (user, date, amount, priority)          weekly card data
* ``pairs``     <- labels   (y=quality, p=toxic)                    metric inputs

Each loader selects only the columns it needs so Parquet pruning reaches the scan.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import clean_weekly_source, normalize_flows, normalize_transactions


def table(spark: SparkSession, sf_dir: str, name: str, cols: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*cols) if cols else df


def tx_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 applied to ``events``: user_id, event_time, event_date, amount, raw_category."""
    ev = table(spark, sf_dir, "events", ["user_id", "ts", "value", "event_type"])
    return normalize_transactions(ev, "user_id", "ts", "value", "event_type")


def flow_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw account-transaction rows derived from ``lineitem``.

    account = supplier; inflow (type PRIJEM) iff the return flag is R; the date is
    written as 6-digit ``yyMMdd`` text like the original export.
    """
    li = table(spark, sf_dir, "lineitem",
               ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_returnflag",
                "l_linestatus", "l_shipdate"])
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("trans_id"),
        F.col("l_suppkey").alias("account_id"),
        F.date_format("l_shipdate", "yyMMdd").alias("date"),
        F.when(F.col("l_returnflag") == "R", F.lit("PRIJEM")).otherwise(F.lit("VYDAJ")).alias("type"),
        F.col("l_returnflag").alias("operation"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_linestatus").alias("k_symbol"),
    )


def tx_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7 applied to :func:`flow_raw`: the 9-column signed transaction table."""
    return normalize_flows(flow_raw(spark, sf_dir))


def tx_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2 applied to ``orders``: user_id, event_date, amount, category."""
    o = table(spark, sf_dir, "orders", ["o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority"])
    return clean_weekly_source(o, "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")


def label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, y, p) integer class pairs for the evaluation operators."""
    lb = table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    return lb.select("doc_id", F.col("quality").cast("int").alias("y"), F.col("toxic").cast("int").alias("p"))


# DuckDB text of the same views, used only by the SQL oracle.
ORACLE_VIEWS = {
    "tx_daily": """
tx_daily AS (
  SELECT trim(CAST(user_id AS VARCHAR)) AS user_id, CAST(ts AS TIMESTAMP) AS event_time,
         CAST(ts AS DATE) AS event_date, CAST(value AS DOUBLE) AS amount,
         lower(trim(event_type)) AS raw_category
  FROM events
  WHERE ts IS NOT NULL AND user_id IS NOT NULL AND value IS NOT NULL AND event_type IS NOT NULL
    AND NOT isnan(value) AND trim(CAST(user_id AS VARCHAR)) <> '' AND trim(event_type) <> '')""",
    "flow_raw": """
flow_raw AS (
  SELECT l_orderkey * 8 + l_linenumber AS trans_id, l_suppkey AS account_id,
         strftime(l_shipdate, '%y%m%d') AS date,
         CASE WHEN l_returnflag = 'R' THEN 'PRIJEM' ELSE 'VYDAJ' END AS type,
         l_returnflag AS operation, l_extendedprice AS amount, l_linestatus AS k_symbol
  FROM lineitem)""",
    "tx_flow": """
flow_parsed AS (
  SELECT CAST(account_id AS BIGINT) AS user_id,
         CASE WHEN length(regexp_extract(CAST(date AS VARCHAR), '(\\d{6,8})', 1)) = 6 THEN
                try_strptime((CASE WHEN CAST(substr(regexp_extract(CAST(date AS VARCHAR), '(\\d{6,8})', 1), 1, 2) AS INT) >= 69
                                   THEN '19' ELSE '20' END) || regexp_extract(CAST(date AS VARCHAR), '(\\d{6,8})', 1), '%Y%m%d')
              WHEN length(regexp_extract(CAST(date AS VARCHAR), '(\\d{6,8})', 1)) = 8 THEN
                try_strptime(regexp_extract(CAST(date AS VARCHAR), '(\\d{6,8})', 1), '%Y%m%d') END AS ts,
         CAST(amount AS DOUBLE) AS amt,
         CASE WHEN upper(trim(coalesce(type, ''))) IN ('PRIJEM') THEN 'inflow' ELSE 'outflow' END AS flow_direction,
         operation, type, k_symbol
  FROM flow_raw),
tx_flow AS (
  SELECT user_id, CAST(ts AS DATE) AS transaction_date,
         CASE WHEN flow_direction = 'inflow' THEN abs(amt) ELSE -abs(amt) END AS amount,
         abs(amt) AS amount_abs,
         flow_direction || ':' || lower(coalesce(nullif(trim(k_symbol), ''), nullif(trim(operation), ''),
                                                nullif(trim(type), ''), 'unknown')) AS category,
         flow_direction, operation, type, k_symbol
  FROM flow_parsed WHERE user_id IS NOT NULL AND ts IS NOT NULL AND amt IS NOT NULL)""",
    "tx_sparse": """
tx_sparse AS (
  SELECT trim(CAST(o_custkey AS VARCHAR)) AS user_id, CAST(o_orderdate AS DATE) AS event_date,
         CAST(o_totalprice AS DOUBLE) AS amount,
         coalesce(nullif(trim(lower(o_orderpriority)), ''), 'unknown') AS category
  FROM orders
  WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL AND NOT isnan(o_totalprice)
    AND o_custkey IS NOT NULL AND trim(CAST(o_custkey AS VARCHAR)) <> '')""",
    "label_pairs": """
label_pairs AS (SELECT doc_id, CAST(quality AS INT) AS y, CAST(toxic AS INT) AS p FROM labels)""",
}
VIEW_DEPENDS = {"tx_flow": ["flow_raw"]}


def oracle_with(*views: str) -> str:
    """``WITH`` prefix holding the named oracle views (dependencies first)."""
    order: list[str] = []
    for v in views:
        for dep in VIEW_DEPENDS.get(v, []):
            if dep not in order:
                order.append(dep)
        if v not in order:
            order.append(v)
    return "WITH " + ",\n".join(ORACLE_VIEWS[v].strip() for v in order)
