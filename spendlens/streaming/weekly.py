"""Weekly signed flows (A17) as a Structured Streaming job.

Transactions arrive as files; the user-week aggregate is kept in the state store
until the watermark passes the week, then emitted once (append mode).  Windows
are 7 days starting on Mondays (epoch day 0 is a Thursday, hence the 4-day
offset).  The checkpoint lives under the session's shared checkpoint folder so
a restarted query resumes exactly where it stopped.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import iso_week_label
from ..functions.clean import split_flows
from ..session import ensure_checkpoint_dir

FLOW_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()), T.StructField("transaction_date", T.DateType()),
    T.StructField("amount", T.DoubleType()), T.StructField("amount_abs", T.DoubleType()),
    T.StructField("category", T.StringType()), T.StructField("flow_direction", T.StringType()),
    T.StructField("operation", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("k_symbol", T.StringType()),
])


def weekly_flows_stream(tx: DataFrame, watermark: str = "14 days") -> DataFrame:
    """Streaming form of ``flow_features.weekly_flows`` (distinct categories via a bounded set)."""
    fl = split_flows("flow_direction", "amount_abs")
    ev = tx.select("user_id", "category", F.to_timestamp(F.col("transaction_date")).alias("event_ts"),
                   fl["inflow"].alias("inflow"), fl["outflow"].alias("outflow"))
    agg = (ev.withWatermark("event_ts", watermark)
           .groupBy("user_id", F.window("event_ts", "7 days", "7 days", "4 days").alias("w"))
           .agg(F.sum("inflow").alias("weekly_inflow_t"), F.sum("outflow").alias("weekly_outflow_t"),
                F.count(F.lit(1)).alias("txn_count_t"), F.size(F.collect_set("category")).cast("bigint").alias("category_diversity_t")))
    ws = F.to_date(F.col("w.start"))
    return agg.select("user_id", ws.alias("week_start"), iso_week_label(ws).alias("week_t"), "weekly_inflow_t",
                      "weekly_outflow_t", "txn_count_t", "category_diversity_t",
                      (F.col("weekly_inflow_t") - F.col("weekly_outflow_t")).alias("weekly_net_t"))


def start_weekly_flows(spark: SparkSession, source_dir: str, query_name: str = "weekly_flows",
                       sink: str = "memory", out_path: str | None = None, watermark: str = "14 days",
                       available_now: bool = True):
    """Run the streaming aggregate over Parquet files arriving in ``source_dir``."""
    src = spark.readStream.schema(FLOW_SCHEMA).parquet(source_dir)
    out = weekly_flows_stream(src, watermark)
    ckpt = os.path.join(ensure_checkpoint_dir(spark), "streams", query_name)
    w = out.writeStream.outputMode("append").option("checkpointLocation", ckpt).queryName(query_name)
    if available_now:
        w = w.trigger(availableNow=True)
    if sink == "memory":
        return w.format("memory").start()
    return w.format("parquet").option("path", out_path).start()
