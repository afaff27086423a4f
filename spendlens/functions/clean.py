"""Cleaning and derivation expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expr import clip, col, safe_div

# Fixed values that must equal the reference for identical results.
# Ordered keyword rules of the manual category collapse (first rule wins,
# plain substring match on the lower-cased label).
MANUAL_CATEGORY_RULES = [
    ("groceries", ["grocery", "supermarket", "food market", "mart"]),
    ("fuel", ["fuel", "gas", "petrol", "diesel", "station"]),
    ("shopping", ["shop", "store", "mall", "retail", "amazon", "ebay"]),
    ("restaurants", ["restaurant", "cafe", "coffee", "bar", "pizza", "burger", "dining"]),
    ("utilities", ["utility", "electric", "water", "internet", "phone", "telecom", "bill"]),
    ("transport", ["uber", "lyft", "taxi", "bus", "metro", "train", "flight"]),
    ("healthcare", ["pharmacy", "hospital", "clinic", "medical", "drug"]),
    ("entertainment", ["movie", "cinema", "netflix", "spotify", "game", "entertain"]),
    ("travel", ["hotel", "booking", "airbnb", "travel", "trip"]),
]
# Transaction type codes of the account data: inflow codes; every other code is outflow.
INFLOW_TYPES = ["PRIJEM"]
OUTFLOW_TYPES = ["VYDAJ", "VYBER"]


def blank_to_null(c) -> Column:
    c = F.trim(col(c).cast("string"))
    return F.when(c != "", c)


def normalize_transactions(df: DataFrame, user: str, time: str, amount: str, category: str) -> DataFrame:
    """Canonical (user_id, event_time, event_date, amount, raw_category).

    Time is parsed as UTC (bad text -> NULL), rows with a NULL in any role are
    dropped, user is trimmed, category trimmed and lower-cased, empty strings dropped.
    """
    t = F.col(time)
    ts = t.cast("timestamp") if dict(df.dtypes)[time] != "string" else F.try_to_timestamp(t)
    out = df.select(
        F.trim(F.col(user).cast("string")).alias("user_id"),
        ts.alias("event_time"),
        F.col(amount).try_cast("double").alias("amount"),
        F.lower(F.trim(F.col(category).cast("string"))).alias("raw_category"),
    )
    out = out.where(F.col("event_time").isNotNull() & F.col("user_id").isNotNull()
                    & F.col("amount").isNotNull() & F.col("raw_category").isNotNull()
                    & ~F.isnan("amount"))
    out = out.where((F.col("user_id") != "") & (F.col("raw_category") != ""))
    return out.select("user_id", "event_time", F.to_date("event_time").alias("event_date"),
                      "amount", "raw_category")


def clean_weekly_source(df: DataFrame, user: str, time: str, amount: str, category: str | None) -> DataFrame:
    """Like P1, but a missing or blank category becomes ``unknown`` and only
    date/amount NULLs and empty users are dropped."""
    t = F.col(time)
    ts = t.cast("timestamp") if dict(df.dtypes)[time] != "string" else F.try_to_timestamp(t)
    cat = (F.coalesce(blank_to_null(F.lower(F.col(category).cast("string"))), F.lit("unknown"))
           if category else F.lit("unknown"))
    out = df.select(
        F.trim(F.col(user).cast("string")).alias("user_id"),
        F.to_date(ts).alias("event_date"),
        F.col(amount).try_cast("double").alias("amount"),
        cat.alias("category"),
    )
    return out.where(F.col("event_date").isNotNull() & F.col("amount").isNotNull() & ~F.isnan("amount")
                     & F.col("user_id").isNotNull() & (F.col("user_id") != ""))


def parse_compact_date(c) -> Column:
    """First run of 6-8 digits; 6 = YYMMDD (69-99 -> 19xx, 00-68 -> 20xx),
    8 = YYYYMMDD, 7 or invalid -> NULL."""
    digits = F.regexp_extract(col(c).cast("string"), r"(\d{6,8})", 1)
    n = F.length(digits)
    yy = F.substring(digits, 1, 2).try_cast("int")
    six = F.concat(F.when(yy >= 69, F.lit("19")).otherwise(F.lit("20")), digits)
    full = F.when(n == 6, six).when(n == 8, digits)
    return F.try_to_date(full, "yyyyMMdd")


def flow_direction(type_col) -> Column:
    """``inflow`` for inflow type codes, everything else (also NULL) ``outflow``."""
    t = F.upper(F.trim(F.coalesce(col(type_col).cast("string"), F.lit(""))))
    return F.when(t.isin(*INFLOW_TYPES), F.lit("inflow")).otherwise(F.lit("outflow"))


def signed_amount(amount, direction) -> Column:
    """P5: +|a| for inflow, -|a| for outflow."""
    a = F.abs(col(amount))
    return F.when(col(direction) == "inflow", a).otherwise(-a)


def flow_category(k_symbol, operation, type_col, direction) -> Column:
    """First non-blank of k_symbol, operation, type; else ``unknown``; lower; ``dir:`` prefix."""
    base = F.coalesce(blank_to_null(k_symbol), blank_to_null(operation), blank_to_null(type_col),
                      F.lit("unknown"))
    return F.concat(col(direction), F.lit(":"), F.lower(base))


def normalize_flows(raw: DataFrame) -> DataFrame:
    """The 9-column signed transaction table from raw account rows."""
    d = flow_direction("type")
    out = raw.select(
        F.col("account_id").try_cast("bigint").alias("user_id"),
        parse_compact_date("date").alias("transaction_date"),
        F.col("amount").try_cast("double").alias("_amount"),
        d.alias("flow_direction"),
        F.col("operation").cast("string").alias("operation"),
        F.col("type").cast("string").alias("type"),
        F.col("k_symbol").cast("string").alias("k_symbol"),
    )
    out = out.where(F.col("user_id").isNotNull() & F.col("transaction_date").isNotNull()
                    & F.col("_amount").isNotNull())
    return out.select(
        "user_id", "transaction_date",
        signed_amount("_amount", "flow_direction").alias("amount"),
        F.abs("_amount").alias("amount_abs"),
        flow_category("k_symbol", "operation", "type", "flow_direction").alias("category"),
        "flow_direction", "operation", "type", "k_symbol",
    )


def collapse_manual(c) -> Column:
    """Ordered substring rules, first match wins, else ``other``."""
    t = F.lower(col(c).cast("string"))
    out = None
    for label, keys in MANUAL_CATEGORY_RULES:
        cond = None
        for k in keys:
            hit = F.contains(t, F.lit(k))
            cond = hit if cond is None else (cond | hit)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return F.coalesce(out.otherwise(F.lit("other")), F.lit("other"))


def split_flows(direction, amount_abs) -> dict[str, Column]:
    """Inflow / outflow columns with 0.0 on the other side."""
    a = F.abs(col(amount_abs))
    return {
        "inflow": F.when(col(direction) == "inflow", a).otherwise(F.lit(0.0)),
        "outflow": F.when(col(direction) == "inflow", F.lit(0.0)).otherwise(a),
    }


def inflow_outflow_ratio(inflow, outflow) -> Column:
    """in/(out+1e-6) clipped to [0, 10]."""
    return clip(col(inflow) / (col(outflow) + F.lit(1e-6)), 0.0, 10.0)


def inflow_share(inflow, outflow) -> Column:
    """in/(in+out+1e-6) clipped to [0, 1]."""
    return clip(col(inflow) / (col(inflow) + col(outflow) + F.lit(1e-6)), 0.0, 1.0)


def ratio_or_zero(num, den) -> Column:
    """num/den, 0.0 when den is 0 or NULL."""
    return F.coalesce(safe_div(num, F.when(col(den) != 0, col(den))), F.lit(0.0))


def fill_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    """NaN / NULL -> 0.0 on the named columns (inf cannot arise from try_divide)."""
    return df.select(*[
        F.coalesce(F.when(~F.isnan(F.col(c)), F.col(c)), F.lit(0.0)).alias(c) if c in cols else F.col(c)
        for c in df.columns
    ])


def flow_from_category(c) -> Column:
    """Text before the first ``:``."""
    return F.split(col(c), ":").getItem(0)
