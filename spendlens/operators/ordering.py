"""Global order without a single-partition window.

Rows are range-partitioned on the whole sort key (all of its columns, so one hot value of the first
column is cut by the next) and written once to the shared checkpoint folder, which fixes the
partition each row is in.  Partition totals give offsets through a small window over one row per
partition, and a window inside each partition finishes the count.  Nothing is collected and no
boundary becomes a literal, so cost and plan follow the data and not the partition setting.  Used by
exact quantiles, rank correlation, the two-sample KS statistic and expanding folds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def default_buckets(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))


def range_buckets(df: DataFrame, keys: list[str], n_buckets: int | None = None, out: str = "_bkt") -> DataFrame:
    """``df`` with the number of its range partition over ``keys``, written once."""
    dealt = df.repartitionByRange(n_buckets or default_buckets(df), *keys)
    return checkpointed(dealt.withColumn(out, F.spark_partition_id()))


def with_prefix_sums(df: DataFrame, group_cols: list[str], order_cols: list[str], weights: dict[str, Column | None],
                     n_buckets: int | None = None, per_group: bool = False) -> DataFrame:
    """Add, for each name in ``weights``, the total weight of all rows ordered strictly before the row.

    Order is ``group_cols`` then ``order_cols`` (ascending).  With ``per_group`` sums restart in each
    group.  A weight of None counts rows, which gives the 0-based row index.
    """
    keys = group_cols + order_cols
    w = {f"_w{i}": (F.lit(1) if c is None else c).cast("bigint") for i, c in enumerate(weights.values())}
    b = range_buckets(df.withColumns(w), keys, n_buckets)
    coarse = (group_cols if per_group else []) + ["_bkt"]
    totals = b.groupBy(*coarse).agg(*[F.sum(c).alias(c) for c in w])
    upto = (Window.partitionBy(*group_cols) if per_group and group_cols else Window.partitionBy()).orderBy("_bkt")
    upto = upto.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*coarse, *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"{c}_off") for c in w])
    inside = Window.partitionBy(*coarse).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    local = b.withColumns({f"{c}_in": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in w})
    on = F.lit(True)
    for c in coarse:
        on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"o.{c}"))
    joined = local.alias("l").join(offsets.alias("o"), on)
    return joined.select(*[F.col(f"l.{c}") for c in df.columns],
                         *[(F.col(f"o.{c}_off") + F.col(f"l.{c}_in")).alias(out) for c, out in zip(w, weights)])


def with_prefix_sum(df: DataFrame, group_cols: list[str], order_col: str, tie_cols: list[str],
                    weight: str | None = None, n_buckets: int | None = None,
                    out: str = "_before", per_group: bool = False) -> DataFrame:
    """One prefix sum (see :func:`with_prefix_sums`)."""
    return with_prefix_sums(df, group_cols, [order_col] + tie_cols, {out: F.col(weight) if weight else None},
                            n_buckets, per_group)


def quantile_table(df: DataFrame, cols: list[str], probs: list[float], by: list[str] | None = None,
                   n_buckets: int | None = None) -> DataFrame:
    """``(by..., k, q)``: linear-interpolated quantiles (pandas/NumPy default) of each column per group.

    One value histogram for all columns and groups (map-side combined), its prefix counts, and of
    it only the values that hold a target rank.  Null and NaN values do not count; a group without
    values has no row for that column.
    """
    by = by or []
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in cols]))
    hist = (df.select(*by, cells.alias("s")).select(*by, "s.k", "s.v").where(F.col("v").isNotNull() & ~F.isnan("v"))
            .groupBy(*by, "k", "v").agg(F.count(F.lit(1)).alias("c")))
    group = by + ["k"]
    before = with_prefix_sums(hist, group, ["v"], {"s": F.col("c")}, n_buckets, per_group=True)
    sizes = before.groupBy(*[F.col(g).alias(f"_{g}") for g in group]).agg(F.max(F.col("s") + F.col("c")).alias("n"))
    wanted = sizes.withColumn("_t", F.explode(F.array(*[F.struct(
        F.lit(i).alias("i"), ((F.col("n") - 1) * F.lit(float(p))).alias("pos")) for i, p in enumerate(probs)])))
    targets = wanted.groupBy(*[f"_{g}" for g in group]).agg(F.collect_list("_t").alias("_ts"))
    on = F.lit(True)
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
    # Of each target position the values at its floor and at the next rank, where they lie in this value.
    hit = F.expr("filter(_ts, t -> s <= floor(t.pos) + 1 AND s + c > floor(t.pos))")
    held = before.join(targets, on).withColumn("_hit", F.explode(hit))
    lo = F.max(F.when((F.col("s") <= F.floor("_hit.pos")) & (F.floor("_hit.pos") < F.col("s") + F.col("c")), F.col("v")))
    hi = F.max(F.when((F.col("s") <= F.floor("_hit.pos") + 1) & (F.floor("_hit.pos") + 1 < F.col("s") + F.col("c")), F.col("v")))
    ends = held.groupBy(*group, F.col("_hit.i").alias("_i"), F.col("_hit.pos").alias("_pos")).agg(lo.alias("_lo"), hi.alias("_hi"))
    frac = F.col("_pos") - F.floor("_pos")
    value = F.when((frac > 0) & F.col("_hi").isNotNull(), F.col("_lo") + (F.col("_hi") - F.col("_lo")) * frac).otherwise(F.col("_lo"))
    per = ends.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("_i", value.alias("v")))).alias("_m"))
    return per.select(*group, F.array(*[F.element_at("_m", F.lit(i)) for i in range(len(probs))]).alias("q"))


def exact_quantiles_multi(df: DataFrame, cols: list[str], probs: list[float],
                          n_buckets: int | None = None) -> dict[str, list]:
    """Quantiles of several columns as numbers: one row per column reaches the driver."""
    found = {r["k"]: list(r["q"]) for r in quantile_table(df, cols, probs, n_buckets=n_buckets).collect()}
    return {c: found.get(c, [None] * len(probs)) for c in cols}


def exact_quantiles(df: DataFrame, col: str, probs: list[float]) -> list:
    return exact_quantiles_multi(df, [col], probs)[col]


def medians(df: DataFrame, cols: dict[str, str]) -> dict[str, Column]:
    """Literals ``name -> median of column`` for use inside an aggregate over the same frame."""
    q = exact_quantiles_multi(df, list(dict.fromkeys(cols.values())), [0.5])
    return {name: F.lit(q[c][0]).cast("double").alias(name) for name, c in cols.items()}
