"""Dense calendar grids.

A grid is built per series instead of by joining a cross product back to the
observations: the observed days of a series are folded into a map (its size is
bounded by the calendar span), then ``explode(sequence(start, end))`` emits the
dense rows and looks each day up.  All shuffles are of series or of daily sums and
lie below the explode; the dense rows are left hash-partitioned by their series key,
so the per-series windows that follow reuse that partitioning without another
exchange.  What a series needs from its user's other series (J4) is folded into an
array by day and travels with the series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_totals(tx: DataFrame, keys=("user_id", "category"), date="event_date", amount="amount") -> DataFrame:
    """Sum per (series, day) with map-side partial aggregation."""
    return tx.groupBy(*keys, date).agg(F.sum(amount).alias(amount))


def date_bounds(df: DataFrame, date: str = "event_date"):
    row = df.agg(F.min(date).alias("d0"), F.max(date).alias("d1")).first()
    return row["d0"], row["d1"]


def _by_day(daily: DataFrame, keys: list[str], date: str, amount: str) -> DataFrame:
    """One row per series with its observed days as a map, at most one entry per calendar day."""
    return daily.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col(date), F.col(amount)))).alias("_m"))


def _dense(series: DataFrame, keys: list[str], date: str, amount: str, d0, d1, carried: dict[str, str] | None = None) -> DataFrame:
    """Every day of every series; ``carried`` names arrays by day whose values go along."""
    grid = series.select(*keys, "_m", *(carried or {}).values(), F.posexplode(F.sequence(F.lit(d0), F.lit(d1))).alias("_pos", date))
    return grid.select(*keys, date, F.coalesce(F.element_at("_m", F.col(date)), F.lit(0.0)).alias(amount),
                       *[F.get(a, F.col("_pos")).alias(out) for out, a in (carried or {}).items()])


def daily_grid_observed(tx: DataFrame, keys=("user_id", "category"), date="event_date",
                        amount="amount", bounds=None) -> DataFrame:
    """Observed (user, category) pairs x every day between the global min and max."""
    keys = list(keys)
    daily = daily_totals(tx, keys, date, amount)
    d0, d1 = bounds or date_bounds(daily, date)
    if d0 is None:
        return daily.limit(0)
    return _dense(_by_day(daily, keys, date, amount), keys, date, amount, d0, d1)


def daily_grid_full(tx: DataFrame, user="user_id", category="category", date="event_date",
                    amount="amount") -> DataFrame:
    """Every user x every category x every day, zero filled.

    Users meet the table of categories (the product is the feature; Spark broadcasts the categories only
    under its size threshold), pairs meet their observed days, and only then days are laid out: the dense
    rows are never shuffled.
    """
    daily = daily_totals(tx, (user, category), date, amount)
    d0, d1 = date_bounds(daily, date)
    if d0 is None:
        return daily.limit(0)
    pairs = daily.select(user).distinct().crossJoin(daily.select(category).distinct())
    series = pairs.join(_by_day(daily, [user, category], date, amount), [user, category], "left")
    return _dense(series, [user, category], date, amount, d0, d1)


def trailing_sums(days: str, k: int, d0, d1) -> F.Column:
    """Array by day of the sums over the ``k`` days before, fewer at the start and null on the first; ``days`` is a map."""
    totals = F.transform(F.sequence(F.lit(d0), F.lit(d1)), lambda d: F.coalesce(F.element_at(days, d), F.lit(0.0)))
    total = lambda some: F.aggregate(some, F.lit(0.0), lambda x, y: x + y)
    return F.transform(totals, lambda _, i: F.when(i > 0, total(F.slice(totals, F.greatest(i - k, F.lit(0)) + 1, F.least(i, F.lit(k))))))


def daily_grid_with_user_sum(tx: DataFrame, k: int = 30, user="user_id", category="category", date="event_date",
                             amount="amount", out="user_trailing_sum_30") -> DataFrame:
    """J2 with J4 + W6: each row also has its user's total over the ``k`` days before, over all categories.

    Totals are added up per user and day before any day is laid out, and join the series as one array a user.
    """
    daily = daily_totals(tx, (user, category), date, amount)
    d0, d1 = date_bounds(daily, date)
    if d0 is None:
        return daily.limit(0).withColumn(out, F.lit(None).cast("double"))
    # One row per user; the totals are taken out of the map before the sums, which read each day k times.
    users = _by_day(daily_totals(daily, (user,), date, amount), [user], date, amount)
    users = users.select(user, trailing_sums("_m", k, d0, d1).alias("_u"))
    series = _by_day(daily, [user, category], date, amount).join(users, user).repartition(user, category)
    return _dense(series, [user, category], date, amount, d0, d1, {out: "_u"})


def user_daily_grid(tx: DataFrame, user="user_id", date="event_date", amount="amount") -> DataFrame:
    """Every user x every day with the total over all categories."""
    daily = daily_totals(tx, (user,), date, amount)
    d0, d1 = date_bounds(daily, date)
    return daily.limit(0) if d0 is None else _dense(_by_day(daily, [user], date, amount), [user], date, amount, d0, d1)


def weekly_category_grid(reg: DataFrame, categories: DataFrame, numeric_cols: list[str],
                         keys=("user_id", "week_start", "week_t"), category="category") -> DataFrame:
    """Observed user-weeks x train categories, numeric columns zero filled and
    the flow direction derived from the category text.

    ``categories`` may be of any size; the weeks meet its distinct values as a table.
    """
    keys = list(keys)
    dense = reg.select(*keys).distinct().crossJoin(categories.select(category).distinct())
    obs = reg.select(*keys, category, *numeric_cols)
    out = dense.join(obs, keys + [category], "left")
    return out.select(*keys, category,
                      F.split(F.col(category), ":").getItem(0).alias("flow_direction"),
                      *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in numeric_cols])
