"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import col


def week_start(d) -> Column:
    """Monday of the ISO week."""
    return F.trunc(col(d), "week")


def iso_year(d) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), col(d)).cast("int")


def iso_week_label(d) -> Column:
    """``YYYY-Www`` with the ISO year (1993-01-01 -> 1992-W53)."""
    d = col(d)
    return F.concat(iso_year(d).cast("string"), F.lit("-W"),
                    F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def week_label_to_monday(label) -> Column:
    """Inverse of T2 by arithmetic (week patterns are not parseable)."""
    label = col(label)
    y = F.substring(label, 1, 4).cast("int")
    w = F.substring(label, 7, 2).cast("int")
    week1_monday = F.trunc(F.make_date(y, F.lit(1), F.lit(4)), "week")
    return F.date_add(week1_monday, (w - 1) * 7)


def calendar_features(ws) -> dict[str, Column]:
    """T4: calendar columns of a week that starts on ``ws`` (a Monday)."""
    ws = col(ws)
    we = F.date_add(ws, 6)
    return {
        "week_of_year": F.weekofyear(ws),
        "month": F.month(ws),
        "quarter": F.quarter(ws),
        "week_of_month": (1 + F.floor((F.dayofmonth(ws) - 1) / 7)).cast("int"),
        "is_month_start_week": (F.dayofmonth(ws) <= 7).cast("int"),
        "is_month_end_week": (F.datediff(F.last_day(we), we) <= 6).cast("int"),
    }


def is_weekend(d) -> Column:
    """T5: Saturday or Sunday as 0/1."""
    return F.dayofweek(col(d)).isin(1, 7).cast("int")


def is_month_end(d) -> Column:
    """T5: last day of the month as 0/1."""
    d = col(d)
    return (d == F.last_day(d)).cast("int")
