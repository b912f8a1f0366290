"""Calendar features (ISO week, Monday = 0, cyclic encodings)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_PI = 2 * math.pi


def cyclic(x: Column, period: int) -> tuple[Column, Column]:
    """sin and cos of 2*pi*x/period, evaluated as ((2*pi)*x)/period."""
    arg = F.lit(_TWO_PI) * x / F.lit(float(period))
    return F.sin(arg), F.cos(arg)


def calendar_columns(date: Column, profile: str) -> list[Column]:
    """Calendar features of one profile.

    ``base``: integer month, year, quarter, day_of_week, day_of_year, week_of_year.
    ``nn``: double month, quarter, day_of_week, week_of_year.
    Both: sin/cos of month/12, day_of_week/7 and week_of_year/52 (week 53 kept).
    """
    month = F.month(date)
    quarter = F.quarter(date)
    dow = F.weekday(date)            # Monday = 0
    week = F.weekofyear(date)        # ISO week
    if profile == "nn":
        month, quarter, dow, week = (c.cast("double") for c in (month, quarter, dow, week))
    cols = [month.alias("month")]
    if profile == "base":
        cols.append(F.year(date).alias("year"))
    cols += [quarter.alias("quarter"), dow.alias("day_of_week")]
    if profile == "base":
        cols.append(F.dayofyear(date).alias("day_of_year"))
    cols.append(week.alias("week_of_year"))
    for name, x, period in (("month", month, 12), ("day_of_week", dow, 7), ("week", week, 52)):
        s, c = cyclic(x, period)
        cols += [s.alias(f"{name}_sin"), c.alias(f"{name}_cos")]
    return cols
