"""Calendar expressions."""

from __future__ import annotations

import calendar

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnkit.functions.semantics import as_col


def iso_year(date) -> Column:
    """Year that the ISO week of the date belongs to."""
    return F.extract(F.lit("YEAROFWEEK"), as_col(date)).cast("int")


def iso_week(date) -> Column:
    """ISO week number."""
    return F.weekofyear(as_col(date))


def season_date(date, year: int = 2022) -> Column:
    """The same month and day in one dummy year; 29 February is missing unless that year has one."""
    date = as_col(date)
    shifted = F.make_date(F.lit(year), F.month(date), F.dayofmonth(date))
    if calendar.isleap(year):
        return shifted
    return F.when(~((F.month(date) == 2) & (F.dayofmonth(date) == 29)), shifted)


def week_to_date(week, start: str = "2023-01-01") -> Column:
    """Calendar date of a (fractional) week number counted from ``start``."""
    return F.date_add(F.lit(start).cast("date"), F.floor(as_col(week) * 7).cast("int"))
