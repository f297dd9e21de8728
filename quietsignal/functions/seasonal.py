"""Season of a time stamp, as further key columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)


def weekday_or_weekend(ts: Column) -> Column:
    """0 from Monday to Friday, 1 on the weekend."""
    return F.when(F.weekday(ts) < 5, 0).otherwise(1)


def night_or_hour(ts: Column, night_from: int = 20, night_to: int = 7) -> Column:
    """-1 at night (from ``night_from`` up to and with ``night_to``), else the hour."""
    h = F.hour(ts)
    return F.when((h >= night_from) | (h <= night_to), -1).otherwise(h)


SEASONS = {"hourOfDay": hour_of_day, "weekDayOrWeekendOfWeek": weekday_or_weekend, "nightDayHourOfDay": night_or_hour}


def season(kind: str, ts: Column) -> Column:
    if kind not in SEASONS:
        raise ValueError(f"unknown season {kind!r}")
    return SEASONS[kind](ts)
