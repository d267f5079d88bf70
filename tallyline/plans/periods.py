"""Bounds of the named periods and roll-ups in them (CV-9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("7d", "14d", "30d", "90d", "week", "lastweek", "month", "lastmonth", "year", "all")


# Fixed definitions. Of a period that begins with a unit of the calendar: the unit, how many units back it begins, and whether it is that whole unit.
CALENDAR = {"week": ("week", 0, False), "lastweek": ("week", 1, True), "month": ("month", 0, False), "lastmonth": ("month", 1, True), "year": ("year", 0, False)}
# Months in a unit; a week counts in days.
MONTHS = {"month": 1, "year": 12}
#: Periods of so many days up to today.
DAYS = {k: int(k[:-1]) for k in KEYS if k[:-1].isdigit()}


def _back(day: Column, unit: str, n: int) -> Column:
    return F.add_months(day, -n * MONTHS[unit]) if unit in MONTHS else F.date_sub(day, 7 * n)


def bounds(key: str, today: Column, first: Column) -> tuple[Column, Column, Column, Column]:
    """since, until, and the same of the period before (null for all), as inclusive dates.

    The period before ends as far into its unit as this one does, and never beyond the unit.
    """
    none = F.lit(None).cast("date")
    if key in DAYS:
        since = F.date_sub(today, DAYS[key] - 1)
        return since, today, F.date_sub(since, DAYS[key]), F.date_sub(since, 1)
    if key not in CALENDAR:
        return first, today, none, none
    unit, back, whole = CALENDAR[key]
    since = _back(F.trunc(today, unit), unit, back)
    before = _back(since, unit, 1)
    if whole:
        return since, F.date_sub(_back(since, unit, -1), 1), before, F.date_sub(since, 1)
    return since, today, before, F.least(_back(today, unit, 1), F.date_sub(since, 1))


def table(days: DataFrame, day: str, today: Column, first: Column) -> DataFrame:
    """Every period with its bounds beside one row of ``days``."""
    rows = []
    for k in KEYS:
        s, u, ps, pu = bounds(k, today, first)
        rows.append(F.struct(F.lit(k).alias("period"), s.alias("since"), u.alias("until"), ps.alias("prev_since"), pu.alias("prev_until")))
    return days.select(day, F.explode(F.array(*rows)).alias("p")).select(day, "p.*")


def trend(now: Column, before: Column) -> Column:
    """Change in percent, null where there is nothing to compare (SF-38)."""
    return F.when((before != 0) & before.isNotNull() & now.isNotNull(), F.round((now - before) / F.abs(before) * 100, 1))
