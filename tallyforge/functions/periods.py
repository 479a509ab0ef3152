"""Periods: the days that a period's key covers, week keys, and calendar steps of cadences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cadences in order, their days, and how many there are in a year.
CADENCES = {"weekly": 7, "fortnightly": 14, "monthly": 30, "bimonthly": 61, "quarterly": 91, "semiannual": 182, "annual": 365}
PER_YEAR = {"weekly": 52, "fortnightly": 26, "monthly": 12, "bimonthly": 6, "quarterly": 4, "semiannual": 2, "annual": 1, "irregular": 0}
_MONTHS = {"monthly": 1, "bimonthly": 2, "quarterly": 3, "semiannual": 6, "annual": 12}


def bounds(period: Column) -> Column:
    """(first, last) day of ``2026``, ``2026-Q3``, ``2026-09``, ``2026-W39`` or ``2026-09-01``; null for any other text."""
    year = F.substring(period, 1, 4).try_cast("int")
    start = F.make_date(year, F.lit(1), F.lit(1))
    quarter = F.add_months(start, (F.substring(period, 7, 1).try_cast("int") - 1) * 3)
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    monday = F.date_sub(fourth, F.weekday(fourth))
    week = F.date_add(monday, (F.substring(period, 7, 2).try_cast("int") - 1) * 7)
    month, day = F.concat(period, F.lit("-01")).try_cast("date"), period.try_cast("date")
    span = lambda a, b: F.struct(a.alias("first"), b.alias("last"))
    out = F.when(period.rlike(r"^\d{4}-\d{2}-\d{2}$") & day.isNotNull(), span(day, day)).when(period.rlike(r"^\d{4}$"), span(start, F.make_date(year, F.lit(12), F.lit(31))))
    out = out.when(period.rlike(r"^\d{4}-Q[1-4]$"), span(quarter, F.date_sub(F.add_months(quarter, 3), 1))).when(period.rlike(r"^\d{4}-\d{2}$") & month.isNotNull(), span(month, F.last_day(month)))
    return out.when(period.rlike(r"^\d{4}-W\d{2}$"), span(week, F.date_add(week, 6)))


def week_key(day: Column) -> Column:
    """The ISO week of a day, as ``2026-W39``."""
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), day).cast("int"), F.weekofyear(day))


def step(anchor: Column, cadence: Column, k: Column) -> Column:
    """The anchor and k periods: months are counted from the anchor, so a short month doesn't move later ones; null if irregular."""
    months = F.coalesce(*[F.when(cadence == name, F.lit(m)) for name, m in _MONTHS.items()])
    return F.when(cadence == "weekly", F.date_add(anchor, (7 * k).cast("int"))).when(cadence == "fortnightly", F.date_add(anchor, (14 * k).cast("int"))).otherwise(F.add_months(anchor, (months * k).cast("int")))


def days_of(cadence: Column) -> Column:
    return F.coalesce(*[F.when(cadence == name, F.lit(d)) for name, d in CADENCES.items()])


def per_year(cadence: Column) -> Column:
    return F.coalesce(*[F.when(cadence == name, F.lit(n)) for name, n in PER_YEAR.items()])


def tolerance(days: Column) -> Column:
    """How far a gap may be off a cadence of so many days."""
    return F.greatest(F.lit(2.0), 0.2 * days)


def cadence_due(last_ms: Column, now_ms: Column, interval_ms: Column) -> Column:
    """Whether now is in another aligned interval than the last run; an interval of 0 is never due."""
    return F.when(interval_ms == 0, False).otherwise(F.floor(now_ms / interval_ms) != F.floor(last_ms / interval_ms))
