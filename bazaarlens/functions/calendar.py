"""Calendar columns that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_of(ts: Column | str) -> Column:
    return _col(ts).cast("date")


def week_of(ts: Column | str) -> Column:
    """Monday of the week, as DATE."""
    day = day_of(ts)
    return F.date_sub(day, F.weekday(day))


def month_of(ts: Column | str) -> Column:
    """First day of the month, as DATE."""
    return F.trunc(day_of(ts), "month")


def day_of_week(ts: Column | str) -> Column:
    """0 = Sunday … 6 = Saturday."""
    return (F.dayofweek(day_of(ts)) - 1).cast("bigint")


def hour_of(ts: Column | str) -> Column:
    return F.hour(_col(ts)).cast("bigint")


def calendar_month(ts: Column | str) -> Column:
    return F.month(_col(ts)).cast("int")


def boundary_diff(unit: str, start: Column | str, end: Column | str) -> Column:
    """Number of `unit` boundaries crossed from start to end (not elapsed units).

    23:00 → 01:00 on the next day is one day and two hours.
    """
    a, b = _col(start), _col(end)
    if unit == "month":
        months = (F.year(b) - F.year(a)) * 12 + (F.month(b) - F.month(a))
        return months.cast("bigint")
    days = F.datediff(b, a).cast("bigint")
    if unit == "day":
        return days
    hours = days * 24 + F.hour(b) - F.hour(a)
    if unit == "hour":
        return hours
    if unit == "minute":
        return hours * 60 + F.minute(b) - F.minute(a)
    raise ValueError(f"unknown unit {unit!r}; use minute, hour, day or month")


def within_days_after(ts: Column | str, start: Column | str, days: int) -> Column:
    """start < ts ≤ start + days."""
    t, t0 = _col(ts), _col(start)
    return (t > t0) & (t <= t0 + F.make_dt_interval(F.lit(days)))
