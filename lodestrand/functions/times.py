"""Periods, schedules and retention as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def period(ts: Column, kind: str) -> Column:
    """The key of a day, a month, or a week: the calendar year with the ISO week, as in the keys that budgets use."""
    if kind == "weekly":
        return F.concat(F.year(ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
    return F.date_format(ts, {"daily": "yyyy-MM-dd", "monthly": "yyyy-MM"}[kind])


def cron(ts: Column, schedule: str) -> Column:
    """Whether a time meets a five-field schedule of '*' and numbers; Monday is day 0."""
    fields = schedule.split()
    if len(fields) != 5:
        raise ValueError("a schedule has five fields")
    parts = (F.minute(ts), F.hour(ts), F.dayofmonth(ts), F.month(ts), F.weekday(ts))
    out = F.lit(True)
    for field, part in zip(fields, parts, strict=True):
        if field != "*":
            out = out & (part == int(field))
    return out


def expired(ts: Column, days: int, as_of: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(days)) < as_of
