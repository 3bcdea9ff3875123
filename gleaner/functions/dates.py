"""Dates, periods and ages; every function takes the day as a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import java

# Accelerator seasons and the month in which each starts.
SEASON_MONTH = {"W": "01", "SP": "04", "X": "04", "S": "06", "F": "09"}
#: Ways in which sources write a date, tried in order; a leading weekday is passed over.
FORMATS = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "M/d/yyyy")


def _without_weekday(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s*[A-Za-z]{3},\s*", "")


def iso_date(text: Column) -> Column:
    """A date from its ISO start, else from one of ``FORMATS``; null if neither fits."""
    start = F.regexp_extract(text, r"^\s*(\d{4}-\d{2}-\d{2})", 1)
    return F.coalesce(F.try_to_timestamp(F.nullif(start, F.lit("")), F.lit("yyyy-MM-dd")).cast("date"), *(F.try_to_timestamp(_without_weekday(text), F.lit(f)).cast("date") for f in FORMATS))


def feed_timestamp(text: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text), *(F.try_to_timestamp(_without_weekday(text), F.lit(f)) for f in FORMATS))


def days_between(a: Column, b: Column) -> Column:
    """Whole days from a to b, rounded; timestamps count with their time."""
    return F.floor((F.unix_timestamp(b.cast("timestamp")) - F.unix_timestamp(a.cast("timestamp"))) / 86400.0 + 0.5).cast("int")


def age_in_days(at: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 86_400_000_000


def week_start(at: Column) -> Column:
    """Monday, midnight."""
    return F.date_trunc("week", at)


def in_period(at: Column, period: str, now: Column) -> Column:
    """Whether ``at`` falls in all-time, this-month, last-month, this-year or last-year; ends are open."""
    if period == "all-time":
        return F.lit(True)
    unit = "month" if period.endswith("month") else "year"
    this = F.date_trunc(unit, now)
    step = F.expr("interval 1 month" if unit == "month" else "interval 1 year")
    low, high = (this, this + step) if period.startswith("this") else (this - step, this)
    return (at >= low) & (at < high)


def month_of(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def batch_date(batch: Column) -> Column:
    """The day from which a batch such as W25 or SP24 counts; null for other text."""
    pattern = java(r"(?i)^\s*(W|SP|S|F|X)\s?'?(\d{2})\b")
    season, year = F.upper(F.regexp_extract(batch, pattern, 1)), F.regexp_extract(batch, pattern, 2)
    month = F.element_at(F.create_map(*(F.lit(x) for kv in SEASON_MONTH.items() for x in kv)), F.nullif(season, F.lit("")))
    return F.to_date(F.concat(F.lit("20"), F.nullif(year, F.lit("")), F.lit("-"), month, F.lit("-01")))


def batch_year(accelerator: Column) -> Column:
    """The year of the batch that an accelerator's name carries; null without one."""
    year = F.regexp_extract(accelerator, java(r"(?i)\b(?:W|S|F|Sp|X)(\d{2})\b"), 1)
    return F.nullif(year, F.lit("")).cast("int") + 2000


def long_date(at: Column) -> Column:
    return F.date_format(at, "MMMM d, yyyy")


def is_due(last: Column, now: Column, cadence: Column) -> Column:
    """Whether a weekly or biweekly run is due; one that never ran is."""
    days = F.when(cadence == "weekly", 7).when(cadence == "biweekly", 14)
    return F.coalesce(age_in_days(last, now) >= days, last.isNull() & days.isNotNull(), F.lit(False))
