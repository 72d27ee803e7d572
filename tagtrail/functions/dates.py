"""Date and time columns.

Timestamps without a zone are compared as they are, never through the session
time zone, so results do not depend on it and filters still reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def moment(text: str) -> Column:
    """A timestamp literal without zone."""
    return F.lit(text).cast("timestamp_ntz")


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def days_before(as_of: str, ts: Column | str) -> Column:
    """Whole calendar days from ``ts`` to ``as_of``."""
    return F.datediff(day(as_of), F.to_date(col(ts)))


def on_or_after(ts: Column | str, date: str) -> Column:
    return col(ts) >= moment(date)


def before_day(ts: Column | str, date: str) -> Column:
    return col(ts) < moment(date)


def through_day(ts: Column | str, date: str) -> Column:
    """``ts`` falls on ``date`` or earlier, as a range on the raw column (pushed to the scan)."""
    return col(ts) < F.date_add(day(date), 1).cast("timestamp_ntz")


def on_day(ts: Column | str, date: str, shift: int = 0) -> Column:
    start = F.date_add(day(date), shift).cast("timestamp_ntz")
    return (col(ts) >= start) & (col(ts) < F.date_add(day(date), shift + 1).cast("timestamp_ntz"))


def hours_between(start: Column | str, end: Column | str) -> Column:
    """Whole hours from ``start`` to ``end``, truncated toward zero."""
    gap = col(end) - col(start)
    return (F.extract(F.lit("DAY"), gap) * 24 + F.extract(F.lit("HOUR"), gap)).cast("long")


def minute_index(ts: Column | str) -> Column:
    """Whole minutes since 1970. Never falls as ``ts`` rises, across changes of the clock too."""
    gap = col(ts) - moment("1970-01-01 00:00:00")
    days, hours, minutes = (F.extract(F.lit(unit), gap) for unit in ("DAY", "HOUR", "MINUTE"))
    return days.cast("long") * 1440 + hours * 60 + minutes.cast("long")


def recency(ts: Column | str) -> Column:
    """An interval that shrinks as ``ts`` grows, so a minimum finds the latest time."""
    return moment("9999-12-31 00:00:00") - col(ts)


def compact_date(date: Column | str) -> Column:
    """``yyyyMMdd``."""
    return F.date_format(col(date), "yyyyMMdd")


def weekday_name(date: Column | str) -> Column:
    return F.date_format(col(date), "EEEE")
