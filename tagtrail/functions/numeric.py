"""Numeric columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tagtrail.functions.dates import col


def fahrenheit(tenths_celsius: Column | str) -> Column:
    """Tenths of a degree Celsius in Fahrenheit."""
    return col(tenths_celsius) * 0.1 * (9.0 / 5.0) + 32.0


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Null instead of an error when the denominator is 0."""
    return F.try_divide(col(numerator), col(denominator))


def speed(distance: Column | str, hours: Column | str, idle_hours: float = 0.5) -> Column:
    """Distance over time, with ``idle_hours`` in place of a time of 0."""
    return col(distance) / F.when(col(hours) != 0, col(hours)).otherwise(F.lit(idle_hours))


def cosine(xy: Column, xx: Column, yy: Column) -> Column:
    """Cosine score from three sums, 0 when a norm is 0."""
    norm = F.sqrt(xx) * F.sqrt(yy)
    return F.when(norm != 0, xy / norm).otherwise(F.lit(0.0))


def percent(part: Column | str, whole: Column | str) -> Column:
    return col(part) * 100.0 / col(whole)


def half_even(c: Column | str, digits: int = 4) -> Column:
    return F.bround(col(c), digits)


def flag(condition: Column) -> Column:
    """1 where true, 0 where false or null."""
    return F.when(condition, 1).otherwise(0)
