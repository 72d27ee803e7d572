"""Features of a key's visits for predicting the next day.

Days before the date D are kept as bits of 64-bit words, so that distinct
active days and day flags are OR-ed together inside one hash aggregation on
the key, combined before the shuffle and without a distinct count.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tagtrail.functions.dates import before_day, days_before, on_day, on_or_after, through_day
from tagtrail.functions.numeric import flag, half_even, ratio
from tagtrail.operators.keyed import latest_rows, lookup, skew_join

_WORD = 64


def _bit(offset: Column) -> Column:
    """1 shifted left by ``offset``, which must lie in 0..63."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), offset)


def _day_words(back: Column, days: int) -> list[Column]:
    """Aggregates whose bits mark the days 1..``days`` before D that occur."""
    words = []
    for first in range(1, days + 1, _WORD):
        last = min(first + _WORD - 1, days)
        words.append(F.bit_or(F.when(back.between(first, last), _bit(back - first)).otherwise(F.lit(0).cast("long"))))
    return words


def _place_mask(back: Column, at_place: Column, n: int) -> Column:
    seen = F.when(at_place & back.between(1, n), _bit(back - 1)).otherwise(F.lit(0).cast("long"))
    return F.bit_or(seen)


def _flags(mask: str, n: int) -> list[Column]:
    return [F.getbit(F.col(mask), F.lit(i - 1)).cast("int").alias(f"pre_{i}") for i in range(1, n + 1)]


def _check_days(n: int) -> None:
    if not 1 <= n <= _WORD:
        raise ValueError(f"n must be between 1 and {_WORD}")


def presence_flags(df: DataFrame, key: str, place: str, ts: str, at: str, on: str, n: int = 7) -> DataFrame:
    """For keys seen at ``at`` within the n days before ``on``: flags pre_1..pre_n, one per day."""
    _check_days(n)
    back = days_before(on, ts)
    window = df.where((F.col(place) == at) & before_day(ts, on) & (back <= n))
    return window.groupBy(key).agg(_place_mask(back, F.lit(True), n).alias("_mask")).select(key, *_flags("_mask", n))


def active_day_ratio(df: DataFrame, key: str, ts: str, on: str, start: str | None = None) -> DataFrame:
    """Distinct active days before ``on`` over the days since the first of them, half-even to 4 digits."""
    back = days_before(on, ts)
    before = df.where(before_day(ts, on))
    if start is None:
        per_day = before.select(key, back.alias("_back")).distinct()
        counted = per_day.groupBy(key).agg(F.count(F.lit(1)).alias("active_days"), F.max("_back").alias("span_days"))
    else:
        span = (date.fromisoformat(on) - date.fromisoformat(start)).days
        words = _day_words(back, span)
        names = [f"_w{i}" for i in range(len(words))]
        counted = (
            before.where(on_or_after(ts, start))
            .groupBy(key)
            .agg(*[w.alias(c) for w, c in zip(words, names)], F.max(back).alias("span_days"))
            .withColumn("active_days", _bits(names))
            .drop(*names)
        )
    return counted.select(
        key,
        F.col("active_days").cast("long").alias("active_days"),
        "span_days",
        half_even(ratio(F.col("active_days").cast("double"), F.col("span_days").cast("double"))).alias("days_ratio"),
    )


def _bits(words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.bit_count(F.col(w)) for w in words], F.lit(0))


def _latest_distance(
    df: DataFrame, dist: DataFrame, key: str, place: str, ts: str, at: str, on: str, missing: float
) -> DataFrame:
    day_before = df.where(on_day(ts, on, -1)).select(key, place, ts)
    last = latest_rows(day_before, key, [F.col(ts).desc(), F.col(place).asc()])
    from_here = dist.where(F.col("from_place") == at).select(F.col("to_place").alias(place), "distance")
    return lookup(last, from_here, place, "distance", F.lit(missing))


def proximity(
    df: DataFrame,
    dist: DataFrame,
    key: str,
    place: str,
    ts: str,
    at: str,
    on: str,
    near: float = 500.0,
    far: float = 1000.0,
    missing: float = -1.0,
) -> DataFrame:
    """The latest place of each key on the day before ``on``, its distance from ``at``, and two flags.

    ``nearer`` for a distance between 0 and ``near``, ``distant`` above ``far``,
    neither in between or without a known distance.
    """
    d = F.col("distance")
    return _latest_distance(df, dist, key, place, ts, at, on, missing).select(
        key,
        place,
        "distance",
        flag((d > 0) & (d < near)).alias("nearer"),
        flag(d > far).alias("distant"),
    )


def label_on_day(df: DataFrame, key: str, place: str, ts: str, at: str, on: str) -> DataFrame:
    """For every key of ``df``: 1 if it has an event at ``at`` on the day ``on``, else 0."""
    hit = (F.col(place) == at) & on_day(ts, on)
    return df.groupBy(key).agg(F.max(flag(hit)).alias("txn_on_day"))


def feature_table(
    df: DataFrame,
    dist: DataFrame,
    key: str,
    place: str,
    ts: str,
    at: str,
    on: str,
    start: str,
    n: int = 7,
    how: str = "outer",
    near: float = 500.0,
    far: float = 1000.0,
) -> DataFrame:
    """Label, proximity, activity ratio and presence flags of each key, nulls as 0.

    Events from ``start`` through ``on`` count. ``how`` decides the keys:
    ``outer`` takes every key, ``left`` those active before ``on``, ``inner``
    those that were also at ``at`` within the n days before it.

    One scan feeds a single hash aggregation for all but the proximity, which
    looks only at the day before ``on``; both come out partitioned by key and
    join without another shuffle of either.
    """
    _check_days(n)
    if how not in ("outer", "left", "inner"):
        raise ValueError(f"unknown how: {how}")
    window = df.where(on_or_after(ts, start) & through_day(ts, on))
    back = days_before(on, ts)
    span = (date.fromisoformat(on) - date.fromisoformat(start)).days
    words = _day_words(back, span)
    word_names = [f"_w{i}" for i in range(len(words))]
    at_place = F.col(place) == at
    per_key = window.groupBy(key).agg(
        *[w.alias(c) for w, c in zip(words, word_names)],
        F.max(F.when(back >= 1, back)).alias("_span"),
        _place_mask(back, at_place, n).alias("_mask"),
        F.max(flag(at_place & (back == 0))).alias("txn_on_day"),
    )
    if how != "outer":
        per_key = per_key.where(F.col("_span").isNotNull())
    if how == "inner":
        per_key = per_key.where(F.col("_mask") != 0)
    close = proximity(window, dist, key, place, ts, at, on, near, far).select(key, "nearer", "distant")
    days_ratio = half_even(ratio(_bits(word_names).cast("double"), F.col("_span").cast("double")))
    return (
        per_key.join(close, key, "left")
        .select(key, "txn_on_day", "nearer", "distant", days_ratio.alias("days_ratio"), *_flags("_mask", n))
        .na.fill(0)
    )


def reached_cohort(
    ends: DataFrame,
    events: DataFrame,
    master: DataFrame,
    key: str,
    place: str,
    ts: str,
    input_place: Column,
    on: str,
    fan_out: bool = False,
) -> DataFrame:
    """Keys that were at one of the ``ends`` on the day before ``on``, with their events at the input place.

    Left joins the events where ``input_place`` holds on ``on`` and the day
    after, then the key master; null strings become "0". With ``fan_out`` a
    key with several events on those days gives a row for each combination,
    since the joins do not deduplicate. Without it each row has the earliest
    event and the number of events, and its count of rows cannot grow.
    """
    cohort = events.where(on_day(ts, on, -1)).select(key, place, F.col(ts).cast("string").alias("time"))
    cohort = skew_join(cohort, ends.select(place).distinct(), place)
    at_input = events.where(input_place).select(key, ts)
    out = cohort
    for shift, name in ((0, "input"), (1, "next")):
        seen = at_input.where(on_day(ts, on, shift))
        if fan_out:
            day = seen.select(key, F.col(ts).cast("string").alias(f"{name}_time"), F.lit("1").alias(f"txn_{name}_day"))
        else:
            day = seen.groupBy(key).agg(
                F.min(ts).cast("string").alias(f"{name}_time"),
                F.lit("1").alias(f"txn_{name}_day"),
                F.count(F.lit(1)).cast("string").alias(f"{name}_events"),
            )
        out = skew_join(out, day, key, "left")
    return skew_join(out, master, key, "left").na.fill("0")
