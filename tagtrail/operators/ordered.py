"""Previous and next event per key.

A window over a key sorts all its rows in one task. Keys are therefore counted first, and the time of a key with more than
``PART_ROWS`` rows is cut into parts at borders taken from its own quantiles: a few numbers a key, for fewer keys than rows /
``PART_ROWS``. A row finds its part by looking its time up in the borders of its key, so all passes agree on it and nothing
is written. The window runs inside (part, key), over one shuffle, and the last events of the parts, few again,
are carried to the next one. The result is that of the whole window, wherever the borders lie.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from tagtrail.functions.dates import hours_between
from tagtrail.operators.keyed import Names, count_by, latest_rows, names
from tagtrail.session import materialize

PART_ROWS = 1_000_000
#: Parts of the largest key at most; more rows than that make larger parts.
MOST_PARTS = 4096


def with_neighbour(
    df: DataFrame,
    key: Names,
    ts: str,
    carry: Names,
    out: str,
    direction: str = "prev",
    tie: Names = (),
    ranges: int | None = None,
) -> DataFrame:
    """Add ``out``, a struct of the ``carry`` columns of the neighbouring event of the same key.

    Events of one key at one time collapse to the one with the smallest
    ``tie`` columns. ``out`` is null for the first (or last) event. Rows with a null
    key have no neighbours and are left out; a null time comes before all others. ``ranges`` sets how many parts the whole table would
    have; by default a part has ``PART_ROWS`` rows.
    """
    key, carry, tie = names(key), names(carry), names(tie)
    step = {"prev": F.lag, "next": F.lead}[direction]
    neighbour = F.struct(*carry)
    for k in key:
        df = df.where(F.col(k).isNotNull())
    dealt, cut = _parted(df, key, ts, ranges)

    part = ["_part", *key]
    window = Window.partitionBy(*part).orderBy(ts, *tie)
    single = dealt.withColumn("_before", F.lag(F.struct(ts)).over(window))
    single = single.where(F.col("_before").isNull() | ~F.col("_before")[ts].eqNullSafe(F.col(ts))).drop("_before")
    linked = single.withColumn(out, step(neighbour).over(window))
    if cut is None:
        return linked.drop("_part")
    border = F.col(ts).desc() if direction == "prev" else F.col(ts).asc()
    ends = latest_rows(dealt.join(F.broadcast(cut), key, "left_semi"), part, [border, *[F.col(c).asc() for c in tie]])
    bridge = ends.select(*part, step(neighbour).over(Window.partitionBy(*key).orderBy("_part")).alias("_bridge"))
    return (
        linked.join(F.broadcast(bridge), part, "left")  # a row for each part of a cut key
        .withColumn(out, F.coalesce(F.col(out), F.col("_bridge")))
        .drop("_bridge", "_part")
    )


def _parted(df: DataFrame, key: list[str], ts: str, ranges: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Rows with their ``_part``, and the keys that have several; None if no key has too many rows."""
    sizes = count_by(df.select(*key), key)
    most = PART_ROWS
    if ranges:
        most = max(1, math.ceil((sizes.agg(F.sum("n")).head()[0] or 0) / ranges))
    crowded = materialize(sizes.where(F.col("n") > most), "crowded")
    largest = crowded.agg(F.max("n")).head()[0]
    if largest is None:
        return df.withColumn("_part", F.lit(0)), None
    parts = min(MOST_PARTS, math.ceil(largest / most))
    grid = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    rows = df.join(F.broadcast(crowded.select(*key)), key, "left_semi").select(*key, ts)
    borders = materialize(rows.groupBy(*key).agg(F.array_distinct(F.percentile_approx(ts, grid)).alias("_borders")), "borders")
    place = F.size(F.filter("_borders", lambda b: b < F.col(ts)))
    placed = df.join(F.broadcast(borders), key, "left").withColumn("_part", F.when(F.col("_borders").isNull(), 0).otherwise(place))
    return placed.drop("_borders"), borders.select(*key)


def previous_event(df: DataFrame, key: Names, ts: str, carry: Names, tie: Names = (), **how) -> DataFrame:
    """Each event with ``prev_<column>`` of the event before it."""
    carry = names(carry)
    linked = with_neighbour(df, key, ts, carry, "_prev", "prev", tie, **how)
    return linked.select("*", *[F.col("_prev")[c].alias(f"prev_{c}") for c in carry]).drop("_prev")


def next_event(df: DataFrame, key: Names, ts: str, carry: Names, tie: Names = (), **how) -> DataFrame:
    """Each event with ``next_<column>`` of the event after it."""
    carry = names(carry)
    linked = with_neighbour(df, key, ts, carry, "_next", "next", tie, **how)
    return linked.select("*", *[F.col("_next")[c].alias(f"next_{c}") for c in carry]).drop("_next")


def transitions(
    df: DataFrame, key: str, ts: str, place: str, carry: Names = (), tie: Names = (), **how
) -> DataFrame:
    """Consecutive events of a key at two different places, with the whole hours between.

    Columns: the key, ``from_*`` and ``to_*`` for time, place and ``carry``, and ``hours``.
    """
    fields = [ts, place, *names(carry)]
    linked = with_neighbour(df.select(key, *fields), key, ts, fields, "_prev", "prev", tie or place, **how)
    return (
        linked.where(F.col("_prev").isNotNull())
        .select(
            key,
            *[F.col("_prev")[c].alias(f"from_{c}") for c in fields],
            *[F.col(c).alias(f"to_{c}") for c in fields],
        )
        .where(F.col(f"from_{place}") != F.col(f"to_{place}"))
        .withColumn("hours", hours_between(f"from_{ts}", f"to_{ts}"))
    )
