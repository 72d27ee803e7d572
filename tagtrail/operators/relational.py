"""Joins, filters and set operations with the reference's semantics, as thin compositions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tagtrail.operators.keyed import SET_LIMIT, Names, collected, count_by, names, skew_join


def left_with_default(left: DataFrame, right: DataFrame, on: Names, defaults: dict[str, object]) -> DataFrame:
    """Left join; named columns take their default where ``right`` has no row."""
    return skew_join(left, right, on, "left").fillna(defaults, subset=list(defaults))


def left_filled(left: DataFrame, right: DataFrame, on: Names, fill: object = 0) -> DataFrame:
    """Left join with nulls of the fill value's type replaced."""
    return skew_join(left, right, on, "left").na.fill(fill)


def outer_filled(left: DataFrame, right: DataFrame, on: Names, fill: object = 0) -> DataFrame:
    """Full outer join with nulls of the fill value's type replaced.

    Spark never splits a hot key of a full outer join. A left join and the rows of ``right`` without a
    partner give the same rows, and adaptive execution may split either: the first on its left rows, the other against
    the distinct keys of ``left``. Null keys meet nothing and stay on both sides.
    """
    met = skew_join(left, right, on, "left")
    return met.unionByName(without_keys(right, left, on), allowMissingColumns=True).na.fill(fill)


def with_keys(df: DataFrame, keys: DataFrame, on: Names) -> DataFrame:
    """Rows whose key is in ``keys``. Nothing is collected, however many keys there are."""
    on = names(on)
    return skew_join(df, keys.select(*on).distinct(), on, "left_semi")


def without_keys(df: DataFrame, keys: DataFrame, on: Names) -> DataFrame:
    """Rows whose key is not in ``keys``."""
    on = names(on)
    return skew_join(df, keys.select(*on).distinct(), on, "left_anti")


def distance_between(df: DataFrame, dist: DataFrame, start: str, end: str, missing: float = -1.0) -> DataFrame:
    """Add the ``distance`` of two places from a matrix kept as a table; duplicates resolve to the nearest."""
    entries = (
        dist.groupBy(F.col("from_place").alias(start), F.col("to_place").alias(end))
        .agg(F.min("distance").alias("distance"))
    )
    return skew_join(df, entries, [start, end], "left").fillna({"distance": missing})


def nested_lookup_table(df: DataFrame, outer: str, inner: str, value: str, limit: int = SET_LIMIT) -> DataFrame:
    """One row per ``outer`` with a map from ``inner`` to the smallest of its values.

    A map is built inside one task. The entries of each ``outer`` are counted, and a map of more than ``limit`` of them is an error that
    names it; :func:`looked_up` answers the same lookups at every size.
    """
    single = df.groupBy(outer, inner).agg(F.min(value).alias(value))
    held = collected(single, outer, F.struct(F.col(inner), F.col(value)), "entries", limit=limit)
    return held.withColumn("entries", F.map_from_entries("entries"))


def looked_up(df: DataFrame, table: DataFrame, outer: str, inner: str, value: str, limit: int = SET_LIMIT) -> DataFrame:
    """``df`` with ``value`` for its ``outer`` and ``inner`` from ``table`` (outer, inner, value), null where there is none.

    Where every ``outer`` has at most ``limit`` entries, each row meets its one map; else it meets its entry by a join on both
    keys. Both give the smallest value of a repeated entry; the number of entries is counted first.
    """
    single = table.where(F.col(inner).isNotNull()).groupBy(outer, inner).agg(F.min(value).alias(value))
    widest = count_by(single, outer).agg(F.max("n")).head()[0]
    if widest is None or widest > limit:
        return skew_join(df, single, [outer, inner], "left")
    maps = nested_lookup_table(single, outer, inner, value, limit)
    return skew_join(df, maps, outer, "left").withColumn(value, F.col("entries")[F.col(inner)]).drop("entries")


def union_all(*frames: DataFrame) -> DataFrame:
    """Bag union, columns matched by name."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
