"""Latest event per key, entities with several values, and the history at the last place."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tagtrail.functions.dates import recency, through_day
from tagtrail.functions.numeric import flag
from tagtrail.operators.keyed import Names, latest_rows, names, valued_pairs


def last_event(df: DataFrame, key: Names, ts: str, as_of: str | None = None, tie: Names = ()) -> DataFrame:
    """The latest whole row per key on or before the day ``as_of``.

    Equal times resolve to the smallest ``tie`` columns. The date test is a
    range on the raw column and reaches the scan.
    """
    if as_of is not None:
        df = df.where(through_day(ts, as_of))
    return latest_rows(df, key, [F.col(ts).desc(), *[F.col(c).asc() for c in names(tie)]])


def first_event(df: DataFrame, key: Names, ts: str, tie: Names = ()) -> DataFrame:
    return latest_rows(df, key, [F.col(c).asc() for c in [ts, *names(tie)]])


def multi_valued_latest(df: DataFrame, entity: Names, value: str, ts: str) -> DataFrame:
    """Entities with more than one distinct value, and the latest of their values.

    Rows first reduce to the latest time of each value, which hashes; only those
    few are compared. More than one distinct value means that the smallest and largest differ,
    so one aggregation answers both questions.
    """
    entity = names(entity)
    reduced = df.where(F.col(value).isNotNull()).groupBy(*entity, value).agg(F.max(ts).alias(ts))
    return (
        reduced.groupBy(*entity)
        .agg(
            F.min(value).alias("_low"),
            F.max(value).alias("_high"),
            F.min(F.struct(recency(ts).alias("_age"), F.col(value), F.col(ts))).alias("_last"),
        )
        .where(F.col("_low") != F.col("_high"))
        .select(*entity, F.col("_last")[value].alias(value), F.col("_last")[ts].alias(ts))
    )


def multi_values(df: DataFrame, entity: str, value: str) -> DataFrame:
    """All values of entities with more than one, a row each."""
    return valued_pairs(df, entity, value).where(F.col("n_values") > 1)


def history_vector(df: DataFrame, key: str, place: str, ts: str, n: int = 7) -> DataFrame:
    """The latest place per key, with flags for visits to it 1..n days before the latest visit.

    Events first shrink to one row per (key, place, day); the rest works on those.
    """
    known = df.where(F.col(key).isNotNull() & F.col(place).isNotNull())
    daily = known.groupBy(key, place, F.to_date(ts).alias("_day")).agg(F.max(ts).alias("last_ts"))
    last = latest_rows(daily, key, [F.col("last_ts").desc(), F.col(place).asc()]).withColumnRenamed(
        "_day", "_last_day"
    )
    # Both sides keep the same columns, so Spark shuffles the daily rows once and reuses them.
    visits = daily.withColumnRenamed("last_ts", "_seen")
    back = F.datediff("_last_day", "_day")
    return (
        last.join(visits, [key, place])
        .where(F.col("_seen") <= F.col("last_ts"))
        .groupBy(key, place, "last_ts")
        .agg(*[F.max(flag(back == i)).alias(f"day_{i}") for i in range(1, n + 1)])
    )
