"""Building blocks shared by the per-key operators.

None of them brings a whole group into one task: counts and extremes combine
before the shuffle, latest-row searches keep one row per key and map task, and
the values of a key are rows, not lists.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

Names = str | Iterable[str]
#: Values that a list in one row may hold.
SET_LIMIT = 100_000


def names(value: Names) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def _common(key: Column, kind: str, other: str) -> Column:
    """The key in a type in which equal keys of both types hash alike."""
    integral = ("tinyint", "smallint", "int", "bigint")
    real = lambda k: k in ("float", "double") or k.startswith("decimal")
    if kind in integral and other in integral:
        return key.cast("bigint")
    if (real(kind) or real(other)) and all(real(k) or k in integral for k in (kind, other)):
        return key.cast("double") + F.lit(0.0)  # makes a negative zero a zero
    if kind == other:
        return key
    return key.cast(other if kind == "string" else kind if other == "string" else "timestamp")


def skew_join(rows: DataFrame, per_key: DataFrame, on: Names, how: str = "inner") -> DataFrame:
    """Join rows to a table that is already combined per key, so that a hot key can be split.

    The adaptive skew join only splits a side when both sides come straight
    from a shuffle. A table grouped by the join key does not: Spark reuses the
    grouping's partitions. Joining on a hash of the key besides the key makes
    it shuffle the small, combined side once more, and the split applies.
    """
    on = names(on)
    kinds, others = dict(rows.dtypes), dict(per_key.dtypes)
    spread = F.xxhash64(*[_common(F.col(c), kinds[c], others[c]) for c in on])
    joined = rows.withColumn("_spread", spread).join(per_key.withColumn("_spread", spread), [*on, "_spread"], how)
    return joined.drop("_spread")


def latest_rows(df: DataFrame, key: Names, order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows per key in ``order``, which must be a total order.

    Spark limits each key inside the map tasks before the shuffle, so a key
    with any number of rows sends at most ``n`` rows from each of them.
    """
    window = Window.partitionBy(*names(key)).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n).drop("_rank")


def count_by(df: DataFrame, key: Names, out: str = "n") -> DataFrame:
    return df.groupBy(*names(key)).agg(F.count(F.lit(1)).alias(out))


def winner_by_count(
    counted: DataFrame, key: Names, payload: Names, count: str = "n", extra: Names = ()
) -> DataFrame:
    """The payload with the highest count per key, its count and the key's total.

    Ties go to the smallest payload. ``extra`` columns ride along with the
    winner. One aggregation: the minimum of (-count, payload) and a sum.
    """
    key, payload, extra = names(key), names(payload), names(extra)
    best = F.min(F.struct((-F.col(count)).alias("_neg"), *payload, *extra)).alias("_best")
    return (
        counted.groupBy(*key)
        .agg(best, F.sum(count).alias("total"))
        .select(
            *key,
            *[F.col("_best")[c].alias(c) for c in payload],
            (-F.col("_best")["_neg"]).alias("count"),
            "total",
            *[F.col("_best")[c].alias(c) for c in extra],
        )
    )


def share_of_total(counted: DataFrame, key: Names, count: str = "n", out: str = "percent") -> DataFrame:
    """Each counted row's percentage of its key's total.

    Totals combine before their shuffle and join back, so a key with many
    categories is split by the skew join and not held by one window task.
    """
    key = names(key)
    totals = counted.groupBy(*key).agg(F.sum(count).alias("total"))
    return skew_join(counted, totals, key).withColumn(out, F.col(count) * 100.0 / F.col("total"))


def valued_pairs(df: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct (key, value) pairs and ``n_values``, the number of values of the key.

    This is the shape of a key's values for every size of key. Rows with a null key or value are left out.
    """
    pairs = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, value).distinct()
    return skew_join(pairs, count_by(pairs, key, "n_values"), key)


def collected(
    df: DataFrame, group: Names, entry: Column, name: str, aggregates: Iterable[Column] = (), limit: int = SET_LIMIT
) -> DataFrame:
    """One row per group with ``entry`` of its rows as a sorted list ``name``, next to other ``aggregates``.

    The rows of a group are counted before any is gathered, over the shuffle that the grouping needs anyway. A group of more than ``limit`` rows
    is gathered nowhere: it is an error that names the group and its size. The form without a limit is
    :func:`valued_pairs`, a row per key and value. Null entries are left out.
    """
    group = names(group)
    sized = df.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(*group)))
    fits = F.col("_size") <= limit
    held = F.array_sort(F.collect_list(F.when(fits, entry))).alias(name)
    out = sized.groupBy(*group).agg(*aggregates, held, F.max("_size").alias("_size"))
    which = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in group]
    size = F.concat(F.lit("size="), F.col("_size").cast("string"))
    error = F.concat(F.lit(f"a group has more than {limit} values: "), F.concat_ws(", ", *which, size))
    return out.withColumn(name, F.when(fits, F.col(name)).otherwise(F.raise_error(error))).drop("_size")


def lookup(df: DataFrame, dim: DataFrame, on: Names, value: str, default: Column | None = None) -> DataFrame:
    """Add ``value`` from a dimension, or ``default`` where it has no entry.

    Duplicate dimension keys resolve to the smallest value, so no row is
    multiplied. Whether the dimension is broadcast follows from its size.
    """
    on = names(on)
    entries = dim.where(F.col(value).isNotNull()).groupBy(*on).agg(F.min(value).alias(value))
    out = skew_join(df, entries, on, "left")
    return out if default is None else out.withColumn(value, F.coalesce(F.col(value), default))


def named_top(best: DataFrame, dim: DataFrame, on: str, value: str) -> DataFrame:
    """:func:`lookup` for a result cut to k rows.

    The k rows are broadcast, bounded by k, to pick their few entries out of a
    dimension of any size, which then is neither shuffled nor aggregated whole.
    """
    wanted = F.broadcast(best.select(on))
    return lookup(best, dim.join(wanted, on, "left_semi"), on, value)
