"""Most frequent category, neighbour or amount per key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tagtrail.functions.numeric import percent
from tagtrail.functions.text import TAG_LENGTH, TAG_PREFIX, clean_tag
from tagtrail.operators.keyed import SET_LIMIT, Names, collected, lookup, names, winner_by_count


def dominant_category(
    df: DataFrame,
    key: str,
    category: str,
    min_share: float = 0.25,
    strict: bool = False,
    unless: Column | None = None,
) -> DataFrame:
    """The most frequent category per key, its count, the key's total and the share.

    Keeps a share of at least ``min_share``, or above it if ``strict``. Ties go
    to the smallest category. Keys with any row that meets ``unless`` are left
    out, in the same pass.
    """
    veto = F.lit(False) if unless is None else F.coalesce(unless, F.lit(False))
    if unless is None:
        df = df.where(F.col(category).isNotNull())
    counted = df.groupBy(key, category).agg(F.count(category).alias("n"), F.max(veto).alias("_veto"))
    best = F.min(F.when(F.col(category).isNotNull(), F.struct((-F.col("n")).alias("_neg"), F.col(category))))
    share = F.col("count") / F.col("total")
    return (
        counted.groupBy(key)
        .agg(best.alias("_best"), F.sum("n").alias("total"), F.max("_veto").alias("_veto"))
        .where(~F.col("_veto") & F.col("_best").isNotNull())
        .select(
            key,
            F.col("_best")[category].alias(category),
            (-F.col("_best")["_neg"]).alias("count"),
            "total",
        )
        .withColumn("share", share)
        .where(F.col("share") > min_share if strict else F.col("share") >= min_share)
    )


def tag_state(
    txn: DataFrame,
    codes: DataFrame,
    tag: str = "tag",
    state: str = "state",
    code: str = "code",
    prefix: str = TAG_PREFIX,
    band: tuple[int, int] = TAG_LENGTH,
    min_share: float = 0.25,
) -> DataFrame:
    """The dominant state of each well-formed tag as a code, or the tag itself without one."""
    clean = txn.where(clean_tag(tag, prefix, band) & F.col(state).isNotNull())
    best = dominant_category(clean, tag, state, min_share)
    return lookup(best, codes, state, code, F.col(tag)).select(tag, state, "count", "total", code)


def dominant_neighbour(
    trans: DataFrame, by: Names, neighbour: Names, hours: bool = False, joined: str | None = None, limit: int = SET_LIMIT
) -> DataFrame:
    """The most frequent ``neighbour`` of each ``by`` in a table of transitions.

    Gives its count, the total, the percentage and, if asked, the mean hours to
    it and the sorted, pipe-joined ``joined`` values seen with it. Transitions
    are counted per distinct combination first; a set of more than ``limit`` values is an error that names
    its group, see :func:`tagtrail.operators.keyed.collected`.
    """
    by, neighbour = names(by), names(neighbour)
    fine = [*by, *neighbour] + ([joined] if joined else [])
    counted = trans.groupBy(*fine).agg(F.count(F.lit(1)).alias("n"), F.sum("hours").alias("_hours"))
    extra = ["_hours"]
    if joined:
        sums = [F.sum("n").alias("n"), F.sum("_hours").alias("_hours")]
        counted = collected(counted, [*by, *neighbour], F.col(joined), "_joined", sums, limit)
        counted = counted.withColumn("_joined", F.array_join("_joined", "|"))
        extra.append("_joined")
    best = winner_by_count(counted, by, neighbour, "n", extra)
    columns = [*by, *neighbour, "count", "total", percent("count", "total").alias("percent")]
    if hours:
        columns.append((F.col("_hours") / F.col("count")).alias("mean_hours"))
    if joined:
        columns.append(F.col("_joined").alias("lanes"))
    return best.select(*columns)


def with_modal_key(freq: DataFrame, key: Names, amount: str = "amount") -> DataFrame:
    """The rows that may give a modal amount: not zero, and no part of the key null or blank."""
    named = reduce(lambda a, b: a & b, [F.trim(F.col(c).cast("string")) != "" for c in names(key)])
    return freq.where((F.col(amount) != 0) & named)


def modal_amount(freq: DataFrame, key: Names, amount: str = "amount", frequency: str = "frequency") -> DataFrame:
    """The most frequent non-zero amount per key; ties go to the smallest amount.

    Rows are counted tables (amount, frequency), so the highest single
    frequency decides, as in the reference data's frequency tables. A null or blank key has no modal amount.
    """
    key = names(key)
    return (
        with_modal_key(freq, key, amount)
        .groupBy(*key)
        .agg(F.min(F.struct((-F.col(frequency)).alias("_neg"), F.col(amount))).alias("_best"))
        .select(*key, F.col("_best")[amount].alias(amount), (-F.col("_best")["_neg"]).alias(frequency))
    )
