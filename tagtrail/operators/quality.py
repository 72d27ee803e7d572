"""Data-quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagtrail.functions.numeric import flag, speed
from tagtrail.functions.text import REGISTRATION_LOOSE, present


def speed_anomaly(
    df: DataFrame,
    limit: float = 150.0,
    key: str = "tag",
    distance: str = "distance",
    hours: str = "time_diff",
    idle_hours: float = 0.5,
) -> DataFrame:
    """Rows whose speed exceeds ``limit``, without rows lacking a key or a previous place.

    "No previous place" shows as a distance that is null or 0.
    """
    known = F.col(key).isNotNull() & F.col(distance).isNotNull() & (F.col(distance) != 0)
    return df.where(known).withColumn("speed", speed(distance, hours, idle_hours)).where(F.col("speed") > limit)


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of either input and of both, in one row and one shuffle."""
    marked = left.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    return (
        marked.groupBy(key)
        .agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
        .agg(
            F.sum("_l").alias("left_keys"),
            F.sum("_r").alias("right_keys"),
            F.sum(F.col("_l") * F.col("_r")).alias("shared_keys"),
        )
    )


def quality_funnel(df: DataFrame, key: str, steps: dict[str, Column]) -> DataFrame:
    """Distinct keys left after each successive filter: (step_no, step, keys_left).

    Each row reaches the first step it fails, each key the furthest of its
    rows, so all counts come from one combined aggregation over the key and
    not from a distinct count per step.
    """
    labels = ["all", *steps]
    passed: Column = F.lit(True)
    depth: Column = F.lit(0)
    for predicate in steps.values():
        passed = passed & F.coalesce(predicate, F.lit(False))
        depth = depth + flag(passed)
    reached = df.groupBy(key).agg(F.max(depth).alias("_depth"))
    counts = [F.sum(flag(F.col("_depth") >= i)).alias(f"_{i}") for i in range(len(labels))]
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("step_no"),
                F.lit(label).alias("step"),
                F.coalesce(F.col(f"_{i}"), F.lit(0)).cast("long").alias("keys_left"),
            )
            for i, label in enumerate(labels)
        ]
    )
    return reached.agg(*counts).select(F.inline(rows))


def match_master(txn: DataFrame, master: DataFrame, on: str) -> DataFrame:
    """Left join to the master table, counted: rows out, and how many found a master row.

    The master side is only counted per key, so a key repeated on both sides
    adds the product of its counts without its pairs ever being built.
    """
    copies = master.groupBy(on).agg(F.count(F.lit(1)).alias("_copies"))
    seen = txn.groupBy(on).agg(F.count(F.lit(1)).alias("_rows"))
    matched = F.coalesce(F.col("_copies"), F.lit(0))
    return seen.join(copies, on, "left").agg(
        F.sum(F.col("_rows") * F.greatest(matched, F.lit(1))).alias("rows_out"),
        F.sum(F.col("_rows") * matched).alias("rows_matched"),
    )


def valid_rows(df: DataFrame, value: str, pattern: str = REGISTRATION_LOOSE) -> DataFrame:
    """Rows with a well-formed value."""
    return df.where(present(value) & F.col(value).rlike(pattern))
