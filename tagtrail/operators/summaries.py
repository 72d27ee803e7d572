"""Small reports: popularity, means, extremes, spend and word counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagtrail.functions.numeric import fahrenheit
from tagtrail.functions.text import fahrenheit_text, words
from tagtrail.operators.keyed import Names, named_top, names


def popular(df: DataFrame, item: str, titles: DataFrame, title: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent items, named after the cut to ``k``. Ties go to the smallest item."""
    counted = df.groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    return named_top(counted.orderBy(F.desc("n"), F.asc(item)).limit(k), titles, item, title)


def mean_rating(df: DataFrame, item: str, rating: str) -> DataFrame:
    """Mean rating per item, lowest first."""
    return df.groupBy(item).agg(F.avg(rating).alias("mean_rating")).orderBy("mean_rating", item)


def extreme_item(df: DataFrame, item: str, rating: str) -> DataFrame:
    """The highest (item, mean) pair in that order, which is the last item and its mean."""
    means = df.groupBy(item).agg(F.avg(rating).alias("mean_rating"))
    return means.agg(F.max(F.struct(item, "mean_rating")).alias("_top")).select("_top.*")


def user_ones(df: DataFrame, user: str, spread: Names) -> DataFrame:
    """(user, 1) for each rating, in user order.

    The sort continues on ``spread`` so that the range partitioner can split
    the ratings of a very active user.
    """
    return df.orderBy(user, *names(spread)).select(user, F.lit(1).alias("one"))


def station_extreme(
    df: DataFrame, station: str, value: str, keep: Column | None = None, lowest: bool = False
) -> DataFrame:
    """Highest (or lowest) temperature per station in Fahrenheit, and as text, by station."""
    chosen = df if keep is None else df.where(keep)
    best = F.min(value) if lowest else F.max(value)
    return (
        chosen.groupBy(station)
        .agg(best.alias("_tenths"))
        .select(station, fahrenheit("_tenths").alias("fahrenheit"))
        .withColumn("shown", fahrenheit_text("fahrenheit"))
        .orderBy(station)
    )


def spend(df: DataFrame, customer: str, amount: str) -> DataFrame:
    """Total per customer, lowest first."""
    return df.groupBy(customer).agg(F.sum(amount).alias("spent")).orderBy("spent", customer)


def word_count(df: DataFrame, text: str) -> DataFrame:
    """How often each upper-cased word occurs in whole texts."""
    tokens = df.select(F.explode(words(text)).alias("word")).where(F.col("word") != "")
    return tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
