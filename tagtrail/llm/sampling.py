"""Bounded samples of rows for fitting a classifier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtrail.session import materialize

_BINS = 4096


def remainder(id_column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % divisor


def bounded_sample(
    rows: DataFrame, key: list[str], weight: Column, most_rows: int, most_weight: int, labels: DataFrame | None = None
) -> DataFrame:
    """``rows`` with a column ``place``, cut to ``most_rows`` rows and a total ``weight`` of ``most_weight``; all if that holds them.

    A row's place is a hash of its ``key`` columns, and rows with one place count once, so neither a repeated id
    nor a repeated row makes the sample larger. Places fall into some thousand bins, whose rows and weights Spark
    adds up; the longest series of bins within both bounds is taken, or the first place of all, if its bin
    goes beyond them. With ``labels`` (id, label) only rows with a labelled id count, and they get the label. Only
    places and weights are shuffled and written; the chosen places are few enough to be sent to every task.
    Sort by ``place`` for an order that does not depend on partitions.
    """
    placed = rows.withColumn("place", F.xxhash64(*key, F.lit(17)))
    light = placed.select(*(["id"] if labels is not None else []), "place", F.coalesce(weight, F.lit(0)).alias("w"))
    light = light.withColumn("label", F.lit(0.0)) if labels is None else light.join(labels, "id")
    single = materialize(light.groupBy("place").agg(F.max("w").alias("w"), F.max("label").alias("label")), "places")
    place_bin = F.floor(F.shiftrightunsigned("place", 1) / F.lit((1 << 63) // _BINS)).alias("bin")
    held = single.groupBy(place_bin).agg(F.count("*").alias("n"), F.sum("w").alias("w")).orderBy("bin").collect()
    n = w = 0
    last = -1
    for r in held:
        n, w = n + r.n, w + r.w
        if n > most_rows or w > most_weight:
            break
        last = r.bin
    chosen = single.where(place_bin <= last)
    if last < 0 and held:
        chosen = single.where(place_bin == held[0].bin).orderBy("w", "place").limit(1)
    chosen = chosen.select("place", "label") if labels is not None else chosen.select("place")
    return placed.join(F.broadcast(chosen), "place").dropDuplicates(["place"])


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    id_column: str,
    text_column: str,
    label_column: str,
    sample: int,
    chars: int,
    most_features: int = 1 << 20,
) -> DataFrame:
    """(label, text, place) of ``sample`` rows at most whose id has a label 0 or 1, with ``chars`` characters together at most.

    A text counts with its characters, at most ``most_features``, beyond which it has no more distinct
    features. ``usable`` is a condition on the columns of ``labels``. An id with several labels takes the largest.
    """
    named = labels.where(usable).select(F.col(id_column).alias("id"), F.col(label_column).cast("double").alias("label"))
    named = named.where(F.col("id").isNotNull() & F.col("label").isin(0.0, 1.0))
    named = named.groupBy("id").agg(F.max("label").alias("label"))
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    weight = F.least(F.coalesce(F.length("text"), F.lit(0)), F.lit(most_features)).cast("long")
    return bounded_sample(rows, ["id", "text"], weight, sample, chars, named).select("label", "text", "place")


def in_order(table: pa.Table, lists: list[str]) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """The order of the rows by ``place``, and the values of each list column in that order, as views that copy nothing."""
    order = np.argsort(table.column("place").to_numpy(), kind="stable")
    out = []
    for name in lists:
        views: list[np.ndarray] = []
        for chunk in table.column(name).chunks:
            ends, values = np.asarray(chunk.offsets).tolist(), np.asarray(chunk.values)
            views += [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        out.append([views[i] for i in order.tolist()])
    return order, out
