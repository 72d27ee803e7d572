"""Physical layout: partitioning, reuse and inspection."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from tagtrail.operators.keyed import Names, names


def hash_partition(df: DataFrame, key: Names, n: int | None = None) -> DataFrame:
    """Partition by key. Without ``n`` adaptive execution sizes the partitions.

    A grouping or join on the key reuses it. A key with a large share of the
    rows makes one large partition, so use it on even keys or on rows that are
    already combined per key.
    """
    return df.repartition(*names(key)) if n is None else df.repartition(n, *names(key))


def single_partition(df: DataFrame) -> DataFrame:
    """All rows in one partition, for a small result that must be one file."""
    return df.coalesce(1)


@contextmanager
def reused(df: DataFrame) -> Iterator[DataFrame]:
    """Keep ``df`` in memory, spilling to disk, while the block runs."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def partition_sizes(df: DataFrame) -> DataFrame:
    """Rows per partition."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("n_rows"))
