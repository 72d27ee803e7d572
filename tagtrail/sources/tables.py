"""The shared Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagtrail.schemas import TABLES


class Tables:
    """Opens the Parquet tables of a folder by attribute, a fresh plan for each use."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}.parquet")
