"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",  # also where joins on one key follow each other
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

def build_session(master: str | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: both then
    come from spark-submit, with adaptive execution coalescing partitions.
    """
    builder = SparkSession.builder.appName("tagtrail")
    if master:
        builder = builder.master(master)
    for name, value in _SETTINGS.items():
        builder = builder.config(name, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for name, value in extra.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared folder named by ``spark.checkpoint.dir``.

    Only a local session may do without that setting; its scratch then lies below its warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the cluster's default file system where it has none."""
    if "://" in path or path.startswith("file:"):
        return path
    base = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").rstrip("/")
    return f"{base}/{path.lstrip('/')}" if base != "file:" else f"file:///{path.lstrip('/')}"


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder that no plan reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once and read it back.

    The lineage is cut, the table survives the loss of any executor, and later
    plans see its true size, so that join strategies are chosen from facts.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class BucketedTable:
    """A table in the scratch folder whose files are dealt out by a hash of ``key``, and to which rows can be added.

    A join or grouping on the key reads it without a shuffle, however often rows were added, and the plan of a read is one scan. Every
    addition is written before the next starts, so lost executors do no harm. The catalogue knows the table until
    :meth:`close`; its files stay like all scratch, and :meth:`plain` reads them without the catalogue.
    """

    def __init__(self, spark: SparkSession, label: str, key: list[str], buckets: int):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.path = scratch_path(spark, label)
        self.name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
        self._schema = None

    def add(self, rows: DataFrame) -> None:
        self._schema = self._schema or rows.schema
        dealt = rows.repartition(self.buckets, *self.key)  # the same hash, so a task writes one bucket
        writer = dealt.write.format("parquet").mode("append").bucketBy(self.buckets, *self.key).sortBy(*self.key)
        writer.option("path", self.path).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def plain(self) -> DataFrame:
        return self.spark.read.schema(self._schema).parquet(self.path)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
