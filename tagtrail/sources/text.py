"""Text readers. All take any path the session's file systems know."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from tagtrail.functions.text import trimmed_number



def read_delimited(
    spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = False, encoding: str = "UTF-8"
) -> DataFrame:
    """Rows of a delimited file (separators of several characters included) with typed columns.

    Bytes that are malformed in ``encoding`` come out as the replacement character.
    """
    return (
        spark.read.schema(schema)
        .option("sep", sep)
        .option("header", header)
        .option("encoding", encoding)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
        .csv(path)
    )


def read_headered_strings(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A file with a header, every column a string, nothing inferred."""
    return spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)


def read_ragged(spark: SparkSession, path: str, columns: tuple[str, ...], min_fields: int, sep: str = ",") -> DataFrame:
    """Lines with at least ``min_fields`` fields; columns a line lacks are null."""
    fields = F.split("value", sep)
    return (
        spark.read.text(path)
        .select(fields.alias("_f"))
        .where(F.size("_f") >= min_fields)
        .select(*[F.get("_f", i).alias(c) for i, c in enumerate(columns)])
    )


def read_quoted_names(spark: SparkSession, path: str, below: int | None = None) -> DataFrame:
    """(id, name) from lines such as ``17 "A NAME"``; other lines, lines without a number, and ids from ``below`` on if it is given, are dropped."""
    fields = F.split("value", '"')
    named = (
        spark.read.text(path)
        .where(F.size(fields) > 1)
        .select(trimmed_number(F.get(fields, 0)).alias("id"), F.get(fields, 1).alias("name"))
        .where(F.col("id").isNotNull())
    )
    return named if below is None else named.where(F.col("id") < below)


def read_adjacency(spark: SparkSession, path: str, delimiter: str = r"\s+") -> DataFrame:
    """Edges (src, dst) from lines whose first token is the source and the others its neighbours."""
    tokens = F.split(F.trim("value"), delimiter)
    return (
        spark.read.text(path)
        .select(tokens.alias("_t"))
        .where(F.size("_t") > 1)
        .select(F.get("_t", 0).alias("src"), F.explode(F.slice("_t", F.lit(2), F.size("_t") - 1)).alias("dst"))
        .select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    )


def read_labelled_points(spark: SparkSession, path: str) -> DataFrame:
    """(label, features) from ``label,f1 f2 ...`` or the bracketed ``(label,[f1,f2,...])``."""
    plain = F.translate("value", "()[]", "")
    parts = F.split(plain, ",", 2)
    numbers = F.split(F.trim(F.get(parts, 1)), r"[\s,]+")
    return (
        spark.read.text(path)
        .where(F.trim("value") != "")
        .select(
            F.trim(F.get(parts, 0)).cast("double").alias("label"),
            numbers.cast("array<double>").alias("features"),
        )
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def in_memory(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small relation from literals. Its size is fixed, so Spark broadcasts it in joins."""
    kinds = T.StructType.fromDDL(schema)
    columns = zip(*rows) if rows else ([] for _ in kinds)
    arrays = [pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(columns, kinds)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=kinds.names), kinds)
