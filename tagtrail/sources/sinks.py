"""Writers and previews."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from tagtrail.operators.layout import single_partition


def write_csv(df: DataFrame, path: str, overwrite: bool = True, single_file: bool = False, sep: str = ",") -> None:
    """Headered CSV, one file per partition unless ``single_file`` is asked for.

    Without ``overwrite`` an existing path is an error.
    """
    out = single_partition(df) if single_file else df
    out.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("sep", sep).csv(path)


def write_text(df: DataFrame, path: str, column: str) -> None:
    """One line per row from a string column."""
    df.select(column).write.mode("errorifexists").text(path)


def preview(df: DataFrame, n: int = 20, truncate: bool = True) -> None:
    """Print the schema and the first rows."""
    df.printSchema()
    df.show(n, truncate)


def to_pandas(df: DataFrame, limit: int) -> pd.DataFrame:
    """At most ``limit`` rows as a pandas frame."""
    return df.limit(limit).toPandas()
