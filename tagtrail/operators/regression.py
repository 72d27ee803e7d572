"""Linear regression with an L2 penalty and no intercept."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, functions as F


def scaled(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add ``out: column`` pairs mapped linearly onto [-1, 1] by their own ranges.

    One pass finds all ranges; only they reach the driver.
    """
    bounds = [f(c) for c in columns.values() for f in (F.min, F.max)]
    found = df.agg(*[b.alias(f"b{i}") for i, b in enumerate(bounds)]).first()
    for at, (out, column) in enumerate(columns.items()):
        low, high = float(found[2 * at]), float(found[2 * at + 1])
        df = df.withColumn(out, (F.col(column) - F.lit(low)) * 2.0 / F.lit(high - low) - 1.0)
    return df


def _vectors(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_features").transform(df)


def fit_linear(df: DataFrame, features: list[str], label: str, penalty: float = 0.01) -> LinearRegressionModel:
    """The optimum of mean squared error / 2 + penalty / 2 * |w|^2.

    The solver divides its penalty by the deviation of the label, so the
    penalty is multiplied by it first. The normal equations take one
    pass; only a matrix of the features' own size reaches the driver.
    """
    deviation = df.agg(F.stddev_pop(label)).first()[0]
    solver = LinearRegression(
        featuresCol="_features",
        labelCol=label,
        fitIntercept=False,
        standardization=False,
        solver="normal",
        regParam=penalty * deviation,
    )
    return solver.fit(_vectors(df, features))


def predict(model: LinearRegressionModel, df: DataFrame, features: list[str]) -> DataFrame:
    """Each row with its prediction beside its own label; nothing is matched by position."""
    return model.transform(_vectors(df, features)).drop("_features")
