"""The matrix as a long table: ``sample_id, feature, value``, one row a cell, NULL missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.functions.numeric import DropMode, drop


def from_wide(df: DataFrame, sample: str, features: Sequence[str]) -> DataFrame:
    """Unpivot columns of a table with an id column; only those columns are read."""
    wide = df.select(F.col(sample).alias("sample_id"), *[F.col(c).cast("double").alias(c) for c in features])
    return wide.unpivot(["sample_id"], list(features), "feature", "value")


def to_wide(matrix: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row a sample; the features must be named, so no pass over the data finds them."""
    return matrix.groupBy("sample_id").pivot("feature", list(features)).agg(F.first("value", ignorenulls=True))


def transpose(matrix: DataFrame) -> DataFrame:
    """Samples become features."""
    return matrix.select(F.col("feature").alias("sample_id"), F.col("sample_id").cast("string").alias("feature"), "value")


def dropped(matrix: DataFrame, mode: DropMode, as_built: bool = False) -> DataFrame:
    """Only the cells that are present; the filter on features reaches the scan."""
    return matrix.withColumn("value", drop(F.col("value"), mode, as_built)).filter("value is not null")


def subset(matrix: DataFrame, samples: DataFrame | None = None, features: Sequence[str] | None = None) -> DataFrame:
    """Rows by sample ids (a table ``sample_id``) and columns by name."""
    out = matrix if features is None else matrix.filter(F.col("feature").isin(list(features)))
    return out if samples is None else out.join(samples.select("sample_id").distinct(), "sample_id", "left_semi")


def cell(matrix: DataFrame, feature: str, sample) -> DataFrame:
    """One cell; both conditions are pushed down."""
    return matrix.filter((F.col("feature") == feature) & (F.col("sample_id") == sample)).select("value")


def combined(a: DataFrame, b: DataFrame, how: Sequence[str]) -> DataFrame:
    """``sample_id, feature`` and a column for each of ``how`` (add, subtract, multiply), cell by cell in one join; absent cells count 0."""
    x, y = a.select("sample_id", "feature", F.col("value").alias("x")), b.select("sample_id", "feature", F.col("value").alias("y"))
    u, v = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    values = {"add": u + v, "subtract": u - v, "multiply": u * v}
    return x.join(y, ["sample_id", "feature"], "full").select("sample_id", "feature", *[values[h].alias(h) for h in how])


def combine(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """One of ``combined`` as a matrix."""
    return combined(a, b, [how]).withColumnRenamed(how, "value")


def absolute(a: DataFrame) -> DataFrame:
    return a.withColumn("value", F.abs("value"))


def squared(a: DataFrame) -> DataFrame:
    return a.withColumn("value", F.col("value") * F.col("value"))


def filled(a: DataFrame, value: float = 0.0) -> DataFrame:
    """The same cells, all with one value."""
    return a.withColumn("value", F.lit(float(value)))
