"""Order statistics and other aggregates over the long table, by any key columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.functions.numeric import median, pearson, safe_ratio, sample_variance
from thicket.operators.numbered import same
from thicket.operators.selection import FEW, TASK_VALUES, largest, medians


def summary(matrix: DataFrame, by: Sequence[str] = ("feature",), task_values: int = TASK_VALUES) -> DataFrame:
    """``n, median, mad, mean, var_pop, var_samp, l2, cov`` by key.

    The MAD (0 of fewer than two values) needs the median first: a second aggregate over
    the cells with their group's median, joined on the same key, whose exchange it uses.
    ``l2`` sums squares about the median, ``cov`` is MAD over median. Where a key has more
    than ``task_values`` values, medians are selected in passes that never bring a key's
    values together; the numbers are the same.
    """
    by = list(by)
    if largest(matrix.filter("value is not null"), by) > task_values:
        return _wide_summary(matrix.filter("value is not null"), by)
    v = F.col("value")
    first = matrix.filter(v.isNotNull()).groupBy(*by).agg(F.count(v).alias("n"), median(v).alias("median"), F.avg(v).alias("mean"), F.var_pop(v).alias("var_pop"), sample_variance(v).alias("var_samp"))
    m = first.select(*[F.col(k).alias(f"k_{k}") for k in by], F.col("median").alias("m"))
    on = F.lit(True)
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"k_{k}"))
    off = v - F.col("m")
    second = matrix.filter(v.isNotNull()).join(m, on).groupBy(*by).agg(F.percentile(F.abs(off), F.lit(0.5)).alias("raw_mad"), F.sum(off * off).alias("l2"))
    second = second.select(*[F.col(k).alias(f"k_{k}") for k in by], "raw_mad", "l2")
    out = first.join(second, on).withColumn("mad", F.when(F.col("n") < 2, 0.0).otherwise(F.col("raw_mad")))
    return out.select(*by, "n", "median", "mad", "mean", "var_pop", "var_samp", "l2", safe_ratio(F.col("mad"), F.col("median")).alias("cov"))


def _wide_summary(matrix: DataFrame, by: list[str]) -> DataFrame:
    v, other = F.col("value"), [f"k_{k}" for k in by]
    mid = medians(matrix, by).select(*[F.col(k).alias(o) for k, o in zip(by, other, strict=True)], F.col("median").alias("m")).checkpoint()
    off = matrix.join(F.broadcast(mid) if mid.limit(FEW + 1).count() <= FEW else mid, same(by, other)).withColumn("off", v - F.col("m"))
    sums = off.groupBy(*by).agg(F.count(v).alias("n"), F.first("m").alias("median"), F.avg(v).alias("mean"), F.var_pop(v).alias("var_pop"), sample_variance(v).alias("var_samp"), F.sum(F.col("off") * F.col("off")).alias("l2"))
    mad = medians(off.select(*by, F.abs("off").alias("value")), by).select(*[F.col(k).alias(o) for k, o in zip(by, other, strict=True)], F.col("median").alias("raw_mad"))
    out = sums.join(mad, same(by, other)).withColumn("mad", F.when(F.col("n") < 2, 0.0).otherwise(F.col("raw_mad")))
    return out.select(*by, "n", "median", "mad", "mean", "var_pop", "var_samp", "l2", safe_ratio(F.col("mad"), F.col("median")).alias("cov"))


def correlations(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pearson r, sample covariance and count of each pair of features over common samples.

    A self join on the sample; both triangles and the diagonal follow from one of them.
    """
    by = list(by)
    a = matrix.select(*by, "sample_id", F.col("feature").alias("f1"), F.col("value").alias("x"))
    b = matrix.select(*by, "sample_id", F.col("feature").alias("f2"), F.col("value").alias("y"))
    pairs = a.join(b, [*by, "sample_id"]).filter("f1 <= f2")
    half = pairs.groupBy(*by, "f1", "f2").agg(F.count(F.lit(1)).alias("n"), pearson(F.col("x"), F.col("y")).alias("r"), F.covar_samp("x", "y").alias("covariance"))
    return half.unionByName(half.filter("f1 < f2").select(*by, F.col("f2").alias("f1"), F.col("f1").alias("f2"), "n", "r", "covariance"))


def errors(truth: DataFrame, prediction: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``n, mse, mae, r`` of predictions against the truth on common cells."""
    t = truth.select("sample_id", "feature", F.col("value").alias("truth"))
    p = prediction.select("sample_id", "feature", F.col("value").alias("guess"))
    d = F.col("truth") - F.col("guess")
    return t.join(p, ["sample_id", "feature"]).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), pearson(F.col("truth"), F.col("guess")).alias("r"))
