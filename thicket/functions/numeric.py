"""Column helpers that keep missing values and odd floats under control.

NULL is the only marker of a missing value inside the engine; sentinels and NaN are
turned into it once, at the edge.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The least normal double; smaller magnitudes are subnormal.
LEAST_NORMAL = 2.2250738585072014e-308


class DropMode(str, Enum):
    """Which cells of a matrix count as missing."""

    ZEROS = "zeros"
    NANS = "nans"
    NO = "no"


def is_normal(x: Column) -> Column:
    """Finite and neither NaN nor subnormal; zero isn't normal."""
    return ~F.isnan(x) & (F.abs(x) >= LEAST_NORMAL) & (F.abs(x) < float("inf"))


def sanitize(x: Column) -> Column:
    """NaN, infinities and subnormal values become 0; NULL stays."""
    return F.when(x.isNull(), x).when(is_normal(x), x).otherwise(F.lit(0.0))


def drop(x: Column, mode: DropMode, as_built: bool = False) -> Column:
    """The value, or NULL where it counts as missing.

    Zeros mode drops zeros and what sanitizing turns into zero. NaNs mode drops NaN;
    ``as_built`` keeps the older behaviour in which NaN becomes 0 and nothing drops.
    """
    clean = sanitize(x)
    if mode is DropMode.ZEROS:
        return F.when(clean != 0, clean)
    if mode is DropMode.NANS and not as_built:
        return F.when(~F.isnan(x), clean)
    return clean


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where that isn't a normal number."""
    q = F.try_divide(a, b)
    return F.when(is_normal(q), q).otherwise(F.lit(0.0))


def positive(x: Column) -> Column:
    """max(x, 0), with NaN and NULL as 0."""
    return F.greatest(F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)), F.lit(0.0))


def median(x: Column) -> Column:
    """Mean of the two middle values; 0 of nothing."""
    return F.coalesce(F.percentile(x, F.lit(0.5)), F.lit(0.0))


def variance(x: Column) -> Column:
    """Population variance; NULL of nothing."""
    return F.var_pop(x)


def sample_variance(x: Column) -> Column:
    """Variance with denominator max(n - 1, 1); 0 of one value or none."""
    return F.coalesce(F.var_samp(x), F.lit(0.0))


def pearson(x: Column, y: Column) -> Column:
    """Correlation by moments over rows where both are present; 0 where a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    u, v = F.when(both, x), F.when(both, y)
    cov = F.covar_pop(u, v)
    scale = F.sqrt(F.greatest(F.var_pop(u), F.lit(0.0)) * F.greatest(F.var_pop(v), F.lit(0.0)))
    return F.coalesce(F.nanvl(F.try_divide(cov, scale), F.lit(0.0)), F.lit(0.0))
