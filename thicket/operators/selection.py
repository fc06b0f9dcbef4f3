"""Exact medians of keys whose values no task can hold.

One pass over the values gives each key a grid of quantiles with a guaranteed error,
from sketches of bounded size. The next counts what lies below the two grid values
around the middle, and each distinct value between them, about one in a hundred; both
are summed in the tasks first, so a key with very many rows is no hot spot. Sums up to
each of those values, made over sorted tasks of bounded size, tell the middle ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.operators.numbered import TASK_ROWS, same, sum_before

#: Values of a key that one task may hold, and keys whose sketches may be broadcast; steps of the grid, and how many values a sketch's error is one of.
TASK_VALUES, FEW, GRID, ACCURACY = 1_000_000, 10_000, 256, 4096


def largest(df: DataFrame, by: Sequence[str]) -> int:
    """Rows of the key that has most."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def middle_values(df: DataFrame, by: Sequence[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """``by, n, low, high``: how many non-null values each key has, and the two middle ones (the same if n is odd).

    Keys without a value are absent. ``df`` is read twice. Should a sketch be wrong by more
    than it may, the places of the middle ones lie outside what was kept: this is checked,
    and then all values are kept.
    """
    by = list(by)
    own = [f"of_{c}" for c in by]
    some = df.filter(F.col("value").isNotNull()).select(*by, "value")
    sketch = some.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("value", [i / GRID for i in range(GRID + 1)], ACCURACY).alias("grid"))
    first, last = F.expr("(n - 1) div 2"), F.expr("n div 2")
    sketch = sketch.select(*[F.col(c).alias(o) for c, o in zip(by, own, strict=True)], "n", "grid").checkpoint()
    few = sketch.limit(FEW + 1).count() <= FEW
    for margin in (4 * GRID / ACCURACY, float(GRID)):
        low = F.floor(first * GRID / F.col("n") - margin).cast("int")
        high = F.ceil((last + 1) * GRID / F.col("n") + margin).cast("int")
        edges = sketch.select(*own, "n", F.when(low > 0, F.get("grid", low)).alias("from_"), F.when(high < GRID, F.get("grid", high)).alias("to_"))
        both = some.join(F.broadcast(edges) if few else edges, same(by, own)).filter(F.col("to_").isNull() | (F.col("value") <= F.col("to_")))
        # A key's values below the bracket become one row, the null one.
        kept = both.withColumn("value", F.when(F.col("from_").isNull() | (F.col("value") >= F.col("from_")), F.col("value"))).groupBy(*by, "value").agg(F.count(F.lit(1)).alias("times")).checkpoint()
        totals = kept.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("times"))), F.lit(0)).alias("below"), F.sum("times").alias("upto"))
        at = totals.join(sketch.select(*own, "n"), same(by, own))
        if not at.filter((first < F.col("below")) | (last >= F.col("upto"))).limit(1).count():
            break
    # Nulls come first in order, so what lies below the bracket counts before all of it.
    placed = sum_before(kept, by, ["value"], F.col("times"), "skip", task_rows).join(sketch.select(*own, "n"), same(by, own))
    here = lambda place: (F.col("skip") <= place) & (place < F.col("skip") + F.col("times"))
    return placed.groupBy(*by).agg(F.first("n").alias("n"), F.max(F.when(here(first), F.col("value"))).alias("low"), F.max(F.when(here(last), F.col("value"))).alias("high"))


def medians(df: DataFrame, by: Sequence[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """``by, n, median`` of the non-null values: the mean of the two middle ones."""
    found = middle_values(df, by, task_rows)
    return found.select(*by, "n", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((F.col("low") + F.col("high")) / 2).alias("median"))
