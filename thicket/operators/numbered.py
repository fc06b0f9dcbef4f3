"""Row numbers and cumulative sums by key that no single task has to see whole.

A window without bounds gives a key's rows to one task. Here rows are sorted by range
into tasks of bounded size; what lies before a task's first row of a key follows from
the tasks' sums, of which there is one row a task and key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a task of a sorted copy holds, about; tasks at most, unless they would hold more.
TASK_ROWS, TASKS = 1_000_000, 512


def same(left: Sequence[str], right: Sequence[str]) -> Column:
    """Null-safe equality of the columns."""
    on = F.lit(True)
    for a, b in zip(left, right, strict=True):
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def sum_before(df: DataFrame, by: Sequence[str], order: Sequence[str], weight: Column, name: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """Add ``name``: the sum of ``weight``, a whole number, over the rows of the same key that come before by ascending ``order``, which must be unique in it.

    The sorted copy is kept in the session's checkpoint folder, so that both its readers see the same tasks.
    """
    by, order = list(by), list(order)
    rows = df.count()
    parts = max(1, -(-rows // max(task_rows, min(TASK_ROWS, -(-rows // TASKS)))))
    laid = df.withColumn("w_", weight.cast("long")).repartitionByRange(int(parts), *by, *order).withColumn("part_", F.spark_partition_id()).checkpoint()
    sums = laid.groupBy(*by, "part_").agg(F.sum("w_").alias("s_"))
    offset = F.sum("s_").over(Window.partitionBy(*by).orderBy("part_")) - F.col("s_")  # a row a task and key
    sums = sums.select(*[F.col(c).alias(f"of_{c}") for c in by], F.col("part_").alias("own_"), offset.alias("before_"))
    inside = F.sum("w_").over(Window.partitionBy(*by, "part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = laid.withColumn("inside_", F.coalesce(inside, F.lit(0))).join(sums, same(by, [f"of_{c}" for c in by]) & (F.col("part_") == F.col("own_")))
    return out.select(*df.columns, (F.col("inside_") + F.col("before_")).alias(name))


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """Add ``name``: the row's place, from 0, among those of its key by ascending ``order``, which must be unique in it."""
    return sum_before(df, by, order, F.lit(1), name, task_rows)
