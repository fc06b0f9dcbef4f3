"""Rows in order of doc_id without a sort where the input already has that order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.shared import shared_table

#: Stands for a null doc_id: after all others.
LAST = (1 << 63) - 1
#: Bytes of text that a task of a sorted copy gets.
TASK_BYTES = 32 << 20
#: Bytes at which a stretch of a partition ends, until there are STRETCHES of them: then two become one.
STRETCH_BYTES, STRETCHES = 1 << 18, 16


def layout(docs: DataFrame) -> tuple[list[tuple[int, int, int, int, int]], bool]:
    """Stretches of partitions (partition, first id, last id, rows, text bytes), by first id;
    whether the partitions are in order within and don't overlap. Only ids and lengths are read.

    A partition of more than STRETCH_BYTES has up to STRETCHES rows here, which end where the id changes.
    """

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[int]] = []
        last = at = None
        good, every = True, STRETCH_BYTES
        for batch in parts:
            if not batch.num_rows:
                continue
            ids, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            at = batch.column(0)[0].as_py()
            good = good and bool((ids[1:] >= ids[:-1]).all()) and (last is None or last <= int(ids[0]))
            new = np.concatenate([[last is None or last != ids[0]], ids[1:] != ids[:-1]])
            upto, start = np.concatenate([[0], np.cumsum(size)]), 0
            while start < len(ids):
                if not found or found[-1][3] >= every and new[start]:
                    found.append([int(ids[start]), 0, 0, 0])
                    if len(found) > STRETCHES:
                        found[:-1] = [[a[0], b[1], a[2] + b[2], a[3] + b[3]] for a, b in zip(found[:-1:2], found[1:-1:2], strict=True)]
                        every *= 2
                # As far as the stretch lacks bytes, and on to the next id.
                stop = max(start + 1, int(np.searchsorted(upto, upto[start] + max(every - found[-1][3], 0))))
                more = np.flatnonzero(new[stop:])
                stop = stop + int(more[0]) if len(more) else len(ids)
                own = found[-1]
                own[1:] = [int(ids[stop - 1]), own[2] + stop - start, own[3] + int(upto[stop] - upto[start])]
                start = stop
            last = int(ids[-1])
        if found:
            yield pa.RecordBatch.from_pydict({"part": [at] * len(found), "first": [x[0] for x in found], "last": [x[1] for x in found], "n": [x[2] for x in found], "bytes": [x[3] for x in found], "good": [good] * len(found)})

    slim = docs.select(F.spark_partition_id().cast("long").alias("part"), F.coalesce(F.col("doc_id"), F.lit(LAST)).alias("id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("b"))
    found = sorted(slim.mapInArrow(rows, "part long, first long, last long, n long, bytes long, good boolean").collect(), key=lambda r: (r["first"], r["last"]))  # STRETCHES rows a partition
    fine = all(r["good"] for r in found) and all(a["last"] < b["first"] for a, b in zip(found, found[1:], strict=False))
    return [(r["part"], r["first"], r["last"], r["n"], r["bytes"]) for r in found], fine


def whole_parts(stretches: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """The partitions of a layout in order, each as one row."""
    out: list[tuple[int, int, int, int, int]] = []
    for x in stretches:
        if out and out[-1][0] == x[0]:
            out[-1] = (x[0], out[-1][1], x[2], out[-1][3] + x[3], out[-1][4] + x[4])
        else:
            out.append(x)
    return out


def in_order(docs: DataFrame, scope: str = "") -> tuple[DataFrame, list[tuple[int, int, int, int, int]]]:
    """``doc_id, text`` and ``part``, so that each part is a partition with ascending ids, and the layout.

    Input that is laid out so is used as it is; other input is sorted by range once and
    written to a shared table whose files are the parts.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts, fine = layout(plain)
    if not fine:
        key = F.coalesce(F.col("doc_id"), F.lit(LAST))
        n = max(1, sum(p[4] for p in parts) // TASK_BYTES, 2 * docs.sparkSession.sparkContext.defaultParallelism)
        table = shared_table(plain.repartitionByRange(int(n), key).sortWithinPartitions(key), "in-order", scope)
        plain = table.select("doc_id", "text")
        parts, fine = layout(plain)
        if not fine:
            # Files of equal ids or a reader that mixes files: one file is read after the other in its own task.
            plain = plain.repartitionByRange(int(n), key).sortWithinPartitions(key)
            plain = plain.checkpoint()
            parts, fine = layout(plain)
            if not fine:
                raise RuntimeError("the rows could not be put in order")
    return plain.withColumn("part", F.spark_partition_id().cast("long")), parts
