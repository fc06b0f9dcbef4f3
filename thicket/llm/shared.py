"""Storage and text helpers that the operators of this subpackage have in common."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the word rule knows it: space, and tab to carriage return.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

#: Rows of an aggregate that may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 50_000

_tables: list[tuple[str, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset, as in local tests, a temporary folder takes its place.
    """
    sc = spark.sparkContext
    if root := sc.getConf().get("spark.checkpoint.dir"):
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(root)
        return root.rstrip("/")
    known = sc._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="thicket-"))
        known = sc._jsc.sc().getCheckpointDir()
    return known.get().rstrip("/")


def stored(df: DataFrame, name: str, scope: str = "", part: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared folder and read it again; with the table's path.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(part) if part else writer).parquet(path)
    _tables.append((scope, path))
    return spark.read.schema(df.schema).parquet(path), path


def shared_table(df: DataFrame, name: str, scope: str = "", part: str | None = None) -> DataFrame:
    return stored(df, name, scope, part)[0]


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_tables(spark: SparkSession, scope: str) -> None:
    """Delete the shared tables written under ``scope``, whose readers have all run."""
    global _tables
    for _, path in (x for x in _tables if x[0] == scope):
        delete(spark, path)
    _tables = [x for x in _tables if x[0] != scope]


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more; it does so when the driver's garbage is collected."""
    gc.collect()
    time.sleep(0.3)  # Python's references go in a thread of their own
    spark._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Send at most ``rows`` rows at once to Python from now on, for stages whose rows hold whole sets or texts.

    This stays in the session: results that are evaluated later need it as well. A
    smaller setting of the caller's is left as it is.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000") or 10000) <= rows:
        spark.conf.set(key, str(rows))


def attach(df: DataFrame, small: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Join with an aggregate: by broadcast if its counted rows are few, else by a shuffle."""
    few = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(small) if few else small, on, how)


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(column).to_pylist()]


class WordHash(dict):
    """A word's 64-bit hash, remembered; forgets all when it has grown large."""

    LIMIT = 200_000

    def __init__(self, seed: int = 0) -> None:
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word, self.seed)
        return value

    def all(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * _ODD[0]
    x ^= x >> np.uint64(29)
    x *= _ODD[1]
    return x ^ (x >> np.uint64(32))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, by doubling; empty if there are fewer words."""
    if len(hashes) < width:
        return hashes[:0]
    done, span, rest, level = None, hashes, width, hashes
    length = 1
    have = 0
    while rest:
        if rest & 1:
            if done is None:
                done, have = level, length
            else:
                n = len(hashes) - have - length + 1
                done = mix(done[:n] * _ODD[2] + level[have : have + n])
                have += length
        rest >>= 1
        if rest:
            n = len(hashes) - 2 * length + 1
            level = mix(level[:n] * _ODD[1] + level[length : length + n] + np.uint64(length))
            length *= 2
    del span
    return done


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Row tuples as record batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
