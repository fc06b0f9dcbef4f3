"""Embedding whitening by the singular values of the centred vectors.

Entries become whole numbers, so counts, sums and deviations are exact whatever the
order in which tasks add them up. The distinct vectors, centred on their means, are the
rows of a distributed matrix; MLlib's ``computeSVD`` gives its singular values and right
vectors, which are the components, and the values over the square root of the number of
rows are their standard deviations. The total variance comes from the exact deviations
instead, so it doesn't hang on how many singular values were asked for.

Only sums by dimension and the components go through the driver: their size is set by
the number of dimensions, never by the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.shared import shared_table

#: Entries are multiplied by this and rounded down.
SCALE = 256
#: Singular values below this part of the largest are rounding errors of zero: the squares are summed in doubles.
RANK = 1e-7
#: Widest whole numbers that a packed vector may hold, by the tag in front of it.
_WIDTHS = {2: np.int16, 4: np.int32, 8: np.int64}
_LIMIT = float(1 << 63)
#: Exact totals are summed in two parts, each well below 38 digits.
HALF = 10**18


def pack(x: np.ndarray) -> bytes:
    """A vector of whole numbers as bytes, equal for equal vectors: no zeros at its end, in the narrowest type that holds it."""
    used = np.flatnonzero(x)
    x = x[: used[-1] + 1] if len(used) else x[:0]
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    width = next(w for w, t in _WIDTHS.items() if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return bytes([width]) + x.astype(_WIDTHS[width]).tobytes()


def unpack(blobs: list[bytes], width: int) -> np.ndarray:
    """Packed vectors as rows of ``width`` whole numbers."""
    out = np.zeros((len(blobs), width), np.int64)
    for i, b in enumerate(blobs):
        x = np.frombuffer(b, _WIDTHS[b[0]], offset=1)
        out[i, : len(x)] = x
    return out


def quantised(vectors: DataFrame) -> DataFrame:
    """``vec_id, x``: packed whole numbers floor(SCALE * entry) of the vectors whose entries are all finite."""
    schema = pa.schema([("vec_id", pa.int64()), ("x", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            ids, rows = [], []
            lists = batch.column("embedding")
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            for vec_id, v in zip(batch.column("vec_id").to_pylist(), lists, strict=True):
                if not v.is_valid or v.values.null_count:
                    continue
                c = v.values.to_numpy(zero_copy_only=False)
                if not np.isfinite(c).all():
                    continue
                c = np.floor(SCALE * c)
                ids.append(vec_id)
                rows.append(pack(np.where(c >= _LIMIT, np.iinfo(np.int64).max, np.clip(c, -_LIMIT, np.nextafter(_LIMIT, 0)).astype(np.int64))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], schema=schema)

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, x binary")


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """How many vectors, and the exact sum of each dimension up to the last that isn't zero everywhere."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(0, object)
        for batch in parts:
            blobs = batch.column(0).to_pylist()
            n += len(blobs)
            for i in range(0, len(blobs), 1024):
                some = blobs[i : i + 1024]
                x = unpack(some, max((len(b) - 1) // b[0] for b in some))
                # A thousand numbers below 2^53 add up within a long.
                part = x.sum(0).astype(object) if not x.size or np.abs(x, dtype=np.float64).max() < 1 << 53 else x.astype(object).sum(0)
                if len(part) > len(sums):
                    sums = np.concatenate([sums, np.zeros(len(part) - len(sums), object)])
                sums[: len(part)] += part
        rows = [(-1, str(n)), *((i, str(s)) for i, s in enumerate(sums))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["dim", "total"])

    got = fit.select("x").mapInArrow(run, "dim long, total string").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = {r["dim"]: int(r["total"]) for r in got.collect()}  # a row a dimension
    return found.get(-1, 0), [found[i] for i in range(len(found) - (-1 in found))]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x less the mean, rounded once from the whole part and the rest of the mean."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    near = not x.size or max(-int(x.min()), int(x.max())) < 1 << 61
    return ((x - whole).astype(np.float64) if near else x.astype(np.float64) - whole) - rest


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Of each row the exact sum over dimensions of (n * x - S) squared."""
    if not x.size:
        return [0] * len(x)
    most = max(n * max(-int(x.min()), int(x.max()), 0) + abs(s) for s in sums)
    if most * most * len(sums) < 1 << 63:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(1).tolist()
    d = n * x.astype(object) - np.array(sums, object)
    return (d * d).sum(1).tolist()


def components(fit: DataFrame, n: int, sums: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit components (columns, at most ``k``) by falling variance, and their variances.

    All singular values are asked for: then MLlib sums the products of the distributed
    rows and takes the matrix apart by a dense method to double precision; a few values
    alone would come from an iteration with a tolerance.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    width = len(sums)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            blobs = batch.column(0).to_pylist()
            for i in range(0, len(blobs), 1024):
                c = centred(unpack(blobs[i : i + 1024], width), n, sums)
                flat = pa.array(c.ravel())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(0, c.size + 1, width, dtype=np.int32), flat)], ["c"])

    rows = fit.select("x").mapInArrow(run, "c array<double>").select(array_to_vector("c").alias("v"))
    found = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "v"), n, width).computeSVD(width, False, RANK)
    variances = np.asarray(found.s.toArray()) ** 2 / n
    return np.asarray(found.V.toArray())[:, :k], variances[:k]


def whitened(vectors: DataFrame, k: int = 4, scope: str = "") -> DataFrame:
    """The first ``k`` whitened components of each vector.

    Returns ``vec_id, component, n, deviation, whitened, explained, identity_error``: per
    row and component (from 1, by falling variance) the number of distinct vectors, the
    row's exact squared deviation, its centred vector on the unit component over the
    square root of the variance, the component's share of the total variance, and the
    largest entry by which the covariance of what was whitened differs from the identity.

    Means and covariances are over the distinct vectors, divisor n. Rows with a null
    vector, or with null, infinite or NaN entries, are left out. A shorter vector counts
    as if zeros followed. Repeated rows and null vec_ids are kept, each with its result.
    Of equal variances any orthogonal components are right. A component without variance
    can't be whitened: it has no rows, so an empty table, a single distinct vector, or
    vectors without entries give an empty result. A deviation beyond a long is null.
    Entries beyond a long after scaling count as the nearest long. Other columns are ignored.
    """
    empty = vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    fit = shared_table(quantised(vectors).select("x").distinct(), "whitening-fit", scope)
    n, sums = exact_sums(fit)
    if n < 2 or not sums:
        return empty
    unit, variance = components(fit, n, sums, k)
    if not len(variance):
        return empty
    scale = unit / np.sqrt(variance)
    width, m = len(sums), len(variance)

    def moments(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = 0, np.zeros((m + 1, m + 1))
        for batch in parts:
            blobs = batch.column(0).to_pylist()
            for i in range(0, len(blobs), 1024):
                x = unpack(blobs[i : i + 1024], width)
                total += sum(deviations(x, n, sums))
                w = np.column_stack([centred(x, n, sums) @ scale, np.ones(len(x))])
                products += w.T @ w
        rows = [("high", 0, str(total // HALF), 0.0), ("low", 0, str(total % HALF), 0.0), *(("product", i, "0", float(v)) for i, v in enumerate(products.ravel()))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["kind", "at", "exact", "value"])

    sums_of = fit.select("x").mapInArrow(moments, "kind string, at long, exact string, value double").groupBy("kind", "at").agg(F.sum(F.col("exact").cast("decimal(38,0)")).alias("exact"), F.sum("value").alias("value"))
    found = {(r["kind"], r["at"]): r for r in sums_of.collect()}  # a row a product of two components
    total = int(found["high", 0]["exact"]) * HALF + int(found["low", 0]["exact"])
    trace = total / n**3
    products = np.array([found["product", i]["value"] for i in range((m + 1) ** 2)]).reshape(m + 1, m + 1) / n
    means = products[m, :m]
    error = float(np.abs(products[:m, :m] - np.outer(means, means) - np.eye(m)).max())
    explained = (variance / trace).tolist()

    def project(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            ids, blobs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(0, len(blobs), 1024):
                x = unpack(blobs[i : i + 1024], width)
                got, size = centred(x, n, sums) @ scale, len(x)
                far = [d if d < 1 << 63 else None for d in deviations(x, n, sums)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.array(ids[i : i + 1024], object), m).tolist(), pa.int64()), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), size)), pa.array(np.full(size * m, n, np.int64)), pa.array([d for d in far for _ in range(m)], pa.int64()),
                        pa.array(got.ravel()), pa.array(explained * size), pa.array(np.full(size * m, error)),
                    ], schema=pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]),
                )

    return quantised(vectors).mapInArrow(project, empty.schema)

