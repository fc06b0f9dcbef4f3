"""Document fingerprints from prefix polynomial hashes.

Modular prefix arrays give the hash of any span of a text in constant time. They
answer equality of spans, locate longest common extensions by binary search, and
yield the hashes of all spans of one length at once; a fingerprint is made of the
least of those, after mixing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.ordered import LAST, in_order, whole_parts
from thicket.llm.shared import batches, mix

#: Two primes below 2**31: products of residues fit 64 bits, and a pair tells 2**62 spans apart.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
#: Code points of a span, and spans kept in a fingerprint.
SPAN, KEPT = 12, 64


@lru_cache(4)
def powers(which: int, n: int) -> np.ndarray:
    p, out = PRIMES[which], np.ones(n, np.uint64)
    done, step = 1, np.uint64(BASES[which])
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * step % np.uint64(p)
        done += take
        step = step * step % np.uint64(p)
    return out


def _power(which: int, n: int) -> np.ndarray:
    return powers(which, 1 << max(12, (n - 1).bit_length()))[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Prefixes:
    """Prefix arrays of a text: entry i is the sum of c[j] * base**j over j < i, modulo each prime."""

    def __init__(self, points: np.ndarray) -> None:
        self.n = len(points)
        c = points.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for which, p in enumerate(PRIMES):
            terms = c * _power(which, max(self.n, 1))[: self.n] % np.uint64(p)
            # Below 2**31 each, so 2**32 of them can be summed before the remainder.
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64) % np.uint64(p)]))

    def equal(self, a: int, other: Prefixes, b: int, length: int) -> bool:
        """Whether [a, a + length) here and [b, b + length) there are the same."""
        if a + length > self.n or b + length > other.n:
            return False
        for which, p in enumerate(PRIMES):
            x = (int(self.sums[which][a + length]) - int(self.sums[which][a])) % p
            y = (int(other.sums[which][b + length]) - int(other.sums[which][b])) % p
            # Brought to the same power of the base.
            if x * pow(BASES[which], b, p) % p != y * pow(BASES[which], a, p) % p:
                return False
        return True

    def extension(self, a: int, other: Prefixes, b: int) -> int:
        """Length of the longest common extension to the right from a here and b there."""
        low, high = 0, min(self.n - a, other.n - b)
        while low < high:
            mid = (low + high + 1) // 2
            if self.equal(a, other, b, mid):
                low = mid
            else:
                high = mid - 1
        return low

    def spans(self, length: int) -> np.ndarray:
        """64-bit hashes of all spans of ``length``, the same wherever a span stands."""
        m = self.n - length + 1
        if m < 1:
            return np.zeros(0, np.uint64)
        out = np.zeros(m, np.uint64)
        for which, p in enumerate(PRIMES):
            q = np.uint64(p)
            diff = (self.sums[which][length:] + q - self.sums[which][:m]) % q
            # Times base**(-i): the inverse's powers are a table too.
            out = (out << np.uint64(31)) ^ (diff * _inverse(which, m) % q)
        return out

    def whole(self) -> int:
        return int(self.sums[0][-1]) << 31 | int(self.sums[1][-1])


@lru_cache(4)
def inverse_powers(which: int, n: int) -> np.ndarray:
    p, out = PRIMES[which], np.ones(n, np.uint64)
    done, step = 1, np.uint64(pow(BASES[which], -1, PRIMES[which]))
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * step % np.uint64(p)
        done += take
        step = step * step % np.uint64(p)
    return out


def _inverse(which: int, n: int) -> np.ndarray:
    return inverse_powers(which, 1 << max(12, (n - 1).bit_length()))[:n]


def sketch(prefixes: Prefixes) -> np.ndarray:
    """The least mixed hashes of the text's spans, at most KEPT, ascending; a short text is one span."""
    h = prefixes.spans(SPAN) if prefixes.n >= SPAN else np.array([prefixes.whole()] * bool(prefixes.n), np.uint64)
    h = mix(h) >> np.uint64(24)
    if len(h) > 8 * KEPT:
        least = np.partition(h, 4 * KEPT)[: 4 * KEPT]
        if len(found := np.unique(least)) >= KEPT:
            return found[:KEPT]
    return np.unique(h)[:KEPT]


def fingerprint(prefixes: Prefixes, kept: np.ndarray) -> str:
    """``<code points>:<hash of the whole text>:<span hashes>``, in hexadecimal."""
    return f"{prefixes.n:x}:{prefixes.whole():016x}:" + "".join(f"{x:010x}" for x in kept.tolist())


def parse(fp: str) -> tuple[int, int, np.ndarray]:
    n, whole, kept = fp.split(":")
    return int(n, 16), int(whole, 16), np.array([int(kept[i : i + 10], 16) for i in range(0, len(kept), 10)], np.uint64)


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness of two sketches: the Dice coefficient 2J / (1 + J), J by the least KEPT of the union."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:KEPT]
    j = np.isin(union, a, True).__and__(np.isin(union, b, True)).sum() / len(union)
    return float(2 * j / (1 + j))


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1; equal texts have 1."""
    (n, whole, x), (m, other, y) = parse(a), parse(b)
    return 1.0 if (n, whole) == (m, other) else alike(x, y)


def fingerprints(docs: DataFrame, scope: str = "") -> DataFrame:
    """Fingerprint each text and its edited text.

    The edited text is the text with its last half (rounded down) replaced by as many
    first code points of the next document by doc_id, or by all of them if it has
    fewer; after the last document comes the first. Returns ``doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    common_prefix``: the last is the longest common extension of both from their start.

    Null text: empty. Null doc_id: last. Rows that repeat a doc_id: each is the next of
    the one before. A single document follows itself. An empty table gives an empty
    result. Texts aren't moved where the input is in order: partitions exchange only
    their first documents.
    """
    spark = docs.sparkSession
    rows, stretches = in_order(docs, scope)
    parts = whole_parts(stretches)
    types = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_prefix", pa.int64())]
    schema = pa.schema(types)
    sql = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"

    def known(text: str) -> tuple[np.ndarray, Prefixes, np.ndarray, str]:
        p = Prefixes(points := code_points(text))
        kept = sketch(p)
        return points, p, kept, fingerprint(p, kept)

    def row(doc_id: int | None, own: tuple, following: tuple) -> tuple:
        points, p, kept, fp = own
        half = p.n // 2
        edited = np.concatenate([points[: p.n - half], following[0][:half]])
        q = Prefixes(edited)
        kept_q = sketch(q)
        sha = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
        same = lambda a, x, b, y: 1.0 if (a.n, a.whole()) == (b.n, b.whole()) else alike(x, y)
        return doc_id, p.n, sha, fp, fingerprint(q, kept_q), same(p, kept, q, kept_q), same(p, kept, following[1], following[2]), p.extension(0, q, 0)

    def within(batches_in: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        before = None
        for batch in batches_in:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = known(text or "")
                if before:
                    yield row(before[0], before[1], own)
                before = doc_id, own

    def between(batches_in: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches_in:
            for doc_id, text, following in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield row(doc_id, known(text or ""), known(following or ""))

    inner = rows.select("doc_id", "text").mapInArrow(lambda b: batches(within(b), schema), sql)
    if not parts:
        return inner
    # The last document of each part with the first of the next part.
    ends = spark.createDataFrame([(p[0], p[1], p[2], parts[(i + 1) % len(parts)][0]) for i, p in enumerate(parts)], "p long, first long, last long, next long")
    key = F.coalesce(F.col("doc_id"), F.lit(LAST))
    place = F.monotonically_increasing_id()
    edge = rows.withColumn("place", place).join(F.broadcast(ends), (F.col("part") == F.col("p")) & ((key == F.col("first")) | (key == F.col("last"))))  # a row per partition
    one = edge.groupBy("p").agg(F.max(F.struct("place", "doc_id", "text")).alias("z"), F.min(F.struct("place", "text")).alias("a"), F.first("next").alias("next")).checkpoint()
    outer = one.select("z.doc_id", F.col("z.text").alias("text"), "next").join(one.select(F.col("p"), F.col("a.text").alias("following")), F.col("next") == F.col("p"))
    return inner.unionByName(outer.select("doc_id", "text", "following").mapInArrow(lambda b: batches(between(b), schema), sql))
