"""Incremental substring deduplication with a log-structured fingerprint index.

History is a set of immutable runs: sorted hashes of all word windows seen, by range of
hashes. A batch's windows are sorted the same way and merged with the runs, range by
range; a window whose hash stands in a run, or in an earlier place of the batch, is
verified by an independent check value and then is a repeat. The batch's new hashes
become the next run, and runs of one level are compacted into one of the next when
there are enough of them.

Check values are as long as the text to come asks for: a false match anywhere among all
of its windows has a probability below 2 ** -14. Only hashes travel, delta-coded; what
comes back to the documents is one bit a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.ordered import LAST, in_order
from thicket.llm.shared import WordHash, batches, delete, mix, release, shingles, stored, text_bytes

#: Words at which a block of documents ends, and bytes of text at which a chunk of ids does, at least.
BLOCK_WORDS, CHUNK_BYTES = 1_000_000, 6 << 20
#: Least mean number of a block's hashes in a range: rows grow with the text, however many ranges there are.
ROW_HASHES = 64
#: Bytes of text whose windows' hashes share a range.
RANGE_BYTES = 12 << 20
#: Runs of a level that are compacted into one of the next.
FANOUT = 4
ROW_SQL = "range int, chunk long, first long, seq long, docs int, data binary"
REPLY_SQL = "kind int, range int, chunk long, first long, seq long, docs int, data binary"


def check_bytes(text_size: int) -> int:
    """Bytes of a check value beside a 64-bit hash. A text of n bytes has n / 2 windows at most, so n * n / 8 pairs."""
    return min(8, max(1, -(-(2 * max(text_size, 1).bit_length() - 3 + 14 - 64) // 8)))


def encode(hashes: np.ndarray, checks: np.ndarray, check: int) -> bytes:
    """Ascending hashes as differences of as few bytes as the largest needs, then ``check`` bytes of each check value."""
    if not len(hashes):
        return b""
    d = np.diff(hashes, prepend=np.uint64(0))
    width = max(1, -(-int(d[1:].max() if len(d) > 1 else 0).bit_length() // 8))
    planes = lambda x, n: np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()
    return bytes([width]) + hashes[:1].astype("<u8").tobytes() + planes(d[1:], width) + planes(checks, check)


def decode(data: bytes, check: int) -> tuple[np.ndarray, np.ndarray]:
    if not data:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    width = data[0]
    n = (len(data) - 9 - check) // (width + check) + 1
    d, c = np.zeros((n, 8), np.uint8), np.zeros((n, 8), np.uint8)
    d[0] = np.frombuffer(data, np.uint8, 8, 1)
    d[1:, :width] = np.frombuffer(data, np.uint8, (n - 1) * width, 9).reshape(width, n - 1).T
    c[:, :check] = np.frombuffer(data, np.uint8, n * check, 9 + (n - 1) * width).reshape(check, n).T
    return np.cumsum(d.view("<u8").ravel(), dtype=np.uint64), c.view("<u8").ravel()


class Block:
    """Consecutive documents: their words, and their windows' distinct hashes with first places."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.hashes: list[np.ndarray] = []
        self.words = 0

    def add(self, hashes: np.ndarray) -> None:
        self.hashes.append(hashes)
        self.words += len(hashes)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct hashes ascending, first places, the place of each window's hash)."""
        every = np.concatenate([shingles(h, self.window) for h in self.hashes]) if self.hashes else np.zeros(0, np.uint64)
        return np.unique(every, return_index=True, return_inverse=True)

    def checks(self) -> np.ndarray:
        """The check value of each window, from words hashed anew."""
        return np.concatenate([shingles(mix(h ^ np.uint64(0xD1B54A32D192ED03)), self.window) for h in self.hashes]) if self.hashes else np.zeros(0, np.uint64)


def blocks_of(window: int, bits: int, check: int, bounds: np.ndarray, memo: WordHash):
    """Rows ``id, text`` in order become rows of ROW_SQL: each block's hashes by range."""
    most = max(BLOCK_WORDS, ROW_HASHES << bits)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        block, chunk, first, seq = Block(window), None, None, 0

        def close() -> Iterator[tuple]:
            distinct, at, _ = block.windows()
            checks = block.checks()[at]
            cuts = np.searchsorted(distinct >> np.uint64(64 - bits), np.arange((1 << bits) + 1).astype(np.uint64))
            for r in range(1 << bits):
                a, b = cuts[r], cuts[r + 1]
                if a < b or r == 0:
                    yield r, chunk, first, seq, len(block.hashes), encode(distinct[a:b], checks[a:b], check)

        for batch in parts:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for c, i, text in zip(chunk_of(ids, bounds).tolist(), ids.tolist(), text_bytes(batch), strict=True):
                h = memo.all(text.split())
                if block.hashes and (c != chunk or block.words + len(h) > most):
                    yield from close()
                    block, seq = Block(window), seq + 1
                if not block.hashes:
                    chunk, first = c, i
                block.add(h)
        if block.hashes:
            yield from close()

    return run


def chunk_of(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The chunk of each id: ``bounds`` are the first ids of the chunks, which have about the same bytes of text."""
    return np.maximum(np.searchsorted(bounds, ids, "right") - 1, 0)


def merge_join(parts: Iterator[pa.RecordBatch], check: int, commit: bool = True) -> Iterator[tuple]:
    """Rows of ROW_SQL by range, runs before blocks in order, become rows of REPLY_SQL:

    kind 0, for each block a bit for each of its hashes, set where it is a repeat;
    kind 1, the range's new hashes, for the next run, if there will be one.
    """
    held: list[tuple] = []

    def close() -> Iterator[tuple]:
        pieces = [decode(row[5], check) for row in held]
        hashes, checks = np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces])
        source = np.repeat(np.arange(len(held)), [len(p[0]) for p in pieces])
        order = np.lexsort((np.arange(len(hashes)), checks, hashes)) if len(hashes) else np.zeros(0, int)
        h, c = hashes[order], checks[order]
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
        flags = np.zeros(len(h), bool)
        flags[order] = again
        old = np.array([row[1] is None for row in held])
        new = ~again & ~old[source[order]] if len(h) else again
        start = 0
        for row, (own, _) in zip(held, pieces, strict=True):
            if row[1] is not None:
                yield 0, *row[:5], np.packbits(flags[start : start + len(own)]).tobytes()
            start += len(own)
        if commit and new.any():
            yield 1, held[0][0], None, None, None, None, encode(h[new], c[new], check)

    for batch in parts:
        for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if held and row[0] != held[0][0]:
                yield from close()
                held = []
            held.append(row)
    if held:
        yield from close()


def compact(parts: Iterator[pa.RecordBatch], check: int) -> Iterator[tuple]:
    """Runs' rows ``range, data``, by range, become one row a range."""
    held: list[tuple] = []

    def close() -> tuple:
        pieces = [decode(row[1], check) for row in held]
        h, c = np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces])
        order = np.argsort(h, kind="stable")  # runs have no window in common
        return held[0][0], encode(h[order], c[order], check)

    for batch in parts:
        for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if held and row[0] != held[0][0]:
                yield close()
                held = []
            held.append(row)
    if held:
        yield close()


_REPLY = pa.schema([("kind", pa.int32()), ("range", pa.int32()), ("chunk", pa.int64()), ("first", pa.int64()), ("seq", pa.int64()), ("docs", pa.int32()), ("data", pa.binary())])
_ROW = pa.schema(list(_REPLY)[1:])
_RUN = pa.schema([("range", pa.int32()), ("data", pa.binary())])


class FingerprintIndex:
    """Runs of window hashes in shared tables.

    ``window`` words make a window; ``text_size`` says how many bytes of text the index
    will see in all. That sets the leading ``bits`` of a hash that give its range, which a
    task merges at once, and ``check``, the bytes of a check value.
    """

    def __init__(self, spark: SparkSession, window: int = 20, text_size: int = 0, scope: str = "") -> None:
        self.spark, self.window, self.scope = spark, window, scope
        self.bits, self.check = max(4, (text_size // RANGE_BYTES).bit_length()), check_bytes(text_size)
        #: Level, table and path of each run.
        self.runs: list[tuple[int, DataFrame, str]] = []

    def add(self, batch: DataFrame, commit: bool = True) -> DataFrame:
        """Deduplicate a batch against history and itself, and make it history if ``commit``.

        Returns ``doc_id, n_words, n_removed, kept``: each document's words that no
        repeated window covers, joined by single spaces.
        """
        docs, stretches = in_order(batch.select("doc_id", "text"), self.scope)
        return self.add_ordered(docs, self.bounds(stretches), commit)

    def bounds(self, stretches: list[tuple[int, int, int, int, int]]) -> np.ndarray:
        """First ids of chunks, which are whole stretches and hold a block each at least."""
        out, size, least = [], 0, max(CHUNK_BYTES, 6 * ROW_HASHES << self.bits)
        for _, first, _, _, n in stretches:
            if not out or size >= least:
                out.append(first)
                size = 0
            size += n
        return np.unique(out).astype(np.int64)

    def add_ordered(self, docs: DataFrame, bounds: np.ndarray, commit: bool = True) -> DataFrame:
        """The same for a batch in order of doc_id, null last; ``bounds`` has the first ids of its chunks."""
        sent = self.spark.sparkContext.broadcast(bounds)  # a few numbers a partition of the input
        docs = docs.select(F.coalesce(F.col("doc_id"), F.lit(LAST)).alias("id"), F.col("text").cast("binary").alias("text"), F.monotonically_increasing_id().alias("place"))
        window, bits, check = self.window, self.bits, self.check
        rows = docs.select("id", "text").mapInArrow(lambda p: batches(blocks_of(window, bits, check, sent.value, WordHash(3))(p), _ROW, 64), ROW_SQL)
        for _, run, _ in self.runs:
            rows = rows.unionByName(run.selectExpr("range", "cast(null as long) chunk", "cast(null as long) first", "cast(null as long) seq", "cast(null as int) docs", "data"))
        rows = rows.repartition(1 << self.bits, "range").sortWithinPartitions("range", F.asc_nulls_first("first"), F.asc_nulls_first("seq"))
        replies, path = stored(rows.mapInArrow(lambda p: batches(merge_join(p, check, commit), _REPLY, 64), REPLY_SQL), "replies", self.scope, "kind")
        if commit:
            self.runs.append((0, replies.filter("kind = 1").select("range", "data"), f"{path}/kind=1"))
            self.compact()
        del rows
        release(self.spark)
        return self._removed(docs, replies.filter("kind = 0"), sent)

    def compact(self) -> None:
        """Merge the runs of each level that has FANOUT of them, and delete them."""
        level, check = 0, self.check
        while level <= max((x[0] for x in self.runs), default=-1):
            own = [x for x in self.runs if x[0] == level]
            if len(own) >= FANOUT:
                rows = own[0][1]
                for _, r, _ in own[1:]:
                    rows = rows.unionByName(r)
                rows = rows.repartition(1 << self.bits, "range").sortWithinPartitions("range")
                merged, path = stored(rows.mapInArrow(lambda p: batches(compact(p, check), _RUN, 64), "range int, data binary"), "run", self.scope)
                self.runs = [x for x in self.runs if x[0] != level] + [(level + 1, merged, path)]
                for _, _, old in own:
                    delete(self.spark, old)
            level += 1

    def _removed(self, docs: DataFrame, replies: DataFrame, sent) -> DataFrame:
        window, range_bits = self.window, self.bits
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

        def finish(block: Block, held: list[tuple], bits: list[tuple[int, bytes]]) -> Iterator[tuple]:
            distinct, first, place = block.windows()
            tops = np.searchsorted(distinct >> np.uint64(64 - range_bits), np.arange((1 << range_bits) + 1).astype(np.uint64))
            flags = np.zeros(len(distinct), bool)
            for r, data in bits:
                a, b = tops[r], tops[r + 1]
                flags[a:b] = np.unpackbits(np.frombuffer(data, np.uint8), count=b - a)
            if sum(len(d) for _, d in bits) != int((-(-np.diff(tops) // 8)).sum()):
                raise RuntimeError("the batch changed while it was read")
            repeated = flags[place]
            later = np.ones(len(place), bool)
            later[first] = False
            repeated |= later
            at = 0
            for (i, words), h in zip(held, block.hashes, strict=True):
                n = max(0, len(h) - window + 1)
                own = repeated[at : at + n]
                at += n
                if own.any():
                    edge = np.zeros(len(h) + 1, np.int32)
                    edge[:n] += own
                    edge[window : window + n] -= own
                    gone = np.cumsum(edge[:-1]) > 0
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                yield None if i == LAST else i, len(h), len(h) - len(words), b" ".join(words).decode("utf-8", "replace")

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            plan: list[list] = []
            block, held, memo = Block(window), [], WordHash(3)
            chunk = None
            for batch in parts:
                for c, kind, i, seq, text, r, n, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    if c != chunk:
                        if held or plan:
                            raise RuntimeError("the batch changed while it was read")
                        chunk = c
                    if kind == 0:
                        if not plan or plan[-1][:2] != [i, seq]:
                            plan.append([i, seq, n, []])
                        plan[-1][3].append((r, data))
                        continue
                    if not plan or not held and plan[0][0] != i:
                        raise RuntimeError("the batch changed while it was read")
                    words = (text or b"").split()
                    block.add(memo.all(words))
                    held.append((i, words))
                    if len(held) == plan[0][2]:
                        yield from finish(block, held, plan.pop(0)[3])
                        block, held = Block(window), []
            if held or plan:
                raise RuntimeError("the batch changed while it was read")

        chunk = F.pandas_udf(lambda ids: pd.Series(chunk_of(ids.to_numpy(), sent.value)), "long")
        a = replies.selectExpr("chunk", "0 as kind", "first as id", "seq as place", "cast(null as binary) as text", "range", "docs", "data")
        b = docs.select(chunk("id").alias("chunk"), F.lit(1).alias("kind"), "id", "place", "text", F.lit(None).cast("int").alias("range"), F.lit(None).cast("int").alias("docs"), F.lit(None).cast("binary").alias("data"))
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        both = a.unionByName(b).repartition(n, "chunk").sortWithinPartitions("chunk", "kind", "id", "place", "range")
        return both.mapInArrow(lambda p: batches(run(p), schema, 500), "doc_id long, n_words long, n_removed long, kept string")


def deduplicated(docs: DataFrame, window: int = 20, shares: tuple[float, ...] = (0.0625, 0.125, 0.1875, 0.25), scope: str = "") -> DataFrame:
    """Remove the words of all windows that stand earlier in the table.

    The table comes to an index in batches by doc_id, which end at ``shares`` of its bytes
    of text; every batch is committed, and the first four are compacted into one run
    before the last comes. Returns ``doc_id, n_words, n_removed, kept``. Windows are
    judged on the input.

    Null text: no words. Null doc_id: last. Rows that repeat a doc_id are in the input's
    order. However ids are spread, chunks and batches go by bytes of text; rows of one id
    stay together. Documents shorter than a window keep all; very long ones are read
    whole. Other columns are ignored. An empty table gives an empty result. Windows are
    told apart by a 64-bit hash and a check value of ``check_bytes``.
    """
    return indexed(docs, window, shares, scope)[0]


def indexed(docs: DataFrame, window: int, shares: tuple[float, ...], scope: str = "") -> tuple[DataFrame, FingerprintIndex]:
    """``deduplicated``, and the index with all windows of the table."""
    ordered, stretches = in_order(docs.select("doc_id", "text"), scope)
    upto = np.cumsum([x[4] for x in stretches])
    total = int(upto[-1]) if len(upto) else 0
    index, out = FingerprintIndex(docs.sparkSession, window, total, scope), None
    bounds = index.bounds(stretches)
    cuts = sorted({int(stretches[int(i)][1]) for s in shares if (i := np.searchsorted(upto, total * s)) and i < len(stretches)})
    key = F.coalesce(F.col("doc_id"), F.lit(LAST))
    for k in range(len(cuts) + 1):
        part, own = ordered, bounds
        if k:
            part, own = part.filter(key >= cuts[k - 1]), own[own >= cuts[k - 1]]
        if k < len(cuts):
            part, own = part.filter(F.col("doc_id") < cuts[k]), own[own < cuts[k]]
        got = index.add_ordered(part, own)
        out = got if out is None else out.unionByName(got)
    return out, index


def digest(df: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``."""
    return df.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


__all__ = ["FingerprintIndex", "deduplicated", "digest", "indexed"]
