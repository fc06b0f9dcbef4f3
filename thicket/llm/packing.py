"""Mixture-controlled packing by deficit round-robin.

Each source is a queue of its documents' tokens with a speed, its target share of every
window. A queue's deficit grows by its speed as the clock runs; at one half the queue
is served a token and its deficit falls by one. What a queue is owed at the end of a
window, or has had too early, it carries into the next one. A queue that has run dry
drops out, and the others go on at their speeds.

A queue's j-th token is thus served at the moment (j + 1/2) / speed, whatever the other
queues do. So the state before any window, all deficits included, follows by counting,
and is the one that the rounds reach if they are run one by one from the start. Any
task can place its own documents: only totals by task and source are exchanged.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.llm.shared import attach, batches, shared_table

#: Windows whose states are counted at once, and values that the remembered states may have.
STRETCH, REMEMBERED = 64, 1 << 22
#: Sources that may have queues; the table of queues, a row each, goes to the driver and all tasks.
MOST_QUEUES = 1_000_000
#: Letters whose lower case depends on the place or is longer; left to the tokenizer.
SIGMA = frozenset("Σİ")


class TokenMemo(dict):
    """A chunk's ids as little-endian unsigned 16- or 32-bit values, remembered.

    Words of letters, alone or with a run of ASCII marks behind, are lower-cased here and
    go to the tokenizer's model as they are after its own first steps; all else goes
    through the whole tokenizer. Both give the same ids.
    """

    LIMIT = 150_000

    def __init__(self, path: str, kind: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.kind, self.pieces = self.tokenizer.model, kind, {}
        #: What was remembered before the last LIMIT chunks and pieces.
        self.older: dict[str, bytes] = {}
        self.older_pieces: dict[str, bytes] = {}
        self.code = {"<u2": "H", "<u4": "I"}[kind]  # of the machine, which is little-endian
        self.visible = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # Plain words must pass unchanged through the first steps for the short way to hold.
        probe = [("Déjà", "déjà"), ("Abc.", "abc ."), ("xyZ,", "xyz ,"), ("été%%'!", "été %%'!")]
        steps = lambda x: " ".join(p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(x)))
        self.short = bool(self.tokenizer.normalizer and self.tokenizer.pre_tokenizer) and all(steps(x) == " ".join(map(self.bytes_visible, y.split())) for x, y in probe)

    def bytes_visible(self, piece: str) -> str:
        return piece if piece.isascii() else self.visible.pre_tokenize_str(piece)[0][0]

    def piece(self, piece: str) -> bytes:
        known = self.pieces.get(piece)
        if known is None:
            if len(self.pieces) >= self.LIMIT:
                self.older_pieces, self.pieces = self.pieces, {}
            known = self.older_pieces.get(piece)
            if known is None:
                known = array(self.code, [x.id for x in self.model.tokenize(self.bytes_visible(piece))]).tobytes()
            self.pieces[piece] = known
        return known

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.LIMIT:
            self.older = dict(self)
            self.clear()
        value = self.older.get(chunk)
        if value is None:
            value = self.fresh(chunk)
        self[chunk] = value
        return value

    def fresh(self, chunk: str) -> bytes:
        plain = self.short
        if chunk.isascii():
            low = chunk.lower()
        else:
            low = unicodedata.normalize("NFC", chunk).lower()
            plain = plain and not SIGMA.intersection(chunk)
        if plain and low.isalpha():
            return self.piece(low)
        word = low.rstrip(punctuation)
        if plain and word.isalpha():
            return self.piece(word) + self.piece(low[len(word) :])
        return self.whole(chunk)

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        """Ids of a text. The tokenizer drops white space and joins nothing across it.

        Its white space is Unicode's, so texts with other separators that Python would
        split at go through it whole.
        """
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(4)
def memo_of(path: str, kind: str) -> TokenMemo:
    """One memo for all tasks of a Python worker."""
    return TokenMemo(path, kind)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


class Rounds:
    """The deficit round-robin over queues of known lengths and speeds.

    Windows of ``size`` tokens are filled one after the other. Of tokens due at the same
    moment, that of the first queue goes first.
    """

    def __init__(self, lengths: list[int], speeds: list[float], size: int) -> None:
        self.lengths, self.speeds, self.size = np.array(lengths, np.int64), np.array(speeds, float), size
        self.total = int(self.lengths.sum())
        self.windows = -(-self.total // size)
        # The moments at which queues run dry, and the tokens served until then but for rounding.
        dry = self.lengths / self.speeds
        order = np.argsort(dry, kind="stable")
        rate = np.maximum(self.speeds.sum() - np.concatenate([[0.0], np.cumsum(self.speeds[order])[:-1]]), self.speeds[order])
        self.moments = np.concatenate([[0.0], dry[order]])
        self.served = np.concatenate([[0.0], np.cumsum(np.diff(self.moments) * rate)])
        self.stretch = max(1, min(STRETCH, 4096 // max(len(lengths), 1)))
        self.table = lru_cache(max(16, REMEMBERED // max((self.stretch + 1) * len(lengths), 1)))(self._table)

    def states(self, windows: np.ndarray) -> np.ndarray:
        """Tokens that each queue has given before each of the windows: a row a window.

        Rounding moves the count at any moment by half a token a queue. So tokens due
        well before the window's start are counted as they are, and of the few about it
        those due first fill up to the start.
        """
        goal, s = np.minimum(windows * self.size, self.total), len(self.lengths)
        low, high = (np.interp(goal + d, self.served, self.moments) for d in (-s, s))
        due = lambda t, more: np.clip(np.floor(self.speeds * t[:, None] * (1 + more * 1e-12) + 0.5).astype(np.int64) + more, 0, self.lengths)
        base = due(low, -1)
        count = (due(high, 1) - base).ravel()
        cell = np.repeat(np.arange(len(count)), count)
        token = base.ravel()[cell] + np.arange(len(cell)) - np.repeat(np.cumsum(count) - count, count)
        window, queue = np.divmod(cell, s)
        order = np.lexsort((queue, (2 * token + 1) / (2 * self.speeds[queue]), window))
        rank = np.arange(len(cell)) - np.searchsorted(window[order], np.arange(len(goal)))[window[order]]
        first = cell[order][rank < (goal - base.sum(1))[window[order]]]
        return base + np.bincount(first, minlength=len(count)).reshape(base.shape)

    def _table(self, k: int) -> np.ndarray:
        return self.states(np.arange(k * self.stretch, (k + 1) * self.stretch + 1))

    def place(self, queue: int, start: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """Where tokens [start, start + length) of a queue go: (token, count, window, offset)."""
        moment = (2 * start + 1) / (2 * self.speeds[queue])
        k = max(0, int(np.interp(moment, self.moments, self.served) - len(self.lengths) - 1) // self.size) // self.stretch
        end = start + length
        while start < end:
            table = self.table(k)
            own = table[:, queue]
            i = int(np.searchsorted(own, start, "right")) - 1
            while start < end and i < len(own) - 1:
                stop = min(end, int(own[i + 1]))
                if stop > start:
                    before = int((table[i + 1, :queue] - table[i, :queue]).sum())
                    yield start, stop - start, k * self.stretch + i, before + start - int(own[i])
                    start = stop
                i += 1
            k += 1


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, scope: str = "") -> DataFrame:
    """A shared table ``doc_id, source, n, ids, task, start``.

    ``ids`` ends with ``end_id``; ``start`` counts the tokens of the same source before
    the document in its task. A row stands for a document; null text is empty.
    """
    kind = "<u2" if max(vocabulary_size(tokenizer), end_id + 1) <= 1 << 16 else "<u4"
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("n", pa.int64()), ("ids", pa.binary()), ("task", pa.int64()), ("start", pa.int64())])

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        memo, done = memo_of(tokenizer, kind), {}
        end, width = np.array([end_id], kind).tobytes(), int(kind[2])
        for batch in parts:
            for doc_id, source, text, task in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = memo.ids(text) + end if text else end
                n = len(ids) // width
                yield doc_id, source, n, ids, task, done.get(source, 0)
                done[source] = done.get(source, 0) + n

    plain = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text", F.spark_partition_id().cast("long").alias("task"))
    out = plain.mapInArrow(lambda parts: batches(rows(parts), schema), "doc_id long, source string, n long, ids binary, task long, start long")
    return shared_table(out, "pack-tokens", scope)


def pack(docs: DataFrame, tokenizer: str, weights: dict[str | None, float] | tuple[float, ...] | None = None, size: int = 4096, end_id: int = 2, scope: str = "", with_ids: bool = False) -> DataFrame:
    """Pack all tokens of all documents into sequences of at most ``size`` tokens.

    Returns one row a piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``, the source, and the ids as unsigned 32-bit values if
    ``with_ids``. Every sequence has ``size`` tokens but those that hold the last
    window's remainder, which is split at powers of two, so nothing is padded.

    ``weights`` sets the target proportions of every window: by source (missing: 1), or
    dealt to the sources by code point, null last, over and over. They hold among the
    sources that have tokens left. None means each source's share of all tokens, which
    holds to the end. Each source has a queue of its own; there may be MOST_QUEUES.

    Null text: the end id alone. Very long texts are cut like all others; one text's
    ids are in memory at once. Null source: a queue of its own. Null doc_id stays null.
    Repeated rows are documents of their own. Other columns are ignored. An empty table
    gives an empty result.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    spark = docs.sparkSession
    table = tokenized(docs, tokenizer, end_id, scope)
    by_task = table.groupBy("source", "task").agg(F.sum("n").alias("n")).checkpoint()
    sums = {r["source"]: r["n"] for r in by_task.groupBy("source").agg(F.sum("n").alias("n")).limit(MOST_QUEUES + 1).collect()}  # a row a source, MOST_QUEUES at most
    if len(sums) > MOST_QUEUES:
        raise ValueError(f"more than {MOST_QUEUES} sources")
    names = sorted(sums, key=lambda s: (s is None, (s or "").encode()))
    totals = [sums[s] for s in names]
    speeds = totals if weights is None else [float(weights.get(s, 1)) for s in names] if isinstance(weights, dict) else [float(weights[i % len(weights)]) for i in range(len(names))]
    if min(speeds, default=1) <= 0:
        raise ValueError("weights must be positive")
    queues = spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "s string, queue int")
    placed = attach(by_task, queues, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    order = Window.partitionBy("queue").orderBy("task")  # a row a task
    bases = placed.withColumn("base", F.sum("n").over(order) - F.col("n")).select(F.col("source").alias("s"), F.col("task").alias("t"), "queue", "base").checkpoint()
    ready = attach(table, bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("task") == F.col("t")))
    width = "<u2" if max(vocabulary_size(tokenizer), end_id + 1) <= 1 << 16 else "<u4"
    types = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("source", pa.string())]
    schema = pa.schema([*types, *([("ids", pa.binary())] if with_ids else [])])

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        rounds = Rounds(totals, speeds, size)
        for batch in parts:
            for doc_id, source, n, ids, queue, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = np.frombuffer(ids, width).astype("<u4")
                for token, count, window, offset in rounds.place(queue, base, n):
                    begin = token - base
                    for sequence, at, length in tail(rounds, window, offset, count):
                        piece = values[begin : begin + length].tobytes()
                        yield doc_id, begin, length, zlib.crc32(piece), n, sequence, at, source, *([piece] if with_ids else [])
                        begin += length

    def tail(r: Rounds, window: int, offset: int, count: int) -> Iterator[tuple[int, int, int]]:
        """(sequence, offset, length): a window that isn't full is cut into sequences at powers of two."""
        room = r.total - window * r.size
        if room >= r.size:
            yield window, offset, count
            return
        at, j = 0, 0
        for bit in range(r.size.bit_length(), -1, -1):
            if room >> bit & 1:
                a, b = max(offset, at), min(offset + count, at + (1 << bit))
                if a < b:
                    yield window + j, a - at, b - a  # only the very last window is short
                at += 1 << bit
                j += 1

    names_sql = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + ", ids binary" * with_ids
    return ready.select("doc_id", "source", "n", "ids", "queue", F.col("base") + F.col("start")).mapInArrow(lambda parts: batches(rows(parts), schema), names_sql)


__all__ = ["Rounds", "TokenMemo", "pack", "tokenized"]
