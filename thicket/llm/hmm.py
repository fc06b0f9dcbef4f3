"""Language model scoring with a hidden Markov model.

Hidden states emit symbols, which are hash values of words, and a symbol emits its
words by their smoothed frequency, so the states' tables have a fixed size and the
word counts stay distributed. Baum-Welch runs over all training documents as whole
sequences: tasks sum expected counts, which are added up across partitions, until the
likelihood rises no more. A text's score is its exact likelihood by the scaled forward
recursion.

Texts are read once into chunks with a vocabulary of their own, and a task's chunks
into groups; a group asks for the counts of its words, one sorted block of hashes per
hash range, and gets them back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.shared import shared_table, text_bytes

#: Tokens at most (of more than one document) and distinct words at which a chunk ends, and chunks of a group.
CHUNK_TOKENS, CHUNK_WORDS, GROUP_CHUNKS = 400_000, 60_000, 8
#: Hash of the end token, which no word can be.
END = np.uint64(0)
#: Bytes of words that are counted in one range of hashes, and the least mean number of a group's words in a range.
RANGE_BYTES, ROW_WORDS = 32 << 20, 64
#: Tokens of a segment, those that lead into it, and how far states may differ where segments meet.
RUN, WARM, TOLERANCE = 256, 48, 1e-4
#: Symbols in a block of counts.
BLOCK = 1024
#: Weight of the corpus' frequencies in each state's emissions.
PRIOR = 0.5

CHUNK_SQL = "kind int, grp long, chunk long, docs binary, lens binary, held binary, ids binary, words binary, trains binary"
CHUNK_NAMES = [x.split()[0] for x in CHUNK_SQL.split(", ")]
NULL_ID = -(1 << 63)


def chunks(parts: Iterator[pa.RecordBatch], test_part: int, folds: int) -> Iterator[pa.RecordBatch]:
    """Rows of CHUNK_SQL. Kind 1 is a chunk: the documents' ids and lengths, tokens as places in
    ``words``, and the distinct word hashes in order. Kind 0 is a group of chunks: their distinct
    words in order, and how often each stands in training documents."""
    serial, group, task = 0, 0, 0
    places = Places()
    held: list[np.ndarray] = []
    docs: list[int] = []
    tests: list[bool] = []
    counted: list[tuple[int, np.ndarray, np.ndarray]] = []
    tokens = 0

    def record(*row) -> pa.RecordBatch:
        types = (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6)
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=CHUNK_NAMES)

    def close() -> pa.RecordBatch:
        nonlocal serial
        lens = np.array([len(x) for x in held], np.int32)
        words, rank = np.unique(places.hashes(), return_inverse=True)
        ids = rank.astype(np.uint16 if len(words) <= 1 << 16 else np.uint32)[np.concatenate(held)]
        counted.append((serial, words, np.bincount(ids[np.repeat(~np.array(tests), lens)], minlength=len(words))))
        serial += 1
        return record(1, (task << 24) + group, serial, np.array(docs, np.int64).tobytes(), lens.tobytes(), np.array(tests, np.uint8).tobytes(), ids.tobytes(), words.tobytes(), None)

    def close_group() -> pa.RecordBatch:
        nonlocal group
        words, counts = merged(counted)
        counted.clear()
        group += 1
        return record(0, (task << 24) + group - 1, None, None, None, None, None, words.tobytes(), counts.astype(np.uint64).tobytes())

    for batch in parts:
        for text, doc_id, label, part in zip(text_bytes(batch), batch.column("doc_id").to_pylist(), batch.column("label").to_pylist(), batch.column("task").to_pylist(), strict=True):
            words = text.lower().split()
            if held and (tokens + len(words) > CHUNK_TOKENS or len(places) >= CHUNK_WORDS):
                yield close()
                places, held, docs, tests, tokens = Places(), [], [], [], 0
                if len(counted) == GROUP_CHUNKS:
                    yield close_group()
            held.append(np.fromiter(chain(map(places.__getitem__, words), (0,)), np.uint32, len(words) + 1))
            docs.append(NULL_ID if doc_id is None else doc_id)
            tests.append(zlib.crc32((label or "").encode()) % folds == test_part)
            tokens += len(words) + 1
            task = part
    if held:
        yield close()
        yield close_group()


class Places(dict):
    """Words by the order in which they first come; the end of a text is the first."""

    def __init__(self) -> None:
        self[None] = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place

    def hashes(self) -> np.ndarray:
        return np.fromiter((END if w is None else xxhash.xxh3_64_intdigest(w, 11) or 1 for w in self), np.uint64, len(self))


def symbol(words: np.ndarray, symbols: int) -> np.ndarray:
    return (words % np.uint64(symbols - 1)).astype(np.int32) + 1 - (words == END)


def range_bits(words: int, groups: int) -> int:
    """Leading bits of a hash that make its range, so that a range has about RANGE_BYTES of words
    of all groups; but rows grow only with the words, so each has ROW_WORDS of them on average."""
    by_size = (words * 16 // RANGE_BYTES).bit_length()
    most = (words // max(groups, 1) // ROW_WORDS).bit_length() - 1
    return max(4, min(by_size, most))


def asked(parts: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """A group's words and counts by range of hashes: ``range, grp, words, counts``."""
    for batch in parts:
        for group, words, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            w, c = np.frombuffer(words, np.uint64), np.frombuffer(counts, np.uint64)
            bounds = np.searchsorted(w >> np.uint64(64 - bits), np.arange((1 << bits) + 1).astype(np.uint64))
            cut = [(r, bounds[r], bounds[r + 1]) for r in range(1 << bits) if bounds[r + 1] > bounds[r]]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in cut], pa.int32()), pa.array([group] * len(cut), pa.int64()), pa.array([w[a:b].tobytes() for _, a, b in cut], pa.binary()), pa.array([c[a:b].tobytes() for _, a, b in cut], pa.binary())], ["range", "grp", "words", "counts"])


def answered(symbols: int):
    """Blocks sorted by range become ``range, grp, counts`` with the totals of the block's words;
    and a task's sums by symbol, tokens and distinct words, as blocks of symbols with grp null."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blocks, table = None, [], np.zeros((symbols, 2))

        def emit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(rows), 200):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 200], strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["range", "grp", "counts"])

        def close() -> Iterator[pa.RecordBatch]:
            words, counts = merged(blocks)
            seen = counts > 0
            s = symbol(words[seen], symbols)
            table[:, 0] += np.bincount(s, counts[seen], symbols)
            table[:, 1] += np.bincount(s, minlength=symbols)
            yield from emit([(at, group, counts[np.searchsorted(words, w)].astype(np.uint64).tobytes()) for group, w, _ in blocks])

        for batch in parts:
            for r, group, words, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != at and blocks:
                    yield from close()
                    blocks = []
                at = r
                blocks.append((group, np.frombuffer(words, np.uint64), np.frombuffer(counts, np.uint64)))
        if blocks:
            yield from close()
            yield from emit([(b, None, table[b * BLOCK : (b + 1) * BLOCK].tobytes()) for b in range(-(-symbols // BLOCK))])

    return run


def merged(blocks: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    words, inverse = np.unique(np.concatenate([b[1] for b in blocks]), return_inverse=True)
    return words, np.bincount(inverse, np.concatenate([b[2] for b in blocks]), len(words)).astype(np.int64)


class Model:
    """``first`` (K), ``step`` (K x K) and ``emit`` (symbols x K): probabilities."""

    def __init__(self, first: np.ndarray, step: np.ndarray, emit: np.ndarray) -> None:
        self.first, self.step, self.emit = (x.astype(np.float32) for x in (first, step, emit))

    @classmethod
    def start(cls, counts: np.ndarray, states: int, seed: int) -> Model:
        """Symbol frequencies, bent at random by state; states that tend to last."""
        rng = np.random.default_rng(seed)
        emit = (counts[:, None] + 0.01) * rng.gamma(1.0, 1.0, (len(counts), states))
        step = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        return cls(np.full(states, 1 / states), step, emit / emit.sum(0))


def by_length(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences from long to short, their starts, and how many are longer than each step."""
    order = np.argsort(-lens, kind="stable")
    sizes = lens[order]
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), "right") if len(sizes) else np.zeros(0, int)
    return order, np.concatenate([[0], np.cumsum(lens)[:-1]])[order], active


def forward(model: Model, symbols: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each sequence, exact, by the scaled forward recursion."""
    order, starts, active = by_length(lens)
    out = np.zeros(len(lens))
    if not len(lens):
        return out
    alpha, total, ones = None, np.zeros(len(lens)), np.ones((len(model.first), 1), np.float32)
    for t, n in enumerate(active):
        e = model.emit.take(symbols.take(starts[:n] + t), 0)
        alpha = e * model.first if alpha is None else (alpha[:n] @ model.step) * e
        scale = alpha @ ones
        alpha *= 1 / scale
        total[:n] += np.log(scale[:, 0])
    out[order] = total
    return out


def rows(table: np.ndarray) -> np.ndarray:
    """A table's rows as single values, which are moved at once."""
    return table.view(f"V{table.shape[1] * table.itemsize}").ravel()


def sweep(model: Model, emits: np.ndarray, starts: np.ndarray, lens: np.ndarray, prior: np.ndarray, alphas: np.ndarray | None = None, scales: np.ndarray | None = None) -> np.ndarray:
    """The scaled forward recursion over segments that start from ``prior``; the last states of each.

    ``emits`` has what each state gives each token.
    States and scales of all tokens are put into ``alphas`` and ``scales`` if given.
    """
    order, _, active = by_length(lens)
    starts, alpha, ones = starts[order], None, np.ones((len(model.first), 1), np.float32)
    last = np.empty((len(lens), len(model.first)), np.float32)
    for t, n in enumerate(active):
        at = starts[:n] + t
        alpha = (prior[order] if alpha is None else alpha[:n] @ model.step) * emits.take(at, 0)
        scale = alpha @ ones
        alpha *= 1 / scale
        if alphas is not None:
            rows(alphas)[at], scales[at] = rows(alpha), scale[:, 0]
        ended = slice(active[t + 1] if t + 1 < len(active) else 0, n)
        last[order[ended]] = alpha[ended]
    return last


def sweep_back(model: Model, emits: np.ndarray, starts: np.ndarray, lens: np.ndarray, after: np.ndarray, betas: np.ndarray | None = None) -> np.ndarray:
    """The backward recursion over segments that end with ``after``; what stands before each segment's first token.

    ``emits`` are over the scales of the forward recursion here; ``betas`` is filled if given.
    """
    order, _, active = by_length(lens)
    starts, after, turn = starts[order], after[order], model.step.T.copy()
    beta = after[:0]
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        if len(beta) < n:
            beta = np.concatenate([beta, after[len(beta) : n]])
        if betas is not None:
            rows(betas)[at] = rows(beta)
        beta = (beta * emits.take(at, 0)) @ turn
    out = np.empty_like(after)
    out[order] = beta
    return out


def expected(model: Model, symbols: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts (first, step, emit) of whole sequences, and their log likelihood.

    Long sequences are cut into segments that run side by side, each led into by the
    WARM tokens before it and, on the way back, behind it. Where the states that it
    started from are not those in which the one before ended, it runs again from those,
    and so on until all meet: then the counts are those of the uncut recursion.
    """
    k = len(model.first)
    pieces = np.maximum(-(-lens // RUN), 1)
    seq = np.repeat(np.arange(len(lens)), pieces)
    nth = np.arange(len(seq)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = (np.cumsum(lens) - lens)[seq] + nth * RUN
    sizes = np.minimum(lens[seq] - nth * RUN, RUN)
    later = np.flatnonzero(nth > 0)  # segments that go on from the one before
    rest = np.linalg.matrix_power(model.step.astype(float), 64)[0].astype(np.float32)
    emits = model.emit[symbols]
    alphas, scales = np.empty((len(symbols), k), np.float32), np.empty(len(symbols), np.float32)
    prior = np.tile(model.first, (len(seq), 1))
    came = np.empty((len(seq), k), np.float32)
    came[later] = sweep(model, emits, starts[later] - WARM, np.full(len(later), WARM), np.tile(rest, (len(later), 1)))
    todo, last = np.arange(len(seq)), np.empty((len(seq), k), np.float32)
    while len(todo):
        on = todo[nth[todo] > 0]
        prior[on] = came[on] @ model.step
        last[todo] = sweep(model, emits, starts[todo], sizes[todo], prior[todo], alphas, scales)
        todo = later[np.abs(last[later - 1] - came[later]).max(1) > TOLERANCE] if len(later) else later
        came[todo] = last[todo - 1]
    emits /= scales[:, None]
    betas = np.empty_like(alphas)
    after = np.ones((len(seq), k), np.float32)
    before = later - 1
    unit = lambda b: b / (b * last[before]).sum(1, keepdims=True)
    ahead = np.empty((len(seq), k), np.float32)
    ahead[later] = sweep_back(model, emits, starts[later], np.minimum(sizes[later], WARM), after[later])
    after[before] = unit(ahead[later])
    todo = np.arange(len(seq))
    while len(todo):
        ahead[todo] = sweep_back(model, emits, starts[todo], sizes[todo], after[todo], betas)
        met = unit(ahead[later])
        todo = before[np.abs((met - after[before]) * last[before]).max(1) > TOLERANCE] if len(later) else later
        after[before] = met
    emits *= betas  # what a step into a token adds
    into = np.ones(len(symbols), bool)
    firsts = np.cumsum(lens) - lens
    into[firsts] = False
    step = (alphas[:-1][into[1:]].T @ emits[into]).astype(np.float64) * model.step
    alphas *= betas  # the states' probabilities
    emit = np.stack([np.bincount(symbols, alphas[:, i], len(model.emit)) for i in range(k)], 1)
    return alphas[firsts].sum(0, dtype=np.float64), step, emit, float(np.log(scales, dtype=np.float64).sum())


def sequences(batch: pa.RecordBatch, symbols: int) -> Iterator[tuple]:
    """Of each chunk row: docs, lens, held, ids, symbols of the tokens, and all columns."""
    for row in batch.to_pylist():
        words = np.frombuffer(row["words"], np.uint64)
        ids = np.frombuffer(row["ids"], np.uint16 if len(words) <= 1 << 16 else np.uint32)
        yield np.frombuffer(row["docs"], np.int64), np.frombuffer(row["lens"], np.int32), np.frombuffer(row["held"], np.uint8).astype(bool), ids, symbol(words, symbols)[ids], row


def train_counts(model, symbols: int):
    """Expected counts of a partition, in blocks of symbols: ``block, counts``; block -1 has the rest."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, sums = model.value, None
        for batch in parts:
            for _, lens, held, _, tokens, _ in sequences(batch, symbols):
                if held.all():
                    continue
                new = expected(m, tokens[np.repeat(~held, lens)], lens[~held].astype(np.int64))
                sums = new if sums is None else tuple(a + b for a, b in zip(sums, new, strict=True))
        if sums is None:
            return
        first, step, emit, likelihood = sums
        rows = [(-1, np.concatenate([first, step.ravel(), [likelihood]]).astype(np.float64).tobytes())]
        rows += [(b, emit[b * BLOCK : (b + 1) * BLOCK].astype(np.float32).tobytes()) for b in range(-(-symbols // BLOCK))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "counts"])

    return run


def add_blocks(kind: type):
    """Blocks of one key, added up; numbers of ``kind``, but float64 in those of negative keys."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in parts:
            for block, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                value = np.frombuffer(counts, np.float64 if block < 0 else kind).astype(np.float64)
                sums[block] = sums[block] + value if block in sums else value
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])

    return run


def total_blocks(rows: DataFrame, blocks: int, kind: type) -> dict[int, np.ndarray]:
    """The sums of ``block, counts``, added up in tasks; a model's size comes to the driver."""
    out = rows.repartition(min(blocks + 1, 16), "block").mapInArrow(add_blocks(kind), "block int, counts binary").collect()
    return {r["block"]: np.frombuffer(r["counts"], np.float64) for r in out}


def baum_welch(table: DataFrame, counts: np.ndarray, states: int, rounds: int, seed: int, gain: float) -> Model:
    """Train on the chunks' training documents, until a round raises the mean log likelihood of a
    token by less than ``gain`` over the one before, or ``rounds`` are done."""
    sc, symbols = table.sparkSession.sparkContext, len(counts)
    model, before = Model.start(counts, states, seed), None
    blocks = -(-symbols // BLOCK)
    for _ in range(rounds):
        sent = sc.broadcast(model)
        got = total_blocks(table.select("docs", "lens", "held", "ids", "words").mapInArrow(train_counts(sent, symbols), "block int, counts binary"), blocks, np.float32)
        sent.unpersist()
        if not got:
            break
        first, step = got[-1][:states], got[-1][states:-1].reshape(states, states)
        emit = np.concatenate([got[b].reshape(-1, states) for b in range(blocks)])
        # Every state can emit every symbol: PRIOR counts a symbol, in the corpus' own proportions.
        emit = emit + PRIOR * symbols * (counts[:, None] + 0.5) / (counts.sum() + 0.5 * symbols)
        model = Model((first + 0.1) / (first + 0.1).sum(), (step + 0.1) / (step + 0.1).sum(1, keepdims=True), emit / emit.sum(0))
        now = got[-1][-1] / max(counts.sum(), 1)
        if before is not None and now - before < gain:
            break
        before = now
    return model


def scores(docs: DataFrame, test_part: int = 1, folds: int = 5, states: int = 12, symbols: int = 1 << 14, rounds: int = 5, seed: int = 5, gain: float = 1e-3, scope: str = "") -> DataFrame:
    """Score all documents by a model trained on those outside the held-out part.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.
    A document is held out if the CRC-32 of its id as text leaves ``test_part`` modulo
    ``folds``. Tokens are its words in ASCII lower case and an end; ``base_score`` is the
    smoothed unigram log10 probability, ``score`` the hidden Markov model's. Words are
    told apart by 64-bit hashes.

    Null text: only the end. Very long texts are one sequence in training and scoring;
    one text's tokens are in memory at once. Null doc_id: trained on. Repeated rows are
    documents of their own. Other columns are ignored. With nothing to train on all
    words are unknown. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("text").cast("binary").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.col("doc_id").cast("string").alias("label"), F.spark_partition_id().cast("long").alias("task"))
    table = shared_table(plain.mapInArrow(lambda p: chunks(p, test_part, folds), CHUNK_SQL), "lm-chunks", scope)
    groups, table = table.filter("kind = 0").select("grp", "words", "trains"), table.filter("kind = 1").select("grp", "chunk", "docs", "lens", "held", "ids", "words")
    words, n = groups.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0)) / 8, F.count(F.lit(1))).first()
    bits = range_bits(int(words), n)
    blocks = groups.mapInArrow(lambda p: asked(p, bits), "range int, grp long, words binary, counts binary")
    replies = shared_table(blocks.repartition(1 << bits, "range").sortWithinPartitions("range").mapInArrow(answered(symbols), "range int, grp long, counts binary"), "lm-counts", scope)
    sums = total_blocks(replies.filter("grp is null").select(F.col("range").alias("block"), "counts"), -(-symbols // BLOCK), np.float64)
    per_symbol = np.concatenate([sums[b] for b in sorted(sums)]).reshape(-1, 2) if sums else np.zeros((symbols, 2))
    model = baum_welch(table, per_symbol[:, 0], states, rounds, seed, gain)
    sent = spark.sparkContext.broadcast((model, per_symbol))  # its size is fixed
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, table = sent.value
        total, kinds = table.sum(0)
        known, answers = np.zeros(0, np.uint64), []
        for batch in parts:
            for i, kind in enumerate(batch.column("kind").to_pylist()):
                if kind == 0:
                    known, answers = np.frombuffer(batch.column("words")[i].as_py(), np.uint64), []
                    continue
                if kind == 1:
                    answers.append(np.frombuffer(batch.column("counts")[i].as_py(), np.uint64))
                    continue
                if len(answers) != 1:
                    answers = [np.concatenate(answers)]
                ((ids_of, lens, held, ids, tokens, row),) = sequences(batch.slice(i, 1), symbols)
                own_words = np.frombuffer(row["words"], np.uint64)
                counts = answers[0][np.searchsorted(known, own_words)].astype(np.float64)
                s = symbol(own_words, symbols)
                base = np.log10((counts + 0.5) / (total + 0.5 * (kinds + 1)))
                own = np.log((counts + 0.5) / (table[s, 0] + 0.5 * (table[s, 1] + 1)))
                cuts = np.concatenate([[0], np.cumsum(lens)[:-1]])
                sums = lambda x: np.add.reduceat(x[ids], cuts)  # noqa: B023, E731
                full = (forward(m, tokens, lens.astype(np.int64)) + sums(own)) / np.log(10)
                yield pa.RecordBatch.from_arrays([pa.array(ids_of, mask=ids_of == NULL_ID), pa.array(held), pa.array(lens.astype(np.int64)), pa.array(sums((counts > 0).astype(np.int64))), pa.array(np.full(len(lens), int(total))), pa.array(sums(base)), pa.array(full)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    # A group's words, the answers to it in order, and then its chunks.
    none = F.lit(None).cast("binary")
    sides = [groups.select("grp", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("pos"), none.alias("docs"), none.alias("lens"), none.alias("held"), none.alias("ids"), "words", none.alias("counts"))]
    sides += [replies.filter("grp is not null").select("grp", F.lit(1).alias("kind"), F.col("range").cast("long").alias("pos"), none.alias("docs"), none.alias("lens"), none.alias("held"), none.alias("ids"), none.alias("words"), "counts")]
    sides += [table.select("grp", F.lit(2).alias("kind"), F.col("chunk").alias("pos"), "docs", "lens", "held", "ids", "words", none.alias("counts"))]
    ready = sides[0].unionByName(sides[1]).unionByName(sides[2]).repartition(max(1, 2 * n), "grp").sortWithinPartitions("grp", "kind", "pos")
    return ready.mapInArrow(score, schema)
