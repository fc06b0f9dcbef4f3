"""Quality classifier: ordinal regression with cumulative links on hashed text.

One weight vector scores a text; ordered thresholds cut the scores into grades:
P(grade <= j) = sigmoid(threshold[j] - score). The same weights serve all thresholds,
so a text's expected grade and the probability of each tail come from one score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.shared import WordHash, batches, text_bytes

#: Features are hashed to so many weights.
SIZE = 1 << 18
#: Grades: toxic, of low quality, good.
GRADES = 3
EDGES = b".,;:!?\"'()[]{}|*#"


class Features:
    """The distinct features of a text: its words without outer marks, and steps of its style."""

    def __init__(self) -> None:
        self.memo = WordHash(7)

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.split()
        n = len(words)
        raw = set(words)
        out = self.memo.all([w.lower().strip(EDGES) for w in raw]) % np.uint64(SIZE - 512)
        letters = sum(map(text.count, (b"e", b"a", b"n", b"i", b"E", b"A", b"N", b"I")))
        upper = sum(map(text.count, (b"E", b"A", b"N", b"I")))
        style = [
            (0, 0 if not n else 1 + min(14, n.bit_length())), (1, int(15 * len(raw) / max(n, 1))), (2, int(15 * upper / max(letters, 1))),
            (3, min(15, int(60 * text.count(b"!") / max(n, 1)))), (4, min(15, int(60 * text.count(b"|") / max(n, 1)))), (5, min(15, int(60 * text.count(b".") / max(n, 1)))),
            (6, min(15, int(2 * len(text) / max(n, 1) / 3))), (7, min(15, int(100 * text.count(b"\n") / max(n, 1)))), (8, min(15, int(30 * sum(map(text.count, b"#*$%&<>")) / max(n, 1)))),
        ]
        return np.unique(np.concatenate([out.astype(np.int64), [SIZE - 512 + 16 * k + min(v, 15) for k, v in style]]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, least: float = 0.5) -> None:
        self.weights, self.thresholds, self.least = weights, thresholds, least

    def score(self, features: np.ndarray) -> float:
        return float(self.weights[features].sum())

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1 .. GRADES - 1 (columns)."""
        return sigmoid(scores[:, None] - self.thresholds)


def thresholds_of(free: np.ndarray) -> np.ndarray:
    """Ordered thresholds: the first, and then gaps that are exponentials."""
    return np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def slopes(w: np.ndarray, free: np.ndarray, rows: list[np.ndarray], y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of grades ``y``, and its derivatives by the weights and by ``free``."""
    cols, of = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    s = np.bincount(of, w[cols], len(rows))
    t = np.concatenate([[-np.inf], thresholds_of(free), [np.inf]])
    up, down = sigmoid(np.clip(t[y + 1] - s, -35, 35)), sigmoid(np.clip(t[y] - s, -35, 35))
    p = np.maximum(up - down, 1e-9)
    du, dd = up * (1 - up) / p, down * (1 - down) / p  # by the upper and the lower threshold
    grad = np.bincount(cols, ((du - dd) / len(rows))[of], len(w))
    by = np.array([(dd[y == j + 1].sum() - du[y == j].sum()) / len(rows) for j in range(len(free))])
    return float(-np.log(p).mean()), grad, np.array([by.sum()] + [by[j:].sum() * np.exp(free[j]) for j in range(1, len(free))])


def fit(rows: list[np.ndarray], grades: np.ndarray, epochs: int = 10, rate: float = 0.1, decay: float = 2e-3, batch: int = 128, seed: int = 3) -> Model:
    """Maximum likelihood by AdaGrad over mini-batches."""
    rng = np.random.default_rng(seed)
    w, g = np.zeros(SIZE), np.full(SIZE, 1e-2)
    free, f = np.array([-1.0] + [0.0] * (GRADES - 2)), np.full(GRADES - 1, 1e-2)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), batch):
            own = order[start : start + batch]
            _, grad, d = slopes(w, free, [rows[i] for i in own], grades[own])
            hit = np.flatnonzero(grad)
            grad = grad[hit] + decay * w[hit] / len(own)
            g[hit] += grad**2
            w[hit] -= rate * grad / np.sqrt(g[hit])
            f += d**2
            free -= rate * d / np.sqrt(f)
    return Model(w, thresholds_of(free))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 16_000, false_rejection: float = 0.002, seed: int = 3) -> Model:
    """Fit on a sample of at most ``max_rows`` labelled documents, in order of a hash of doc_id.

    Grades: 0 if any label is toxic, else 1 if quality is below 1, else 2. A fifth of the
    sample is held back; the least tail probability for keeping a document is set so that
    of its good documents ``false_rejection`` fall below. With fewer than two grades all
    documents are kept. Of rows that share a doc_id one counts, that with the least features.
    """
    graded = labels.filter("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.max("toxic").alias("x"), F.min("quality").alias("q"))
    graded = graded.select(F.col("doc_id").alias("labelled"), F.when(F.coalesce("x", F.lit(0)) > 0, 0).when(F.coalesce("q", F.lit(1)) < 1, 1).otherwise(2).alias("grade"))
    graded = graded.orderBy(F.xxhash64("labelled", F.lit(seed)), "labelled").limit(max_rows)
    chosen = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(graded), F.col("doc_id") == F.col("labelled")).select("doc_id", "text", "grade")  # at most max_rows
    schema = pa.schema([("doc_id", pa.int64()), ("grade", pa.int32()), ("features", pa.binary())])

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        features = Features()
        for batch in parts:
            for i, text, grade in zip(batch.column("doc_id").to_pylist(), text_bytes(batch), batch.column("grade").to_pylist(), strict=True):
                yield i, grade, features(text).astype(np.int32).tobytes()

    got = chosen.mapInArrow(lambda p: batches(rows(p), schema), "doc_id long, grade int, features binary").groupBy("doc_id").agg(F.min(F.struct("features", "grade")).alias("x")).select("doc_id", "x.*").collect()  # at most max_rows
    got.sort(key=lambda r: r["doc_id"])
    every = [np.frombuffer(r["features"], np.int32) for r in got]
    grades = np.array([r["grade"] for r in got], np.int64)
    if len(set(grades.tolist())) < 2:
        return Model(np.zeros(SIZE), np.full(GRADES - 1, -35.0), 0.0)
    held = np.arange(len(got)) % 5 == 0
    model = fit([x for x, h in zip(every, held, strict=True) if not h], grades[~held], seed=seed)
    scores = np.array([model.score(x) for x, h in zip(every, held, strict=True) if h])
    good = model.tails(scores)[grades[held] == GRADES - 1][:, -1] if held.any() else np.zeros(0)
    model.least = min(0.9, float(np.sort(good)[int(false_rejection * len(good))])) if len(good) else 0.0
    return model


def graded(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Grade all documents.

    Returns ``doc_id, score, expected_grade, p_at_least_1, p_at_least_2, kept``: kept
    documents are those whose probability of the best grade reaches the model's least.

    Null or empty text: graded by its style features alone. Very long texts are read
    whole. Null doc_id: graded, has no label. Labels of one document count as the worst
    of them; labels with neither value, or of no document, don't count. Repeated rows
    are each graded. Other columns are ignored. Empty tables: empty result, or all kept.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))  # its size is fixed
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("expected_grade", pa.float64()), ("p_at_least_1", pa.float64()), ("p_at_least_2", pa.float64()), ("kept", pa.bool_())])

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        features, m = Features(), model.value
        for batch in parts:
            for i, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch), strict=True):
                s = m.score(features(text))
                tails = m.tails(np.array([s]))[0].tolist()
                yield i, s, sum(tails), *tails, tails[-1] >= m.least

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return plain.mapInArrow(lambda p: batches(rows(p), schema), "doc_id long, score double, expected_grade double, p_at_least_1 double, p_at_least_2 double, kept boolean")


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, columns unchanged, and in the same partitions."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))
    where = docs.columns.index("text")

    def keep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, m = Features(), model.value
        for batch in parts:
            texts = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(where).to_pylist()]
            scores = np.array([m.score(features(t)) for t in texts])
            yield batch.filter(pa.array(m.tails(scores)[:, -1] >= m.least))

    return docs.mapInArrow(keep, docs.schema)
