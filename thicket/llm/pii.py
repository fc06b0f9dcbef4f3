"""Personal data by a skip-chain conditional random field over fixed patterns.

Fixed patterns find what they find, and that stays. Around them a random field
labels the tokens that could be personal data at all (those with a digit or an at
sign): each has a potential from its shape, neighbours share one, and so do tokens
anywhere in the document that repeat or resemble each other. Loopy belief propagation
spreads what is known of one mention to the others.

The weights are trained on the fixed patterns' labels of all documents, by the
pseudo-likelihood: each token's label given its shape and its neighbours' labels.
Tokens alike in all of that are counted together, so a pass over the texts leaves a
table of such cases, and each round of training sums derivatives over it in tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.shared import batches

KINDS = ("email", "ip", "card", "phone")
#: Shapes are told apart by so many hash values, which bounds the model.
SHAPES = 4096
ROUNDS, DAMPING = 12, 0.3
#: Rounds of training, how strongly weights are held to their first estimate, the length of a step, and tasks.
TRAINING, HOLD, STEP, TASKS = 12, 1.0, 0.7, 16
#: Cases that a task holds before it sends them on.
MANY = 200_000
#: Least probability of a kind for a span to be added.
LEAST = 0.9

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SOME = re.compile("[0-9@]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
OUTER = "\"'`.,;:!?()[]{}<>|*"
NOT_DIGIT = re.compile("[^0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses: from each at sign to the left as far as its characters go.

    The same spans as those of the pattern, in time proportional to the text.
    """
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns' spans, by kind and then start."""
    if not SOME.search(text):
        return []
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def shape(token: str) -> int:
    """Runs of digits and letters with their lengths, other characters as they are; hashed."""
    out = re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 20)}", re.sub(r"[^\W\d_]+", "a", token))
    return xxhash.xxh32_intdigest(out.encode("utf-8", "surrogatepass")) % SHAPES


def nodes(text: str, base: list[tuple[str, int, int]]) -> tuple[list[tuple[int, int, str]], np.ndarray]:
    """Candidate tokens (start, end, core text) and their labels under the patterns, 0 for none."""
    found, labels = [], []
    spans = sorted((a, b, KINDS.index(k) + 1) for k, a, b in base)
    j = 0
    last = max((b for _, b, _ in spans), default=0)
    for m in TOKEN.finditer(text):
        if not SOME.search(m[0]):
            continue
        core = m[0].strip(OUTER)
        if not core:
            continue
        start = m.start() + m[0].index(core)
        end = start + len(core)
        while j < len(spans) and spans[j][1] <= start:
            j += 1
        label = 0
        if start < last:
            at = j
            while at < len(spans) and spans[at][0] < end and not label:
                label = spans[at][2] if spans[at][1] > start else 0
                at += 1
        found.append((start, end, core))
        labels.append(label)
    return found, np.array(labels, np.int64)


def keys(core: str) -> list[str]:
    """What tokens must have in common to be joined by a skip edge: the same text, the same last
    seven digits of a number (with or without its prefix and marks), or the same name before an at sign."""
    low = core.lower()
    out = ["t" + low]
    digits = NOT_DIGIT.sub("", core)
    if len(digits) >= 7 and not re.search(r"[^\W\d_]", core):
        out.append("d" + digits[-7:])
    if "@" in low:
        out.append("m" + low.split("@")[0])
    return out


def edges(found: list[tuple[int, int, str]], text: str) -> tuple[np.ndarray, np.ndarray]:
    """(chain, skip) edges as index pairs. Each occurrence joins the one before with its key: a chain, not all pairs."""
    chain, skip, seen = [], [], {}
    for i, (start, _, core) in enumerate(found):
        if i and not text[found[i - 1][1] : start].strip(OUTER + " \t\n\v\f\r-"):
            chain.append((i - 1, i))
        for key in keys(core):
            if key in seen:
                skip.append((seen[key], i))
            seen[key] = i
    pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
    return pairs(chain), pairs(list(dict.fromkeys(skip)))


def cases(found: list[tuple[int, int, str]], labels: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """How many neighbours of each label each token has, along the chain and by skip edges."""
    out = []
    for pairs in edges(found, text):
        own = np.zeros((len(found), len(KINDS) + 1), np.uint8)
        np.add.at(own, (pairs[:, 0], labels[pairs[:, 1]]), 1)
        np.add.at(own, (pairs[:, 1], labels[pairs[:, 0]]), 1)
        out.append(own)
    return out[0], out[1]


def gather(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of a partition by case: ``shape, chain, skip, label, n``."""
    counts: Counter = Counter()
    for batch in rows:
        for text in batch.column(0).to_pylist():
            if not text or not SOME.search(text):
                continue
            found, labels = nodes(text, base_spans(text))
            if not found:
                continue
            chain, skip = cases(found, labels, text)
            counts.update((shape(c), chain[i].tobytes(), skip[i].tobytes(), y) for i, ((_, _, c), y) in enumerate(zip(found, labels.tolist(), strict=True)))
        if len(counts) > MANY:
            yield from case_rows(counts)
            counts.clear()
    yield from case_rows(counts)


def case_rows(counts: Counter) -> Iterator[pa.RecordBatch]:
    if counts:
        columns = zip(*counts, strict=True)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary(), pa.int32()), strict=True)), pa.array(counts.values(), pa.int64())], ["shape", "chain", "skip", "label", "n"])


def slopes(model: np.ndarray, shapes: np.ndarray, chain: np.ndarray, skip: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The log pseudo-likelihood's first derivatives and the size of its second ones, by weight, and itself."""
    n = len(KINDS) + 1
    unary, tables = model[: SHAPES * n].reshape(SHAPES, n), model[SHAPES * n :].reshape(2, n, n)
    score = unary[shapes] + chain @ tables[0] + skip @ tables[1]
    score = score - score.max(1, keepdims=True)
    p = np.exp(score)
    p /= p.sum(1, keepdims=True)
    seen = np.zeros_like(p)
    seen[np.arange(len(p)), labels] = 1
    off, spread = (seen - p) * counts[:, None], p * (1 - p) * counts[:, None]
    first, second = np.zeros((SHAPES, n)), np.zeros((SHAPES, n))
    np.add.at(first, shapes, off)
    np.add.at(second, shapes, spread)
    pairs = [(near.T @ off, (near**2).T @ spread) for near in (chain, skip)]
    # A table is the same read either way.
    g, h = ([x[i] + x[i].T for x in pairs] for i in (0, 1))
    value = float((counts * np.log(p[np.arange(len(p)), labels])).sum())
    return np.concatenate([first.ravel(), *(x.ravel() for x in g)]), np.concatenate([second.ravel(), *(x.ravel() for x in h)]), value


def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Columns ``shape, chain, skip, label, n`` for ``slopes``."""
    near = lambda i: np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, len(KINDS) + 1).astype(float)
    plain = lambda i: batch.column(i).to_numpy(zero_copy_only=False)
    return plain(0), near(1), near(2), plain(3), plain(4).astype(float)


def summed(table: DataFrame, model: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """``slopes`` over all cases: TASKS vectors of the model's size come to the driver."""
    sent = table.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * len(sent.value) + 1)
        for batch in parts:
            if batch.num_rows:
                first, second, value = slopes(sent.value, *arrays(batch))
                total += np.concatenate([first, second, [value]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sums"])

    got = np.zeros(2 * len(model) + 1)
    for r in table.mapInArrow(run, "sums binary").collect():
        got += np.frombuffer(r["sums"])
    sent.unpersist()
    return got[: len(model)], got[len(model) : -1], float(got[-1])


def first_estimate(table: DataFrame) -> np.ndarray:
    """Smoothed shares of each shape's labels, and tables that favour equal labels along skip edges."""
    n = len(KINDS) + 1
    unary = np.zeros((SHAPES, n))
    for r in table.groupBy("shape", "label").agg(F.sum("n").alias("n")).collect():  # a row a cell of the model
        unary[r["shape"], r["label"]] = r["n"]
    prior = unary.sum(0) + np.array([n, 1, 1, 1, 1])
    unary = (unary + 2 * prior / prior.sum()) / (unary.sum(1, keepdims=True) + 2)
    return np.concatenate([np.log(unary).ravel(), np.zeros(n * n), np.eye(n).ravel()])


def fit(docs: DataFrame) -> np.ndarray:
    """Log potentials, flat: unary (SHAPES x labels), chain and skip (labels x labels).

    Newton steps by weight, about the first estimate; one that lowers the objective is
    halved, and taken back at the end if it still does.
    """
    table = docs.select("text").mapInArrow(gather, "shape int, chain binary, skip binary, label int, n long").groupBy("shape", "chain", "skip", "label").agg(F.sum("n").alias("n"))
    table = table.coalesce(TASKS).checkpoint()
    start = first_estimate(table)
    best, step, best_value = start, STEP, -np.inf
    model, slope = start, None
    for _ in range(TRAINING):
        first, second, value = summed(table, model)
        value -= HOLD / 2 * float(((model - start) ** 2).sum())
        if value > best_value:
            if value - best_value < 1e-4 * abs(value):
                return model
            best, best_value, slope = model, value, (first - HOLD * (model - start)) / (second + HOLD)
        else:
            step /= 2
        model = best + step * slope
    return best


def infer(unary: np.ndarray, chain: np.ndarray, skip: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Marginals by loopy belief propagation, sum-product with damping."""
    links = np.concatenate([chain, skip])
    if not len(links):
        p = np.exp(unary - unary.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
    pot = np.exp(np.concatenate([np.repeat(tables[:1], len(chain), 0), np.repeat(tables[1:], len(skip), 0)]))
    pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
    src, dst = np.concatenate([links[:, 0], links[:, 1]]), np.concatenate([links[:, 1], links[:, 0]])
    back = np.roll(np.arange(len(src)), len(links))
    messages = np.zeros((len(src), unary.shape[1]))
    for _ in range(ROUNDS):
        belief = unary.copy()
        np.add.at(belief, dst, messages)
        out = belief[src] - messages[back]
        out = np.log(np.einsum("ei,eij->ej", np.exp(out - out.max(1, keepdims=True)), pot) + 1e-300)
        out -= out.max(1, keepdims=True)
        moved = np.abs(out - messages).max()
        messages = DAMPING * messages + (1 - DAMPING) * out
        if moved < 1e-4:
            break
    belief = unary.copy()
    np.add.at(belief, dst, messages)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def all_spans(text: str, model: np.ndarray) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, base and added spans), each by kind and then start."""
    base = base_spans(text)
    if not SOME.search(text):
        return base, base
    found, labels = nodes(text, base)
    if not len(found):
        return base, base
    n = len(KINDS) + 1
    unary = model[: SHAPES * n].reshape(SHAPES, n)[[shape(c) for _, _, c in found]].copy()
    known = labels > 0
    unary[known] = -50.0
    unary[known, labels[known]] = 0.0
    chain, skip = edges(found, text)
    p = infer(unary, chain, skip, model[SHAPES * n :].reshape(2, n, n))
    more = []
    for i in np.flatnonzero(~known & (p[:, 1:].max(1) >= LEAST)):
        more.append((KINDS[int(p[i, 1:].argmax())], found[i][0], found[i][1]))
    return base, sorted(base + more, key=lambda x: (KINDS.index(x[0]), x[1]))


def find(docs: DataFrame) -> DataFrame:
    """All personal data of each whole text.

    Returns ``doc_id, n_email, n_ip, n_card, n_phone`` and ``base_sha256`` for the fixed
    patterns' spans, and ``spans``, all spans as ``kind:start:end`` by kind and start in
    code points, joined by commas. Null or empty text: no spans. Very long texts are one
    field each. Null doc_id stays null. Repeated rows: each gives its own row. Other
    columns are ignored. An empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))  # its size is fixed
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])
    join = lambda x: ",".join(f"{k}:{a}:{b}" for k, a, b in x)

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        weights = model.value
        for batch in parts:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, full = all_spans(text or "", weights)
                counts = [sum(k == x[0] for x in base) for k in KINDS]
                yield doc_id, *counts, hashlib.sha256(join(base).encode()).hexdigest(), join(full)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda parts: batches(rows(parts), schema), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in square brackets; overlapping spans as one. Other columns, null texts, repeated rows and no rows are as they were."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))
    schema = docs.schema
    where = docs.columns.index("text")

    def clean(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts = []
            for text in batch.column(where).to_pylist():
                if text and SOME.search(text):
                    out, at = [], 0
                    for kind, a, b in sorted(all_spans(text, model.value)[1], key=lambda x: (x[1], -x[2])):
                        if a >= at:
                            out += [text[at:a], f"[{kind}]"]
                        at = max(at, b)
                    text = "".join([*out, text[at:]])
                texts.append(text)
            yield batch.set_column(where, "text", pa.array(texts, batch.schema.field(where).type))

    return docs.mapInArrow(clean, schema)


__all__ = ["KINDS", "all_spans", "base_spans", "find", "fit", "redacted"]
