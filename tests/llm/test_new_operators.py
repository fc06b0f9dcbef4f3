"""The n-gram join, the vocabulary audit and whitening: against brute force, on odd rows and on no rows."""

import collections
import math

import duckdb
import numpy as np
import pytest

from thicket.llm import ngram_join, vocabulary_audit, whitening

SQL = "doc_id long, text string, lang string, source string, term string, n long, tid long, id long, token long, component string, gid long, key string, rank int"


def rows_of(texts):
    return [(i, t, ("en", "de", None)[i % 3], ("b", "a", None, "")[i % 4], "x", 1, 2, 3, 4, "c", 5, "k", 6) for i, t in enumerate(texts)]


def clauses(rng, n, words):
    return [f"w{rng.integers(words)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies on both sides of the limit, chains of them, strangers with a passage in common."""
    rng = np.random.default_rng(8)
    passage = clauses(rng, 60, 4000)
    out = [None, "", " \t\n", "one", "ONE", "two words", "Two  WORDS\t", "a b c d", "a b c d e", "A b\nc d e f", "long " * 3000]
    for _ in range(6):
        base = clauses(rng, 120, 4000)
        out += [" ".join(base)] * 2
        for edits in (1, 2, 3, 4, 5, 5, 6):
            near = list(base)
            for at in rng.integers(0, len(near), edits):
                near[at] = f"x{rng.integers(10**6)}"
            out.append(" ".join(near).upper() if edits == 2 else " ".join(near))
        chain = base[:80]
        for _ in range(5):
            chain = chain[4:] + clauses(rng, 4, 4000)
            out.append(" ".join(chain))
        out.append(" ".join(clauses(rng, 15, 4000) + passage))
        out.append(" ".join(passage + clauses(rng, int(rng.integers(1, 30)), 4000)))
    return out


def linked(texts, width, percent):
    """(set size, least place reachable) of each text, by comparing all pairs."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                p, q = find(i), find(j)
                top[max(p, q)] = min(p, q)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("percent", "small"), [(80, False), (80, True), (60, True)])
def test_join_finds_every_link(spark, texts, monkeypatch, percent, small):
    if small:  # ranges in two steps, rows of few shingles, buckets in many blocks
        for name, value in (("LEAST_BITS", 5), ("MOST_BITS", 3), ("HELD", 500), ("BLOCK", 2), ("LARGE", 8)):
            monkeypatch.setattr(ngram_join, name, value)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.joined(spark.createDataFrame(rows_of(texts), SQL).repartition(4), 5, percent).collect()}
    assert got == dict(enumerate(linked(texts, 5, percent)))


def test_join_on_odd_rows(spark):
    text = " ".join(f"v{i}" for i in range(40))
    rows = [(None, text, *[None] * 11), (7, text + " end", *[None] * 11), (7, text, *[None] * 11), (3, "other words only", *[None] * 11), (None, None, *[None] * 11), (None, "alone here now ok yes", *[None] * 11)]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.joined(spark.createDataFrame(rows, SQL)).collect()), key=str)
    assert got == sorted([(None, 36, 7), (7, 37, 7), (7, 36, 7), (3, 1, 3), (None, 0, None), (None, 1, None)], key=str)
    assert ngram_join.joined(spark.createDataFrame([], SQL)).count() == 0


def test_dealt_shingles_come_back():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1)) for n in (1, 700, 40)]
    found = collections.defaultdict(list)
    for r, own, counts, hashes in ngram_join.dealt(np.concatenate(sets), np.array([5, 6, 7]), np.array([len(s) for s in sets]), 1, 6):
        for o, h in zip(np.repeat(np.frombuffer(own, np.int64), np.frombuffer(counts, np.uint8)), ngram_join.widened(hashes, 6), strict=True):
            found[int(o)].append((r, int(h)))
    for own, s in zip((5, 6, 7), sets, strict=True):
        assert found[own] == [(int(x) >> 63, int(x) & (1 << 48) - 1) for x in s]


AUDIT = [
    "Apple apple banana, cherry! déjà-vu 日本 word1word", "apple Banana cherry", "banana APPLE\x00apple\tdéjà", "cherry 日本 日本", None, "", "12 34 --", "apple " * 50, "É É é", "word word's WORD", "déjà vu vu", "banana cherry vu",
    "x" * 200 + " apple", "x" * 200 + " vu", "X" * 200,
]


def audited(spark, rows):
    got = [tuple(r) for r in vocabulary_audit.audit(spark.createDataFrame(rows, SQL).repartition(3)).collect()]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    if rows:
        con.executemany("insert into documents values (?, ?, ?, ?)", [r[:4] for r in rows])
    want = con.execute(vocabulary_audit.sql()).fetchall()
    return sorted(got), sorted(want)


@pytest.mark.parametrize("head", [0, 3, 1000])
def test_audit_is_that_of_its_sql(spark, monkeypatch, head):
    """With all terms in the head, few, and none."""
    monkeypatch.setattr(vocabulary_audit, "HEAD_TERMS", head)
    monkeypatch.setattr(vocabulary_audit, "RANGE_TERMS", 2)
    monkeypatch.setattr(vocabulary_audit, "MATRIX", 1 if head == 3 else 1 << 20)
    rows = rows_of(AUDIT * 3) + [(None, "apple vu", "fr", "only", *[None] * 9), (1, "apple banana", "en", "b", *[None] * 9), (1, "apple banana", "en", "b", *[None] * 9), (5, None, "en", "bare", *[None] * 9)]
    got, want = audited(spark, rows)
    assert got == want and {r[2] for r in got} == {"pair", "term"}


def test_audit_of_few_rows(spark):
    assert audited(spark, []) == ([], [])
    got, want = audited(spark, [(1, "a b", "en", "p", *[None] * 9), (2, "a", "en", "q", *[None] * 9)])
    assert got == want == [("en", "p", "pair", "q", 0, 1), ("en", "q", "pair", "p", 0, 1)]


def brute_whitened(rows, k=4):
    """Results by numpy from the whole matrix."""
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(v) for _, v in kept)
    x = np.array([v + [0] * (width - len(v)) for _, v in kept])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(k, int((e > 1e-9 * e[0]).sum()))
    return [i for i, _ in kept], n, ((n * x - s) ** 2).sum(1), (x - s / n) @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


@pytest.mark.parametrize(("dims", "n"), [(8, 200), (120, 60), (3, 40)])
def test_whitening(spark, dims, n):
    rng = np.random.default_rng(dims)
    rows = [(i, (rng.normal(size=dims) * np.linspace(3, 0.5, dims)).tolist()) for i in range(n)]
    rows += [(None, rows[0][1]), (3, rows[3][1]), (900, None), (901, [None] + rows[1][1][1:]), (902, [math.nan] * dims), (903, [math.inf] + rows[1][1][1:]), (904, rows[5][1][: dims - 1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, component string, n long").repartition(3)
    got = whitening.whitened(df).collect()
    ids, size, deviation, white, explained = brute_whitened([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows])
    assert len(got) == white.size and {r["n"] for r in got} == {size} and max(r["identity_error"] for r in got) < 1e-9
    sign = {}
    for r in sorted(got, key=lambda r: -abs(r["whitened"])):
        k, at = r["component"] - 1, [i for i, v in enumerate(ids) if v == r["vec_id"]]
        sign.setdefault(k, np.sign(r["whitened"] * white[at[0], k]))
        assert any(r["deviation"] == deviation[i] and abs(sign[k] * r["whitened"] - white[i, k]) < 1e-9 for i in at)
        assert abs(r["explained"] - explained[k]) < 1e-12


def test_whitening_of_little(spark):
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whitened(df([])).count() == 0
    assert whitening.whitened(df([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)])).count() == 0
    assert whitening.whitened(df([(1, []), (2, [])])).count() == 0
    line = whitening.whitened(df([(i, [float(i), 2.0 * i, 1.0]) for i in range(5)])).collect()
    assert {r["component"] for r in line} == {1} and abs(line[0]["explained"] - 1) < 1e-12


def test_exact_beyond_a_long():
    x = np.array([[3, -1], [-(2**40), 2**40]])
    n, sums = 10**9, [5, -(2**60)]
    assert whitening.deviations(x, n, sums) == [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    assert (whitening.unpack([whitening.pack(r) for r in x], 2) == x).all() and whitening.pack(np.array([1, 0])) == whitening.pack(np.array([1]))
