"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows, clashing names and no rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from thicket.llm import components, fingerprint_index, hmm, mixing, ordinal, packing, pii, preference, prefix_hash, quality_rules, setsketch
from thicket.llm.queries import tokenizer_path

SQL = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, n long, label string, task string, part string, id string, chunk string, h string, component string, queue string, s string"
COPY = " ".join(f"word{i}" for i in range(60))
NEAR = COPY.replace("word30", "other")
TEXTS = [
    "The cat sat. The cat sat. The cat ran\nhome\nhome\n\n", None, "", " \t\n", COPY, COPY, NEAR, "two words", "TWO words", "long " * 3000 + COPY, "mail a.b@c.org or +1 (269) 555-3296 now 4111 1111 1111 1111, ip 10.0.0.255", "again a.b@c.org and 2695553296", "häßlich ÉTÉ 日本語 \U0001f600 " * 7,
]


def clash(rows):
    """Rows of documents with columns whose names the operators use themselves."""
    return [(i, t, lang, src, None if t is None else len(t), 7, "k", 9, "l", "t", "p", "i", "c", "h", "c", "q", "s") for i, t, lang, src in rows]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], ("b", "a", None)[i % 3]) for i, t in enumerate(TEXTS)] + [(None, "no id " + COPY, "en", "b"), (4, COPY, "en", "b")]
    return spark.createDataFrame(clash(rows), SQL).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SQL)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (4, 1, 0), (4, 1, 0), (7, 0, 0), (9, None, 1), (None, 1, 0), (99, 1, 0), (12, None, None)], "doc_id long, quality int, toxic int")


def table(df, key="doc_id"):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r)
    return out


def test_hidden_markov_model(spark, docs, none):
    got = table(hmm.scores(docs, states=3, symbols=64, rounds=2))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sum(map(len, got.values())) == len(rows)
    counts, tokens = collections.Counter(), []
    for i, t in rows:
        w = (t or "").encode().lower().split() + [None]
        tokens.append((i, w))
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            counts.update(w)
    total, kinds = sum(counts.values()), len(counts)
    for i, w in tokens:
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w)
        assert any(abs(r["base_score"] - base) < 1e-6 and r["n_tokens"] == len(w) and r["n_known"] == sum(counts[x] > 0 for x in w) and r["train_tokens"] == total and math.isfinite(r["score"]) for r in got[i])
    assert hmm.scores(none).count() == 0


def test_scores_are_those_of_the_model(spark, docs, monkeypatch):
    """The query's scores against the plain forward recursion with the model it trained, in exact order and doubles."""
    kept = []
    real = hmm.baum_welch

    def spy(*args):
        kept.append((real(*args), args[1]))
        return kept[-1][0]

    monkeypatch.setattr(hmm, "baum_welch", spy)
    monkeypatch.setattr(hmm, "CHUNK_TOKENS", 200)
    monkeypatch.setattr(hmm, "GROUP_CHUNKS", 2)
    got = table(hmm.scores(docs, states=3, symbols=64, rounds=2))
    model, counts = kept[0]
    rows = [(r["doc_id"], [xxhash.xxh3_64_intdigest(w, 11) for w in (r["text"] or "").encode().lower().split()] + [0]) for r in docs.collect()]
    seen = collections.Counter(w for i, ws in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for w in ws)
    symbol = lambda w: 0 if w == 0 else w % 63 + 1
    tokens, kinds = collections.Counter(), collections.Counter()
    for w, n in seen.items():
        tokens[symbol(w)] += n
        kinds[symbol(w)] += 1
    assert [tokens[s] for s in range(64)] == counts.tolist()
    for i, ws in rows:
        alpha, total = None, 0.0
        for w in ws:
            s = symbol(w)
            alpha = (model.first.astype(float) if alpha is None else alpha @ model.step.astype(float)) * model.emit[s].astype(float)
            total += math.log10(alpha.sum()) + math.log10((seen[w] + 0.5) / (tokens[s] + 0.5 * (kinds[s] + 1)))
            alpha = alpha / alpha.sum()
        assert any(abs(r["score"] - total) < 1e-4 * max(1, len(ws)) ** 0.5 for r in got[i])


def whole_counts(model, seqs):
    """Baum-Welch counts by the uncut recursions, in doubles."""
    first, step, emit = np.zeros(len(model.first)), np.zeros_like(model.step, float), np.zeros_like(model.emit, float)
    pi, a, e = (x.astype(float) for x in (model.first, model.step, model.emit))
    total = 0.0
    for s in seqs:
        alphas, scales = [], []
        for t, x in enumerate(s):
            v = (pi if t == 0 else alphas[-1] @ a) * e[x]
            scales.append(v.sum())
            alphas.append(v / v.sum())
        beta = np.ones(len(pi))
        for t in range(len(s) - 1, -1, -1):
            g = alphas[t] * beta
            emit[s[t]] += g
            if t:
                move = beta * e[s[t]] / scales[t]
                step += np.outer(alphas[t - 1], move) * a
                beta = a @ move
            else:
                first += g
        total += np.log(scales).sum()
    return first, step, emit, total


@pytest.mark.parametrize("run, warm", [(4, 1), (8, 2), (64, 48), (512, 48)])
def test_expected_counts_are_of_whole_sequences(monkeypatch, run, warm):
    monkeypatch.setattr(hmm, "RUN", run)
    monkeypatch.setattr(hmm, "WARM", warm)
    rng = np.random.default_rng(2)
    for sticky in (0.0, 0.999):  # states that remember little, and some that remember nearly all
        m = hmm.Model.start(rng.integers(1, 9, 7).astype(float), 3, 4)
        m.step = (np.full((3, 3), (1 - sticky) / 3) + sticky * np.eye(3)).astype(np.float32)
        seqs = [rng.integers(0, 7, n) for n in (1, 4, 300, 2, 17, 64, 65, 8, 9)]
        got = hmm.expected(m, np.concatenate(seqs), np.array([len(s) for s in seqs]))
        for x, y in zip(got, whole_counts(m, seqs), strict=True):
            assert np.allclose(x, y, rtol=2e-3, atol=2e-2)


def test_asked_rows_grow_with_the_words():
    """Twice the groups are twice the rows, or fewer, at every size; and a range holds what fits a task while rows can be that many."""
    words = 1_500_000
    for groups in (1, 8, 64, 512, 4096, 1 << 18):
        rows, double = (n << hmm.range_bits(n * words, n) for n in (groups, 2 * groups))
        assert rows * hmm.ROW_WORDS <= max(groups * words, 16 * groups * hmm.ROW_WORDS)
        assert double * hmm.ROW_WORDS <= 2 * groups * words
    assert 2**12 * words * 16 / 2 ** hmm.range_bits(2**12 * words, 2**12) <= 2 * hmm.RANGE_BYTES


def test_forward_recursion_is_exact():
    rng = np.random.default_rng(1)
    m = hmm.Model.start(rng.integers(1, 9, 5).astype(float), 3, 4)
    first, step, emit = (x.astype(float) for x in (m.first, m.step, m.emit))
    seqs = [rng.integers(0, 5, n) for n in (1, 4, 2, 6)]
    got = hmm.forward(m, np.concatenate(seqs), np.array([len(s) for s in seqs]))
    for s, g in zip(seqs, got, strict=True):
        p = 0.0
        for path in np.ndindex(*[3] * len(s)):
            q = first[path[0]] * emit[s[0], path[0]]
            for t in range(1, len(s)):
                q *= step[path[t - 1], path[t]] * emit[s[t], path[t]]
            p += q
        assert abs(g - math.log(p)) < 1e-4
    before = got.sum()
    f, a, e, total = hmm.expected(m, np.concatenate(seqs), np.array([len(s) for s in seqs]))
    assert abs(total - before) < 1e-3
    assert abs(e.sum() - 13) < 1e-3 and abs(f.sum() - 4) < 1e-3 and abs(a.sum() - 9) < 1e-3
    better = hmm.Model(f / f.sum(), a / a.sum(1, keepdims=True), e / e.sum(0))
    assert hmm.forward(better, np.concatenate(seqs), np.array([len(s) for s in seqs])).sum() > before


def fresh_ids(text):
    """Ids by the tokenizer as its file has it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids


def test_packing(spark, docs, none):
    path = tokenizer_path("word_bpe_49k.json")
    marked = spark.createDataFrame(clash([(50, "a text <|endoftext|> and more", "en", "a"), (51, "x<|startoftext|>y <|ENDOFTEXT|>", "en", None)]), SQL)
    docs = docs.unionByName(marked)
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(np.array(fresh_ids(r["text"] or "") + [2], "<u4").tobytes())
    assert len(texts[50][0]) == 4 * 6
    for weights in (None, (5, 2, 1), {"a": 3.0, None: 0.5}):
        pieces = packing.pack(docs, path, weights=weights, size=64, with_ids=True).collect()
        windows = collections.defaultdict(list)
        for p in pieces:
            windows[p["sequence_id"]].append(p)
            assert zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"]
        for own in windows.values():
            at = 0
            for p in sorted(own, key=lambda p: p["offset"]):
                assert p["offset"] == at
                at += p["length"]
            assert at == 64 or at & (at - 1) == 0
        assert sorted(windows) == list(range(len(windows)))
        # The pieces of each document, joined, are its ids; documents that share an id are told apart by their length.
        joined = collections.defaultdict(list)
        for p in pieces:
            joined[p["doc_id"], p["doc_tokens"]].append((p["start"], p["ids"]))
        got = collections.defaultdict(list)
        for (i, n), own in joined.items():
            assert sorted(own)[0][0] == 0
            got[i].append(b"".join(x for _, x in sorted(own)))
            assert len(got[i][-1]) % (4 * n) == 0
        assert {i: sorted(map(len, x)) for i, x in got.items() if i != 4} == {i: sorted(map(len, x)) for i, x in texts.items() if i != 4}
        assert all(sorted(x) == sorted(texts[i]) for i, x in got.items() if i != 4)
        assert sum(len(x) for x in got[4]) == sum(len(x) for x in texts[4])
    with pytest.raises(ValueError):
        packing.pack(docs, path, weights=(0,))
    assert packing.pack(none, path).count() == 0 and packing.pack(none, path, weights=(5, 2, 1)).count() == 0


@pytest.mark.parametrize("text", ["a\x1cb", "it's we'll", "x,y", "Σας İ", "<|endoftext|>", "a<|startoftext|>b <|endoftext|>, c", "<|ENDOFTEXT|> <| endoftext |>", "é ́z", "　a b\x85c", "ab. cd! EF? 12", "de%%% éon,*** x'***", "a' don't!! y'all's", "a_b word_ __w", "“quoted” say-so- (in) [x]", "ab.c d.. <b> </b>"])
def test_short_way_to_ids(text):
    memo = packing.memo_of(tokenizer_path("word_bpe_49k.json"), "<u2")
    assert memo.short and memo.ids(text) == np.array(fresh_ids(text), "<u2").tobytes()


def rounds_one_by_one(lengths, speeds, size):
    """The plain deficit round-robin, in exact fractions: a row of tokens given before each window."""
    from fractions import Fraction

    deficit, given, out = [Fraction(0)] * len(lengths), [0] * len(lengths), []
    for k in range(sum(lengths)):
        if k % size == 0:
            out.append(list(given))
        live = [s for s, n in enumerate(lengths) if given[s] < n]
        wait, s = min(((Fraction(1, 2) - deficit[s]) / Fraction(speeds[s]), s) for s in live)
        for t in live:
            deficit[t] += Fraction(speeds[t]) * wait
        deficit[s] -= 1
        given[s] += 1
    return [*out, list(given)]


@pytest.mark.parametrize("lengths, speeds", [([1000, 5000, 3, 250], None), ([700, 90, 400], [5.0, 2.0, 1.0]), ([64, 64, 64, 64], [1.0, 1.0, 1.0, 1.0]), ([1], [0.25]), ([300] * 40, [1.0 + s % 3 for s in range(40)]), ([5, 900], [100.0, 0.125])])
def test_rounds_equal_those_run_one_by_one(lengths, speeds):
    speeds = speeds or lengths
    r = packing.Rounds(lengths, speeds, 16)
    want = np.array(rounds_one_by_one(lengths, speeds, 16))
    assert (r.states(np.arange(r.windows + 1)) == want).all()
    dealt = np.zeros((r.windows, len(lengths)), int)
    for q, n in enumerate(lengths):
        at = 0
        while at < n:  # documents of 7 tokens
            for token, count, window, _ in r.place(q, at, min(7, n - at)):
                assert token >= at
                dealt[window, q] += count
            at += 7
    assert (dealt == np.diff(want, axis=0)).all()


def test_windows_hold_the_proportions():
    r = packing.Rounds([10**6, 4 * 10**5, 2 * 10**5], [5.0, 2.0, 1.0], 4096)
    served = np.diff(r.states(np.arange(r.windows + 1)), axis=0)[:-1]
    assert abs(served - 4096 * np.array([5, 2, 1]) / 8).max() <= 1


def test_quality_rules(spark, docs, labels, none):
    got = table(quality_rules.judge(docs, labels))
    for r in docs.collect():
        words = (r["text"] or "").encode().split()
        lines = [x for x in (r["text"] or "").split("\n") if x.strip(" \t\n\v\f\r")]
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        c = collections.Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if c[g] > 1 for k in range(3)}
        want = (len(words), sum(len(w.decode()) for w in words), sum((r["text"] or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert any(tuple(g[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want for g in got[r["doc_id"]])
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        assert all(g["kept"] is not failed and g["base_failed"] is failed for g in got[r["doc_id"]] if g["n_words"] == len(words))
    assert quality_rules.judge(docs, labels.limit(0)).count() == docs.count()
    assert quality_rules.judge(none, labels).count() == 0


def test_binomial_tail(spark):
    rows = [(k, n) for n in (1, 10, 400, 3000) for k in (0, 1, 3, 20) if k <= n]
    got = spark.createDataFrame(rows, "k long, n long").select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.02).alias("p")).collect()
    for r in got:
        want = sum(math.comb(r["n"], i) * 0.02**i * 0.98 ** (r["n"] - i) for i in range(r["k"] + 1)) if r["k"] < r["n"] * 0.02 else 1
        assert abs(r["p"] - want) < 1e-9


def test_steps_hold_their_limit(spark):
    def taken(n, rejected, strata=1):
        rows = [(f"s{s}", (3 if i < rejected else None)) for s in range(strata) for i in range(n)]
        return {r["taken"] for r in quality_rules.furthest(spark.createDataFrame(rows, "stratum string, step int"), 5, 0.02, 0.05).collect()}

    # 0.98 ** 149 is below 0.05 first; with 4 strata 0.98 ** 217 is below 0.0125 first.
    assert taken(148, 0) == {0} and taken(149, 0) == {5} and taken(216, 0, 4) == {0} and taken(217, 0, 4) == {5}
    term = lambda i: math.exp(math.lgamma(4001) - math.lgamma(i + 1) - math.lgamma(4001 - i) + i * math.log(0.02) + (4000 - i) * math.log(0.98))
    most = max(k for k in range(80) if sum(map(term, range(k + 1))) <= 0.05)
    assert taken(4000, most) == {5} and taken(4000, most + 1) == {2}


def test_false_rejections_stay_below_the_limit(spark):
    """Samples whose good documents are rejected at just above the limit: few of them pass that step."""
    rng = np.random.default_rng(8)
    rows = [(str(s), 1 if x else None) for s in range(300) for x in rng.random(600) < 0.021]
    got = quality_rules.furthest(spark.createDataFrame(rows, "stratum string, step int"), 1, 0.02, 0.05 * 300)
    assert got.filter("taken > 0").count() <= 25  # 300 strata at 0.05 each: 15 expected at most


def test_rules_reject_what_good_documents_never_have(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good, "en") for i in range(300)] + [(1000 + i, good + " #" * 30, "en") for i in range(40)] + [(2000 + i, good, "de") for i in range(100)] + [(3000, good + " #" * 30, "de"), (3001, good + " #" * 30, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lab = docs.filter("doc_id < 3000").select("doc_id", (F.col("doc_id") % 2000 < 1000).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs, lab).collect()}
    # 300 good labels prove a cutoff in "en"; 100 don't in "de", and the null stratum has none.
    assert all(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(40)) and got[3000] and got[3001]
    assert quality_rules.path(docs.limit(0).select("doc_id", *[F.lit(0.0).alias(r) for r in quality_rules.GRIDS]))[:4] == [(r, g[-1]) for r, g in quality_rules.GRIDS.items()]


def test_ordinal_regression(spark, docs, labels, none):
    rows = [(i, f"fine {'dreadful' if i % 3 == 0 else 'dull' if i % 3 == 1 else 'lovely'} text {i}") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = d.select("doc_id", (F.col("doc_id") % 3 == 2).cast("int").alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    got = {r["doc_id"]: r for r in ordinal.graded(d, lab).collect()}
    assert sum(got[i]["kept"] is (i % 3 == 2) for i in got) > 290
    mean = [np.mean([got[i]["expected_grade"] for i in got if i % 3 == k]) for k in range(3)]
    assert mean[0] < mean[1] < mean[2]
    assert all(r["p_at_least_1"] >= r["p_at_least_2"] for r in got.values())
    assert ordinal.graded(docs, labels).count() == docs.count()
    assert ordinal.graded(docs, labels.limit(0)).filter("kept").count() == docs.count()
    assert ordinal.graded(none, labels).count() == 0 and ordinal.accepted(none, labels).count() == 0


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def patterns(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def test_personal_data(spark, docs, none):
    rng = np.random.default_rng(5)
    bits = ["a", "@", ".", "1", "23", "4", "+", " ", "-", "(", "b.c", "@x.y", "255", "0", "é", "4111111111111111"]
    for _ in range(3000):
        text = "".join(rng.choice(bits, rng.integers(0, 25)))
        assert pii.base_spans(text) == patterns(text)
    got = table(pii.find(docs))
    for r in docs.collect():
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in patterns(r["text"] or ""))
        sha = hashlib.sha256(base.encode()).hexdigest()
        assert any(g["base_sha256"] == sha and set(filter(None, base.split(","))) <= set(g["spans"].split(",")) for g in got[r["doc_id"]])
    assert pii.find(none).count() == 0
    assert pii.redacted(docs).filter("doc_id = 10").first()["text"] == "mail [email] or [phone] now [card], ip [ip]"


def test_skip_edges_carry_labels():
    n = len(pii.KINDS) + 1
    unary = np.log(np.full((3, n), 1 / n))
    unary[0] = -50
    unary[0, 4] = 0
    tables = np.stack([np.zeros((n, n)), np.log(np.full((n, n), 0.05) + np.eye(n) * 5)])
    p = pii.infer(unary, np.zeros((0, 2), int), np.array([[0, 1]]), tables)
    assert p[1].argmax() == 4 and p[1, 4] > 0.9 and np.allclose(p[2], 1 / n)


def marginals(unary, links):
    """By enumeration: ``links`` are (a, b, table)."""
    k, total = unary.shape[1], np.zeros_like(unary)
    for y in np.ndindex(*[k] * len(unary)):
        w = math.exp(sum(unary[i, y[i]] for i in range(len(y))) + sum(t[y[a], y[b]] for a, b, t in links))
        for i, v in enumerate(y):
            total[i, v] += w
    return total / total.sum(1, keepdims=True)


def test_messages_give_the_marginals():
    rng = np.random.default_rng(9)
    tables = rng.normal(size=(2, 3, 3))
    tables = (tables + tables.transpose(0, 2, 1)) / 2
    loops = ([(0, 1), (1, 2)], [(0, 2), (2, 3), (3, 4), (2, 4)])
    # Exact on a tree; on loops an approximation, the better the weaker the tables are.
    for (chain, skip), strength, tolerance in ((([(0, 1), (1, 2), (2, 3)], [(1, 4)]), 1.0, 1e-3), (loops, 0.3, 0.02), (loops, 0.03, 1e-3)):
        unary, tables = rng.normal(size=(5, 3)), tables * strength
        got = pii.infer(unary, np.array(chain), np.array(skip), tables)
        assert abs(got - marginals(unary, [(a, b, tables[0]) for a, b in chain] + [(a, b, tables[1]) for a, b in skip])).max() < tolerance


def test_field_slopes_are_the_differences():
    rng = np.random.default_rng(10)
    n, m = len(pii.KINDS) + 1, 40
    shapes, labels, counts = rng.integers(0, 3, m), rng.integers(0, n, m), rng.integers(1, 5, m).astype(float)
    chain, skip = rng.integers(0, 2, (m, n)).astype(float), rng.integers(0, 3, (m, n)).astype(float)
    model = np.zeros(pii.SHAPES * n + 2 * n * n)
    model[: 3 * n] = rng.normal(size=3 * n)
    for k in range(2):
        a = rng.normal(size=(n, n))
        model[pii.SHAPES * n + k * n * n :][: n * n] = (a + a.T).ravel()
    value = lambda x: pii.slopes(x, shapes, chain, skip, labels, counts)[2]
    first, _, at = pii.slopes(model, shapes, chain, skip, labels, counts)
    direct = 0.0
    for i in range(m):
        score = [model[shapes[i] * n + y] + sum(near[i, b] * model[pii.SHAPES * n + k * n * n + y * n + b] for k, near in enumerate((chain, skip)) for b in range(n)) for y in range(n)]
        direct += counts[i] * (score[labels[i]] - math.log(sum(map(math.exp, score))))
    assert abs(at - direct) < 1e-9
    for cell in (0, 7, (1, 2, 0), (0, 3, 4), (1, 1, 1)):
        step = np.zeros_like(model)
        if isinstance(cell, int):
            at_ = cell
            step[cell] = 1e-5
        else:  # both readings of a table move together
            k, a, b = cell
            at_ = pii.SHAPES * n + k * n * n + a * n + b
            step[at_] = step[pii.SHAPES * n + k * n * n + b * n + a] = 1e-5
        slope = (value(model + step) - value(model - step)) / 2e-5
        assert abs(slope - (first[at_] if not isinstance(cell, tuple) or cell[1] != cell[2] else first[at_] / 2)) < 1e-4


def test_labels_spread_to_mentions_without_a_pattern(spark):
    """A number that a pattern knows once is found again without its plus sign; numbers like it in other texts are left alone."""
    rows = [(i, f"call +4420{i % 90 + 10}550{i % 9}{i % 7}1 or 4420{i % 90 + 10}550{i % 9}{i % 7}1 again +4420{i % 90 + 10}550{i % 9}{i % 7}1") for i in range(200)]
    rows += [(1000 + i, f"mail me{i}@site{i % 7}.org, me{i}@site{i % 7}.org") for i in range(100)] + [(2000 + i, f"order 77{i:09d} of 12 items") for i in range(200)]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert all(r["n_phone"] == 2 for i, r in got.items() if i < 200)
    assert all(r["spans"] == "" for i, r in got.items() if i >= 2000)
    models = [pii.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)) for n in (1, 4)]
    assert np.allclose(models[0], models[1])


def test_enclosed_tokens_have_their_spans_label():
    text = "x +1(269)555-3296@mail.example.org y"
    base = pii.base_spans(text)
    found, labels = pii.nodes(text, base)
    assert len(base) >= 1 and labels.min() > 0


def test_preference(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, None, None), (None, 0, "user", "lost"), (None, 0, "user", "lost"), (4, None, "user", "x"), (4, 1, "assistant", "")]
    turns += [(8, k, "user" if k % 2 == 0 else "assistant", f"a{k}") for k in range(5)] + [(9, k, "user" if k % 2 == 0 else "assistant", f"b{k}") for k in range(6)]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn int, role string, text string, n int")
    rows = preference.formatted(preference.swapped_pairs(df)).collect()
    got = {r["pair_id"]: r for r in rows}
    assert sorted((r["pair_id"] for r in rows), key=str) == [0, 1, 2, 4, 8, 9, None, None]
    r = got[0]
    assert r["prompt"] == "<|user|>\nhi<|end|>\n" and r["chosen"] == "<|assistant|>\nyes<|end|>\n" and r["rejected"] == "<|assistant|>\nno<|end|>\n"
    a, b = map(int, r["chosen_mask"].split(":"))
    assert r["chosen"][a:b] == "yes<|end|>\n"
    assert got[2]["prompt_turns"] == 0 and got[2]["rejected"] == "" and got[4]["prompt_turns"] == 1 and got[None]["chosen"] == "<|user|>\nlost<|end|>\n"
    # 8 keeps 1 + 4 mod 4 turns of five, 9 keeps 1 + 4 mod 5 of six; several turns follow, and the masks are the assistant's.
    assert got[8]["prompt_turns"] == 1 and got[9]["prompt_turns"] == 5
    for side, who, n in (("chosen", "a", 5), ("rejected", "b", 6)):
        spans = [got[8][side][int(x):int(y)] for x, y in (m.split(":") for m in got[8][f"{side}_mask"].split(","))]
        assert spans == [f"{who}{k}<|end|>\n" for k in range(1, n, 2)] and got[8][side].count("<|end|>") == n - 1
    assert preference.formatted(preference.swapped_pairs(df.limit(0))).count() == 0
    import duckdb

    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    assert sorted(map(str, con.sql(preference.SQL).fetchall())) == sorted(str(tuple(r)) for r in rows)


def removed(rows):
    seen, out = set(), []
    for i, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for k in range(len(words) - 19):
            w = tuple(words[k : k + 20])
            if w in seen:
                gone.update(range(k, k + 20))
            seen.add(w)
        out.append((i, len(words), len(gone), b" ".join(x for k, x in enumerate(words) if k not in gone).decode()))
    return out


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_fingerprint_index(spark, docs, none, monkeypatch):
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert rows_of(fingerprint_index.deduplicated(docs)) == sorted(str(x) for x in removed(rows))
    assert fingerprint_index.deduplicated(none).count() == 0
    monkeypatch.setattr(fingerprint_index, "FANOUT", 2)
    index = fingerprint_index.FingerprintIndex(spark)
    out = []
    for k in range(3):
        out += rows_of(index.add(docs.filter(f"doc_id between {5 * k} and {5 * k + 4}")))
    assert sorted(x[0] for x in index.runs) == [0, 1]
    assert sorted(out) == sorted(str(x) for x in removed([r for r in rows if r[0] is not None]))


def test_index_of_batches_holds_every_window(spark, monkeypatch):
    """Passages that many documents share, an id far from all others, rows that share ids, null ids: by batches that are compacted, whatever the layout."""
    monkeypatch.setattr("thicket.llm.ordered.STRETCH_BYTES", 500)
    monkeypatch.setattr("thicket.llm.ordered.STRETCHES", 64)
    monkeypatch.setattr(fingerprint_index, "CHUNK_BYTES", 1000)
    monkeypatch.setattr(fingerprint_index, "ROW_HASHES", 1)
    rng = np.random.default_rng(7)
    passages = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(6)]
    rows = []
    for i in range(120):
        bits = [" ".join(f"d{i}x{j}" for j in range(int(rng.integers(0, 30))))]
        bits += [passages[int(k)] for k in rng.integers(0, 6, int(rng.integers(0, 3)))]
        rows.append((i if i < 118 else 1 << 61, " ".join(bits)))
    rows += [(1 << 61, passages[0]), (None, passages[1] + " tail"), (None, None), (None, passages[1] + " tail")]
    # Rows that share an id are in the input's order, so those rows stay in one partition.
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = sorted(str(x) for x in removed(rows))
    got, index = fingerprint_index.indexed(d, 20, (0.0625, 0.125, 0.1875, 0.25))
    assert rows_of(got) == want
    assert sorted(x[0] for x in index.runs) == [0, 1]  # four runs of level 0 were compacted
    windows = {tuple(w[k : k + 20]) for _, t in rows for w in [(t or "").split()] for k in range(len(w) - 19)}
    held = sum(len(fingerprint_index.decode(r["data"], index.check)[0]) for _, run, _ in index.runs for r in run.collect())
    assert held == len(windows)
    single = spark.createDataFrame([r for r in rows if r[0] is not None and r[0] < 118], "doc_id long, text string")
    assert rows_of(fingerprint_index.deduplicated(single.repartition(5))) == sorted(str(x) for x in removed(rows[:118]))


def test_rows_of_hashes_grow_with_the_text(monkeypatch):
    """A block's rows hold ROW_HASHES hashes on average at least, however many ranges there are."""
    monkeypatch.setattr(fingerprint_index, "BLOCK_WORDS", 1000)
    for bits in (4, 8, 10):
        import pyarrow as pa

        texts = [" ".join(f"{i}-{j}" for j in range(500)) for i in range(400)]
        batch = pa.RecordBatch.from_pydict({"id": list(range(400)), "text": [t.encode() for t in texts]})
        n = sum(1 for _ in fingerprint_index.blocks_of(20, bits, 1, np.array([0]), fingerprint_index.WordHash(3))(iter([batch])))
        assert n <= 400 * 500 / 60 + (1 << bits)


def test_hash_codec():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000):
        for check in (1, 3, 8):
            h = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            c = rng.integers(0, 1 << 63, len(h)).astype(np.uint64) % np.uint64(min(1 << 8 * check, (1 << 64) - 1))
            a, b = fingerprint_index.decode(fingerprint_index.encode(h, c, check), check)
            assert (a == h).all() and (b == c).all()
    assert [fingerprint_index.check_bytes(n) for n in (0, 10**9, 6 * 10**10, 10**14)] == [1, 1, 3, 6]


def test_equal_hashes_are_verified():
    """A hash that stands in a run with another check value is no repeat."""
    import pyarrow as pa

    h = np.array([5, 9], np.uint64)
    run = (0, None, None, None, None, fingerprint_index.encode(h, np.array([1, 2], np.uint64), 1))
    own = (0, 0, 0, 0, 1, fingerprint_index.encode(h, np.array([1, 3], np.uint64), 1))
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(run, own, strict=True)], names=list("abcdef"))
    bits, new = fingerprint_index.merge_join(iter([batch]), 1)
    assert np.unpackbits(np.frombuffer(bits[-1], np.uint8), count=2).tolist() == [1, 0]
    assert fingerprint_index.decode(new[-1], 1)[0].tolist() == [9]


def test_prefix_hashes(spark, docs, none):
    rng = np.random.default_rng(0)
    for _ in range(100):
        a, b = ("".join(rng.choice(list("abé"), rng.integers(0, 50))) for _ in range(2))
        p, q = prefix_hash.Prefixes(prefix_hash.code_points(a)), prefix_hash.Prefixes(prefix_hash.code_points(b))
        i, j = int(rng.integers(0, len(a) + 1)), int(rng.integers(0, len(b) + 1))
        e = 0
        while i + e < len(a) and j + e < len(b) and a[i + e] == b[j + e]:
            e += 1
        assert p.extension(i, q, j) == e
    one = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted((r["doc_id"], r["text"] or "") for r in one.collect())
    got = table(prefix_hash.fingerprints(one.repartition(4)))
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        (r,) = got[i]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(t)
        assert 0 <= r["near_edited"] <= 1 and (edited != t or r["near_edited"] == 1) and prefix_hash.likeness(r["fingerprint"], r["edited_fingerprint"]) == r["near_edited"]
    assert got[4][0]["fingerprint"] == got[5][0]["fingerprint"] and got[4][0]["near_next"] == 1
    assert prefix_hash.fingerprints(docs).count() == docs.count()
    assert prefix_hash.fingerprints(none).count() == 0


def test_ordinal_slopes_are_the_differences():
    rng = np.random.default_rng(6)
    rows = [rng.choice(12, int(rng.integers(1, 6)), replace=False) for _ in range(30)]
    y, w, free = rng.integers(0, 3, 30), rng.normal(size=12), np.array([-0.4, 0.3])
    loss, grad, by = ordinal.slopes(w, free, rows, y)
    t, scores = ordinal.thresholds_of(free), np.array([w[r].sum() for r in rows])
    at_least = np.stack([np.ones(30), 1 / (1 + np.exp(t[0] - scores)), 1 / (1 + np.exp(t[1] - scores)), np.zeros(30)], 1)
    assert abs(loss + np.mean([math.log(at_least[i, g] - at_least[i, g + 1]) for i, g in enumerate(y)])) < 1e-9
    assert np.allclose(ordinal.Model(w, t).tails(scores), at_least[:, 1:3])
    for x, slope in ((w, grad), (free, by)):
        for i in range(len(x)):
            up, down = x.copy(), x.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            a, b = (ordinal.slopes(v, free, rows, y)[0] if x is w else ordinal.slopes(w, v, rows, y)[0] for v in (up, down))
            assert abs((a - b) / 2e-5 - slope[i]) < 1e-6


def test_ordinal_model_is_the_same_however_rows_lie(spark):
    rows = [(i // 2, f"{'good' if i % 4 < 2 else 'bad'} words {i} of {i % 7}") for i in range(400)]  # two texts an id
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = d.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic")).distinct()
    models = [ordinal.train(x, lab) for x in (d, d.orderBy(F.desc("text")).repartition(3))]
    assert (models[0].weights == models[1].weights).all() and models[0].least == models[1].least


def poured(sizes, weights, repeat):
    """Targets by pouring: all is shared by weight, what is above a source's limit is shared again, until none is."""
    total, free, out = float(sum(sizes)), set(range(len(sizes))), {}
    while free:
        share = {i: total * weights[i] / sum(weights[j] for j in free) for i in free}
        above = {i for i in free if share[i] > repeat * sizes[i]}
        if not above:
            return [out[i] if i in out else share[i] for i in range(len(sizes))]
        for i in above:
            out[i] = float(repeat * sizes[i])
            total -= out[i]
        free -= above
    return [out[i] for i in range(len(sizes))]


@pytest.mark.parametrize("sizes", [[100, 1, 1, 500], [1, 1, 1000], [10, 10, 10], [7], [1, 2, 4, 8, 16, 32, 64, 128]])
def test_targets_are_poured(spark, sizes):
    rows = spark.createDataFrame([(None if i == len(sizes) - 1 else f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = [r["target"] for r in mixing.targets(rows, (5, 2, 1), 3).orderBy(F.asc_nulls_last("source")).collect()]
    assert np.allclose(got, poured(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 3))


def test_rows_without_ids_are_mixed_each(spark):
    """Rows with null ids, most of them copies, of a source that must lose some: its target is met, wherever the rows lie."""
    rows = [(None, "w " * 4, "en", "b") for _ in range(60)] + [(None, "v " * (1 + i % 3), "en", "b") for i in range(30)] + [(i, "w " * 5, "en", "a") for i in range(40)] + [(None, None, "en", None)] * 5
    d = spark.createDataFrame(clash(rows), SQL)
    seen = []
    for df in (d, d.repartition(5), d.coalesce(1)):
        got = mixing.mix(df).collect()
        assert len(got) == len(rows)
        for source in ("a", "b"):
            own = [r for r in got if r["source"] == source]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 5
        seen.append(sorted(str(tuple(r)) for r in got))
        assert mixing.mixed_documents(df).groupBy("source").count().count() == len({r["source"] for r in got if r["copies"]})
    assert seen[0] == seen[1] == seen[2]


def test_mixture(spark, docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 and r["target"] <= 3 * r["source_size"] + 1e-6 for r in got)
    sizes = {r["source"]: (r["source_size"], r["target"]) for r in got}
    assert abs(sum(t for _, t in sizes.values()) - sum(n for n, _ in sizes.values())) < 1e-6 * sum(n for n, _ in sizes.values())
    rows = [(i, "w " * (1 + i % 7), "en", f"s{i % 4}") for i in range(2000)]
    d = spark.createDataFrame(clash(rows), SQL)
    by = collections.defaultdict(list)
    for r in mixing.mix(d).collect():
        by[r["source"]].append(r)
    for own in by.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 7
    assert sorted(map(tuple, mixing.mix(d).collect())) == sorted(map(tuple, mixing.mix(d.repartition(5)).collect()))
    assert mixing.mixed_documents(d).groupBy("doc_id").count().filter("count > 3").count() == 0
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def near(rows, width=3, percent=85):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets.items())


def test_near_groups(spark, docs, none):
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(200)]
    rows = [(i, r) for i, r in enumerate(TEXTS)]
    for i in range(60):  # near copies of one text, some linked only through others
        words = list(base)
        for k in rng.integers(0, 200, int(rng.integers(0, 9))):
            words[k] = f"x{i}-{k}"
        rows.append((100 + i, " ".join(words)))
    d = spark.createDataFrame(clash([(i, t, "en", "a") for i, t in rows]), SQL).repartition(3)
    assert sorted(map(tuple, setsketch.near_groups(d).collect())) == near(rows)
    every = setsketch.near_groups(docs)
    assert every.count() == docs.count()
    assert setsketch.near_groups(none).count() == 0


def test_hot_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK", 4)
    rng = np.random.default_rng(8)
    rows = []
    for i in range(60):
        words = [f"t{k}" for k in range(200)]
        for k in rng.integers(0, 200, int(rng.integers(1, 12))):
            words[k] = f"x{i}-{k}"
        rows.append((i, " ".join(words)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    r = F.min(F.struct("id", "t", "n", "regs")).alias("r")
    reps = setsketch.sketched(d, 3, "").groupBy("key").agg(r).select("r.id", F.col("r.id").alias("least"), "r.t", "r.n", "r.regs").checkpoint()
    own = {i: 0 if i < 40 else i for i, _ in rows}
    buckets = {}
    for x in reps.select("id", "regs").collect():
        for k in setsketch.band_keys(np.frombuffer(x.regs, np.uint16))[0].view(np.int64).tolist():
            buckets.setdefault(k, []).append(x.id)
    mixed = {k: v for k, v in buckets.items() if len({own[i] for i in v}) > 1}
    assert max(map(len, mixed.values())) > 8
    members = spark.createDataFrame([(k, i, own[i]) for k, v in mixed.items() for i in v], "bucket long, id long, component long")
    found = [tuple(x) for x in setsketch.across(members, reps, d, 3, 85, "").collect()]
    sets = {i: {tuple(w[k : k + 3]) for k in range(198)} for i, t in rows for w in [t.split()]}
    true = {(a, b) for v in mixed.values() for a in v for b in v if a < b and own[a] != own[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert found and set(found) <= true

    def groups(links):
        root = dict(own)
        for a, b in links:
            a, b = root[a], root[b]
            root = {i: min(a, b) if c in (a, b) else c for i, c in root.items()}
        return root

    assert groups(found) == groups(true)


def test_registers_estimate_and_merge():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2)
    a, b = pool[:2000], pool[1000:]
    x, y = setsketch.registers(a), setsketch.registers(b)
    assert (setsketch.merge(x, y) == setsketch.registers(np.union1d(a, b))).all()
    j = setsketch.jaccard(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([2000]), np.array([2000]))[0]
    assert abs(j - 1 / 3) < 0.15


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 9), (9, 8), (3, 20), (5, 5)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8), (10, 8), (20, 1)]
