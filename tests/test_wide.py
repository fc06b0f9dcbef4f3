"""Scans, medians and growth whose nodes are spread over tasks: the same numbers as in one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.operators import forest, kernel, numbered, prefix_order, scan, selection, stats, wide_scan
from thicket.queries import checkpoints

KINDS = {
    "normal": lambda r, n: r.normal(size=n), "ties": lambda r, n: np.round(r.normal(size=n)), "three": lambda r, n: r.integers(0, 3, n).astype(float), "heavy": lambda r, n: np.exp(10 * r.normal(size=n)), "sorted": lambda r, n: np.sort(r.normal(size=n)),
    "two heaps": lambda r, n: r.choice([-100.0, 100.0], n) + r.normal(size=n), "below zero": lambda r, n: -np.exp(8 * r.normal(size=n)), "constant": lambda r, n: np.ones(n), "empty": lambda r, n: np.full(n, np.nan),
}


def sequences(n, seed=3, lost=0.15):
    rng = np.random.default_rng(seed)
    return {k: np.where(rng.random(n) < lost, np.nan, f(rng, n)) for k, f in KINDS.items()}


@pytest.fixture(scope="module")
def long(spark):
    """``node, feature, k, value``: each kind is a key; 300 positions."""
    checkpoints(spark)
    rows = [(kind, "f", k, None if np.isnan(x) else float(x)) for kind, v in sequences(300).items() for k, x in enumerate(v)]
    return spark.createDataFrame(rows, "node string, feature string, k long, value double").repartition(3).checkpoint()


@pytest.mark.parametrize("n", [0, 1, 2, 7, 60])
def test_all_prefixes_at_once(n):
    for seed in range(8):
        for v in sequences(n, seed).values():
            for a, b in zip(kernel.running(v), prefix_order.running(v), strict=True):
                assert (a == b).all()


@pytest.mark.parametrize("size", [32, 1000])
def test_wide_running(long, size):
    """The root has about ten times what a task may hold; and all of it in one."""
    got = wide_scan.wide_running(long, ["node", "feature"], size).toPandas()
    for kind, v in sequences(300).items():
        own = got[got["node"] == kind].sort_values("k")
        medians, mads = kernel.running(v)
        assert (own["k"].to_numpy() == np.arange(301)).all() and (own["median"].to_numpy() == medians).all() and (own["mad"].to_numpy() == mads).all(), kind


def test_ranges_hold_few(long):
    """No task's group is larger than a few ranges: brackets are exact, but narrow."""
    v = sequences(300)["heavy"]
    v = v[~np.isnan(v)]
    import pandas as pd

    order = np.argsort(v, kind="stable")
    j = np.empty(len(v), int)
    j[order] = np.arange(len(v)) // 16
    table = pd.DataFrame([{"j": i, "low": v[j == i].min(), "high": v[j == i].max(), "before": 0} for i in range(j.max() + 1)])
    ranges = wide_scan.Ranges(pd.DataFrame({"j": j}), table)
    rows = np.arange(2, len(v))
    m = np.array([np.median(v[:k]) for k in rows])
    first, last = (rows - 1) // 2, rows // 2
    lower, upper = ranges.bracket(m, first, last, rows)
    for k, a, b, lo, hi, mid in zip(rows, first, last, lower, upper, m, strict=True):
        d = np.sort(np.abs(v[:k] - mid))
        assert lo <= d[a] and d[b] <= hi
        assert ((np.abs(v[:k] - mid) >= lo) & (np.abs(v[:k] - mid) <= hi)).sum() <= 6 * 16


def test_a_long_key_has_few_chunks(long, monkeypatch):
    """No step's table grows with the square of the positions, and the numbers stay the same."""
    monkeypatch.setattr(wide_scan, "CHUNKS", 8, raising=False)
    steps, real = [], type(long).checkpoint

    def counted(df, *args, **kwargs):
        out = real(df, *args, **kwargs)
        steps.append(out.count())
        return out

    monkeypatch.setattr(type(long), "checkpoint", counted)
    kinds = ("heavy", "three", "constant")
    got = wide_scan.wide_running(long.filter(F.col("node").isin(*kinds)), ["node", "feature"], 2).toPandas()
    assert max(steps) <= 3 * 301 * 3
    for kind in kinds:
        own = got[got["node"] == kind].sort_values("k")
        medians, mads = kernel.running(sequences(300)[kind])
        assert (own["median"].to_numpy() == medians).all() and (own["mad"].to_numpy() == mads).all(), kind


@pytest.mark.parametrize("kind", ["constant", "three", "ties", "heavy", "two heaps", "doubles"])
def test_ties_need_few_ranges(kind):
    """However many elements are equal, the ranges that a prefix has to look at hold few, and the rest is told by the bounds."""
    import pandas as pd

    v = sequences(3000)["ties" if kind == "doubles" else kind]
    v = v[~np.isnan(v)] * (0.1 if kind == "doubles" else 1)
    order, part = np.argsort(v, kind="stable"), 16
    j = np.empty(len(v), int)
    j[order] = np.arange(len(v)) // part
    table = pd.DataFrame([{"j": i, "low": v[j == i].min(), "high": v[j == i].max(), "before": 0} for i in range(j.max() + 1)])
    rows = np.arange(2, len(v), 7)
    m = np.array([np.median(v[:k]) for k in rows])
    first, last = (rows - 1) // 2, rows // 2
    lower, upper, l1, l2, r1, r2, skip = wide_scan.Ranges(pd.DataFrame({"j": j}), table).kept(m, first, last, rows)
    for i, k in enumerate(rows):
        d, at = np.abs(v[:k] - m[i]), j[:k]
        near = np.sort(d)
        assert lower[i] <= near[first[i]] and near[last[i]] <= upper[i]
        if lower[i] == upper[i]:
            continue
        kept = ((at >= l1[i]) & (at <= l2[i])) | ((at >= r1[i]) & (at <= r2[i]))
        assert kept.sum() <= 6 * part
        own = np.concatenate([np.full(skip[i], lower[i]), np.sort(np.clip(d[kept], lower[i], upper[i])), np.full(k, upper[i])])
        assert (own[first[i]], own[last[i]]) == (near[first[i]], near[last[i]])


@pytest.fixture(scope="module")
def node(spark, long):
    """A node of four features; a sample is a position."""
    kept = long.filter("node in ('normal', 'ties', 'two heaps', 'heavy') and k < 160")
    return kept.select(F.lit("x").alias("node"), F.col("k").alias("sample_id"), F.col("node").alias("feature"), "value").checkpoint()


def sorted_rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def test_scores_and_cuts_of_a_wide_node(node):
    one, spread = scan.drawn(node, node).checkpoint(), scan.drawn(node, node, True, 20).checkpoint()
    assert one.exceptAll(spread.select(one.columns)).count() == 0 and one.count() == spread.count()
    key = ("split_feature", "feature", "k")
    a, b = scan.mad_scan(one), scan.mad_scan(spread, True, 20)
    assert sorted_rows(a, *key) == sorted_rows(b.select(a.columns), *key)
    for mode, norm, weights in (("mad", "l1", None), ("variance", "l2", {"ties": 0.5})):
        a, b = scan.split_scores(one, mode, norm, weights), scan.split_scores(spread, mode, norm, weights, wide=True, size=20)
        x, y = sorted_rows(a, "split_feature", "k"), sorted_rows(b.select(a.columns), "split_feature", "k")
        assert [r[:5] for r in x] == [r[:5] for r in y] and np.allclose([r[5] for r in x], [r[5] for r in y], rtol=1e-9)


def test_growth_over_wide_nodes(node):
    """A root of many times a task's cells grows the tree that one task grows."""
    cells = node.filter("feature in ('normal', 'two heaps')").select(F.lit(1).alias("tree_id"), "sample_id", "feature", "value")
    a, b = forest.fit_levels(cells, 60, 1).toPandas(), forest.fit_levels(cells, 60, 1, most=200, size=40).toPandas()
    a, b = (x.sort_values("node_id").reset_index(drop=True) for x in (a, b))
    assert b["samples"].isna().tolist() == [len(s) * 2 > 200 for s in a["samples"]]
    for c in ("node_id", "split_feature", "split_value", "n_samples", "is_leaf"):
        assert a[c].equals(b[c])
    assert all(list(x) == list(y) for c in ("medians", "dispersions") for x, y in zip(a[c], b[c], strict=True))


def test_medians_by_selection(spark, long):
    got = {r["node"]: r for r in stats.summary(long, ["node"], 20).collect()}
    plain = {r["node"]: r for r in stats.summary(long, ["node"], 10**9).collect()}
    assert got.keys() == plain.keys() == KINDS.keys() - {"empty"}
    for kind, r in got.items():
        v = sequences(300)[kind]
        v = v[~np.isnan(v)]
        assert (r["n"], r["median"], r["mad"]) == (len(v), np.median(v), np.median(np.abs(v - np.median(v))))
        for c in ("median", "mad", "mean", "var_pop", "var_samp", "l2", "cov"):
            assert np.isclose(r[c], plain[kind][c], rtol=1e-9, atol=1e-12)


def test_a_wrong_sketch_is_noticed(spark, long, monkeypatch):
    """With a grid that misses the middle all values are kept, and the result stays exact."""
    monkeypatch.setattr(selection, "ACCURACY", 10**9)
    real = F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda c, grid, accuracy: real(c, [0.9] * len(grid), 100))
    got = {r["node"]: (r["low"], r["high"]) for r in selection.middle_values(long, ["node"]).collect()}
    for kind, v in sequences(300).items():
        v = np.sort(v[~np.isnan(v)])
        assert not len(v) or got[kind] == (v[(len(v) - 1) // 2], v[len(v) // 2])


def test_sums_before(spark):
    checkpoints(spark)
    rows = [(g, i, i % 3) for g in ("a", None) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, i long, w long").repartition(4)
    got = {(r["g"], r["i"]): r["s"] for r in numbered.sum_before(df, ["g"], ["i"], F.col("w"), "s", 7).collect()}
    assert got == {(g, i): sum(x % 3 for x in range(i)) for g in ("a", None) for i in range(50)}
    assert sorted(r["k"] for r in numbered.numbered(df.filter("g = 'a'"), ["g"], ["i"], "k", 9).collect()) == list(range(50))


def test_few_tasks_sort(spark, monkeypatch):
    """Small tasks hold more as a table grows, so that there are never very many."""
    checkpoints(spark)
    monkeypatch.setattr(numbered, "TASKS", 5, raising=False)
    df = spark.range(100).select(F.lit("a").alias("g"), "id")
    seen, real = [], type(df).repartitionByRange
    monkeypatch.setattr(type(df), "repartitionByRange", lambda df, n, *by: (seen.append(n), real(df, n, *by))[1])
    out = numbered.numbered(df, ["g"], ["id"], "k", 2)
    assert out.filter("k <> id").count() == 0 and out.select("k").distinct().count() == 100
    assert seen == [5]
