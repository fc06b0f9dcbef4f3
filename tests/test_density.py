"""Hierarchical density clusters, spanning forests and components against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.operators import density, graph
from thicket.queries import checkpoints


def parts(nodes, near):
    """Connected parts of nodes under a relation."""
    left, out = set(nodes), []
    while left:
        todo, part = [left.pop()], set()
        while todo:
            x = todo.pop()
            part.add(x)
            more = {y for y in left if near(x, y)}
            left -= more
            todo += more
        out.append(frozenset(part))
    return out


def brute_force(points, d, least, neighbours):
    """Labels from the definition: from the top, a cluster ends where it falls into two that are large enough."""
    core = {x: sorted([0.0] + [d[x][y] for y in points if y != x])[neighbours - 1] if neighbours <= len(points) else 1.0 for x in points}
    reach = {(x, y): max(d[x][y], core[x], core[y], density.LEAST) for x in points for y in points if x != y}
    labels, found = {}, []

    def best(cluster, birth):
        """(stability, selected clusters) of a cluster that comes to be below the distance ``birth``."""
        now, total = cluster, 0.0
        for w in sorted({reach[p] for p in itertools.permutations(cluster, 2)}, reverse=True):
            real = [p for p in parts(now, lambda x, y: reach[x, y] < w) if len(p) >= least]  # noqa: B023
            if len(real) == 1 and real[0] == now:
                continue
            stay = real[0] if len(real) == 1 else frozenset()
            total += (len(now) - len(stay)) / w
            now = stay
            if len(real) != 1:
                break
        own = total - len(cluster) / birth
        below = [best(p, w) for p in real] if len(real) > 1 else []
        found.append((len(cluster), own))
        if below and sum(b[0] for b in below) > own + 1e-12:
            return sum(b[0] for b in below), [c for b in below for c in b[1]]
        return own, [cluster]

    for p in parts(points, lambda x, y: reach[x, y] < density.FAR):
        if len(p) >= least:
            for c in best(p, density.FAR)[1]:
                for x in c:
                    labels[x] = min(c)
    return labels, found


@pytest.mark.parametrize(("seed", "least", "neighbours", "most"), [(1, 4, 4, 1000), (2, 3, 2, 40)])
def test_hdbscan(spark, seed, least, neighbours, most):
    checkpoints(spark)
    rng = np.random.default_rng(seed)
    centres = rng.uniform(0, 4, (5, 2))
    xy = np.concatenate([c + rng.normal(0, 0.04 * (i + 1), (9, 2)) for i, c in enumerate(centres)] + [rng.uniform(0, 4, (6, 2))])
    points = [f"p{i:02}" for i in range(len(xy))]
    # A coarse grid of distances, so that many are equal.
    d = {a: {b: min(round(math.dist(xy[i], xy[j]) * 30) / 30, 1.0) for j, b in enumerate(points)} for i, a in enumerate(points)}
    rows = [(a, b, d[a][b]) for a, b in itertools.combinations(points, 2) if d[a][b] < 1]
    p, q = spark.createDataFrame([(x,) for x in points], "node string"), spark.createDataFrame(rows, "a string, b string, distance double").repartition(3)
    want, found = brute_force(points, d, least, neighbours)
    got = {r["node"]: r["cluster"] for r in density.hdbscan(p, q, least, neighbours, most).collect()}
    assert got.keys() == set(points)
    assert {x for x in points if got[x]} == set(want)
    assert {frozenset(x for x in points if got[x] == c) for c in set(got.values()) - {None}} == {frozenset(x for x in want if want[x] == c) for c in want.values()}
    clusters, _ = density.hierarchy(p, density.reachability_forest(p, q, neighbours, most), least, most)
    stability = sorted((r["n"], r["stability"]) for r in clusters.collect())
    assert len(stability) == len(found) and np.allclose(stability, sorted(found))


def test_no_links_and_no_points(spark):
    checkpoints(spark)
    none = spark.createDataFrame([], "a string, b string, distance double")
    assert [tuple(r) for r in density.hdbscan(spark.createDataFrame([("x",), ("x",)], "node string"), none, 2).collect()] == [("x", None)]
    assert density.hdbscan(spark.createDataFrame([], "node string"), none, 2).count() == 0


@pytest.mark.parametrize("most", [1000, 20])
def test_spanning_forest_and_components(spark, most):
    checkpoints(spark)
    rng = np.random.default_rng(5)
    links = [(int(a), int(b), float(rng.integers(1, 9))) for a, b in rng.integers(0, 60, (70, 2))]
    df = spark.createDataFrame(links, "a long, b long, w double").repartition(3)
    tree = [tuple(r) for r in graph.spanning_forest(df, most).collect()]
    top = {}
    find = lambda x: x if top.setdefault(x, x) == x else find(top[x])
    want = 0.0
    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in links if a != b):
        if find(a) != find(b):
            top[max(find(a), find(b))] = min(find(a), find(b))
            want += w
    assert sum(t[2] for t in tree) == want and len(tree) == len(top) - len({find(x) for x in top})
    assert {r["node"]: r["component"] for r in graph.components(df, most).collect()} == {x: find(x) for x in top}
    assert graph.spanning_forest(df.filter(F.lit(False))).count() == 0
