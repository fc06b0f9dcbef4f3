"""Hierarchical density clusters (HDBSCAN) over a table of distances.

The mutual reachability of two points is the largest of their distance and both core
distances. Links that span the points with least reachability hold the whole hierarchy:
taken from the nearest to the farthest, they join sets of points, and a set with enough
of them is a cluster. A cluster's stability is how long its points stay in it, in terms
of 1 / distance; of a cluster and those below it, the more stable choice is selected.

Links are taken in slices by distance, so that a task gets a connected part of a slice.
What it hands on is a row for each set: its size and its cluster's sums; the sets of one
slice are the points of the next. So no task holds more than about ``most`` links of a
slice, however large a component grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.operators.graph import MOST, components, spanning_forest

#: The distance of points without a link, at which everything is one; distances below LEAST count as it.
FAR, LEAST = 1.0, 1e-6

#: A set of points: its least point, size, cluster (null if it is too small to be one), the sum of 1 / distance at which
#: points left the cluster, the stability of the best choice below it (null if there is nothing below), and the points
#: of a set that is no cluster yet.
STATE_SQL = "node string, size long, cluster string, total double, below double, loose array<string>"
#: What a slice tells: a closed cluster's parent, stability, size and whether it beats those below it (kind 0), a point's first cluster (1), or a state (2).
TOLD_SQL = "kind int, name string, parent string, stability double, n long, better boolean, " + STATE_SQL


def core_distances(points: DataFrame, links: DataFrame, neighbours: int) -> DataFrame:
    """``node, core``: the distance to the ``neighbours``-th nearest point, itself the first; FAR if too few are linked."""
    both = links.select(F.col("a").alias("node"), F.col("w")).unionByName(links.select(F.col("b").alias("node"), F.col("w")))
    if neighbours <= 1:
        return points.select("node", F.lit(0.0).alias("core"))
    # Tasks pass on a point's nearest ones only (a limited window), so a hot point's links don't come together.
    order = Window.partitionBy("node").orderBy("w")
    near = both.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= neighbours - 1).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("core"))
    return points.join(near, "node", "left").select("node", F.when(F.col("n") >= neighbours - 1, F.col("core")).otherwise(FAR).alias("core"))


def reachability_forest(points: DataFrame, distances: DataFrame, neighbours: int, most: int = MOST) -> DataFrame:
    """``a, b, w``: links that span the points with the least mutual reachability, those nearer than FAR."""
    links = distances.select("a", "b", F.col("distance").alias("w")).filter(F.col("w") < FAR)
    core = core_distances(points, links, neighbours).checkpoint()
    side = lambda c: core.select(F.col("node").alias(c), F.col("core").alias(f"{c}_core"))
    both = links.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.greatest("w", "a_core", "b_core", F.lit(LEAST)).alias("w"))
    return spanning_forest(both.filter(F.col("w") < FAR), most)


class Sets:
    """Sets of points that links join, and what becomes of their clusters."""

    def __init__(self, states: list[tuple], least: int) -> None:
        self.least, self.top = least, {s[0]: s[0] for s in states}
        self.state = {s[0]: s for s in states}
        self.told: list[tuple] = []

    def find(self, x: str) -> str:
        while self.top[x] != x:
            self.top[x] = x = self.top[self.top[x]]
        return x

    def join(self, ends: list[tuple[str, str]], w: float) -> None:
        """All links of one distance at once."""
        met: dict[str, set[str]] = {}
        for a, b in ends:
            p, q = self.find(a), self.find(b)
            if p == q:
                continue
            keep, gone = min(p, q), max(p, q)
            self.top[gone] = keep
            met[keep] = met.pop(keep, {keep}) | met.pop(gone, {gone})
        for keep, some in met.items():
            self.state[keep] = merged([self.state.pop(x) for x in sorted(some)], w, self.least, self.told)


def merged(states: list[tuple], w: float, least: int, told: list[tuple]) -> tuple:
    """One set of those that meet at distance ``w``; clusters that end there, and points that find their first, are told."""
    rate, node = 1 / max(w, LEAST), min(s[0] for s in states)
    size = sum(s[1] for s in states)
    real = [s for s in states if s[2] is not None]
    loose = [p for s in states for p in s[5]]
    if not real and size < least:
        return node, size, None, 0.0, None, loose
    cluster = real[0][2] if len(real) == 1 else f"{node}@{w!r}"
    told += [(1, p, cluster, None, None, None) for p in loose]
    if not real:
        return node, size, cluster, size * rate, None, []
    if len(real) == 1:
        return node, size, cluster, real[0][3] + (size - real[0][1]) * rate, real[0][4], []
    best = 0.0
    for _, n, name, total, below, _ in real:
        own = total - n * rate
        better = below is None or own >= below
        told.append((0, name, cluster, own, n, better))
        best += own if better else below
    return node, size, cluster, size * rate, best, []


def hierarchy(points: DataFrame, tree: DataFrame, least: int, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Clusters ``cluster, parent, stability, n, selected, top`` (the selected one that it is part of, if any), and
    homes ``node, cluster``: the first cluster that a point is in.

    Points that are in none, and clusters without a parent, have nulls. Everything is one
    at FAR; that isn't a cluster, so a component may be selected as a whole.
    """
    spark = points.sparkSession
    blank = {"size": F.lit(1).cast("long"), "cluster": F.lit(None).cast("string"), "total": F.lit(0.0), "below": F.lit(None).cast("double"), "loose": F.array("node")}
    states = points.select("node", *[v.alias(k) for k, v in blank.items()]).checkpoint()
    at = points.select("node", F.col("node").alias("now")).checkpoint()
    tree, told = tree.checkpoint(), None
    names = [c.split()[0] for c in STATE_SQL.split(", ")]

    def fold(key, links: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        states_ = zip(own["node"], own["size"], own["cluster"], own["total"], own["below"], own["loose"], strict=True)
        sets = Sets([(node, int(size), cluster, total, None if pd.isna(below) else below, list(loose)) for node, size, cluster, total, below, loose in states_], least)
        for w, part in links.sort_values(["w", "a", "b"]).groupby("w", sort=True):
            sets.join(list(zip(part["a"], part["b"], strict=True)), float(w))
        return frame(sets.told, list(sets.state.values()))

    def frame(rows: list[tuple], left: list[tuple]) -> pd.DataFrame:
        blank_ = (None,) * len(names)
        every = [(*r, *blank_) for r in rows] + [(2, None, None, None, None, None, *s) for s in left]
        return pd.DataFrame({c: pd.Series(x, dtype=object) for c, x in zip(["kind", "name", "parent", "stability", "n", "better", *names], zip(*every, strict=True), strict=True)})

    for low, high in slices(tree, most):
        part = tree.filter((F.col("w") >= low) & (F.col("w") < high))
        ends = lambda c: at.select(F.col("node").alias(f"{c}_node"), F.col("now").alias(f"{c}_now"))  # noqa: B023, E731
        part = part.join(ends("a"), F.col("a") == F.col("a_node")).join(ends("b"), F.col("b") == F.col("b_node")).select(F.col("a_now").alias("a"), F.col("b_now").alias("b"), "w").checkpoint()
        groups = components(part, most)
        linked = part.join(groups, F.col("a") == F.col("node")).select("component", "a", "b", "w")
        mine = states.join(groups, "node").select(F.col("component").alias("component"), *names)
        got = linked.groupBy("component").cogroup(mine.groupBy("component")).applyInPandas(lambda key, a, b: fold(key, a, b), TOLD_SQL).checkpoint()
        states = states.join(groups, "node", "left_anti").select(*names).unionByName(got.filter("kind = 2").select(*names)).checkpoint()
        moved = groups.select(F.col("node").alias("now"), "component")
        at = at.join(moved, "now", "left").select("node", F.coalesce("component", "now").alias("now")).checkpoint()
        rows = got.filter("kind < 2").select("kind", "name", "parent", "stability", "n", "better")
        told = rows if told is None else told.unionByName(rows)

    # What is left ends at FAR.
    own = F.col("total") - F.col("size") * (1 / FAR)
    last = states.filter("cluster is not null").withColumn("own", own)
    found = last.select("cluster", F.lit(None).cast("string").alias("parent"), F.col("own").alias("stability"), F.col("size").alias("n"), (F.col("below").isNull() | (F.col("own") >= F.col("below"))).alias("better"))
    homes = spark.createDataFrame([], "node string, cluster string")
    if told is not None:
        told = told.checkpoint()
        found = found.unionByName(told.filter("kind = 0").select(F.col("name").alias("cluster"), "parent", "stability", "n", "better"))
        homes = told.filter("kind = 1").select(F.col("name").alias("node"), F.col("parent").alias("cluster"))
    found = found.checkpoint()
    top = topmost(found)
    found = found.join(top.withColumnRenamed("cluster", "of"), F.col("cluster") == F.col("of")).select("cluster", "parent", "stability", "n", F.col("cluster").eqNullSafe(F.col("top")).alias("selected"), "top")
    return found.checkpoint(), points.select("node").join(homes, "node", "left").checkpoint()


def topmost(found: DataFrame) -> DataFrame:
    """``cluster, top``: of a cluster and those above it the highest that beats what is below it, or null.

    Every step doubles how far a cluster has looked.
    """
    now = found.select("cluster", F.col("parent").alias("up"), F.when(F.col("better"), F.col("cluster")).alias("top")).checkpoint()
    while now.filter("up is not null").limit(1).count():
        over = now.select(F.col("cluster").alias("mid"), F.col("up").alias("next"), F.col("top").alias("over"))
        now = now.join(over, F.col("up") == F.col("mid"), "left").select("cluster", F.col("next").alias("up"), F.coalesce("over", "top").alias("top")).checkpoint()
    return now.select("cluster", "top")


def slices(tree: DataFrame, most: int) -> Iterator[tuple[float, float]]:
    """Bounds of distances, ascending: links of one distance are in one slice, and a slice has about ``most`` of them."""
    n = tree.count()
    count = max(1, -(-n // most))
    cuts = sorted(set(tree.agg(F.percentile_approx("w", [i / count for i in range(1, count)], 10 * count)).first()[0] or [])) if count > 1 else []
    edges = [0.0, *cuts, 2 * FAR]
    yield from zip(edges[:-1], edges[1:], strict=True)


def hdbscan(points: DataFrame, distances: DataFrame, least: int = 5, neighbours: int | None = None, most: int = MOST) -> DataFrame:
    """``node, cluster``: the selected cluster of each point, null for noise.

    ``points`` has ``node``, ``distances`` pairs ``a, b, distance`` of those nearer than 1. A
    cluster has ``least`` points or more; ``neighbours`` (as many, if not given) set how
    dense its surroundings must be. Clusters are named by their least point and the
    distance at which they come to be. Equal distances are taken together.
    """
    points = points.select("node").distinct().checkpoint()
    tree = reachability_forest(points, distances, least if neighbours is None else neighbours, most)
    found, homes = hierarchy(points, tree, least, most)
    top = found.select(F.col("cluster").alias("home"), "top")
    return homes.join(top, F.col("cluster") == F.col("home"), "left").select("node", F.col("top").alias("cluster"))
