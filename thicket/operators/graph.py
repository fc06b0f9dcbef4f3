"""Link tables: connected components, and the least forest that spans them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Links that one task may hold: so many are handled at once there, more by steps of joins.
MOST = 500_000


def few(links: DataFrame, most: int) -> bool:
    return links.limit(most + 1).count() <= most


class Merged(dict):
    """Sets that are joined; the least member stands for each."""

    def __missing__(self, x):
        self[x] = x
        return x

    def find(self, x):
        while self[x] != x:
            self[x] = x = self[self[x]]
        return x

    def join(self, a, b) -> bool:
        p, q = self.find(a), self.find(b)
        self[max(p, q)] = min(p, q)
        return p != q


def roots(pointers: DataFrame) -> DataFrame:
    """``node, root``: where pointers ``node, up`` lead in the end; a root points to itself.

    Every step doubles the way that a pointer has come.
    """
    now = pointers.select("node", "up").checkpoint()
    while True:
        over = now.select(F.col("node").alias("mid"), F.col("up").alias("next"))
        new = now.join(over, F.col("up") == F.col("mid")).select("node", F.col("next").alias("up")).checkpoint()
        if not new.join(now.withColumnRenamed("up", "was"), "node").filter("up <> was").limit(1).count():
            return new.withColumnRenamed("up", "root")
        now = new


def spanning_forest(links: DataFrame, most: int = MOST) -> DataFrame:
    """``a, b, w``: links that span every component with the least sum of ``w`` (Borůvka's steps).

    Of equal weights the least ends come first, so the forest is the same whatever the
    order of rows. Each step joins every component to its nearest: at least half of them
    go. Links within a component are dropped, and of those between two components all but
    the least, so steps get cheaper. A hot node's links are summed up in the tasks first.
    Once there are no more than ``most`` links, one task takes them in order of weight.
    """
    edge = F.struct("w", "a", "b")
    live = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").groupBy("a", "b").agg(F.min("w").alias("w"))
    schema = live.select("a", "b", "w").schema
    live = live.select(F.col("a").alias("u"), F.col("b").alias("v"), edge.alias("e")).checkpoint()
    out = None
    while not few(live, most):
        both = live.select("u", "v", "e").unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v"), "e"))
        best = both.groupBy("u").agg(F.min(F.struct("e", "v")).alias("m")).select("u", F.col("m.v").alias("v"), F.col("m.e").alias("e")).checkpoint()
        taken = best.select("e.a", "e.b", "e.w").distinct()
        out = taken if out is None else out.unionByName(taken)
        # Two components that choose each other share their link: the smaller one is a root.
        back = best.select(F.col("u").alias("x"), F.col("v").alias("y"))
        up = best.join(back, F.col("v") == F.col("x")).select(F.col("u").alias("node"), F.when((F.col("y") == F.col("u")) & (F.col("u") < F.col("v")), F.col("u")).otherwise(F.col("v")).alias("up"))
        found = roots(up)
        at = lambda c: found.select(F.col("node").alias(f"{c}_node"), F.col("root").alias(f"{c}_root"))  # noqa: B023, E731
        moved = live.join(at("u"), F.col("u") == F.col("u_node")).join(at("v"), F.col("v") == F.col("v_node")).filter("u_root <> v_root")
        live = moved.select(F.least("u_root", "v_root").alias("u"), F.greatest("u_root", "v_root").alias("v"), "e").groupBy("u", "v").agg(F.min("e").alias("e")).checkpoint()
        out = out.checkpoint()

    def take(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every, sets = pd.concat([*parts] or [pd.DataFrame(columns=["u", "v", "a", "b", "w"])]).sort_values(["w", "a", "b"]), Merged()
        yield every[np.array([sets.join(u, v) for u, v in zip(every["u"], every["v"], strict=True)], bool)][["a", "b", "w"]]

    last = live.select("u", "v", "e.*").coalesce(1).mapInPandas(take, schema).checkpoint()
    return last if out is None else out.unionByName(last)


def components(links: DataFrame, most: int = MOST) -> DataFrame:
    """``node, component``: the least node that each node of links ``a, b`` reaches.

    Of no more than ``most`` links in one task; else nodes take their least neighbour's
    label, and labels their own least one, until nothing changes.
    """
    tree = links.select("a", "b").filter("a <> b").distinct()
    if few(tree, most):
        kind = tree.schema["a"].dataType.simpleString()

        def join(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sets = Merged()
            for pdf in parts:
                for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
                    sets.join(a, b)
            nodes = list(sets)
            yield pd.DataFrame({"node": pd.Series(nodes, dtype=object), "component": pd.Series([sets.find(x) for x in nodes], dtype=object)})

        return tree.coalesce(1).mapInPandas(join, f"node {kind}, component {kind}").checkpoint()
    both = tree.select("a", "b").unionByName(tree.select(F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
    now = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")).checkpoint()
    while True:
        near = both.join(now.select(F.col("node").alias("n"), F.col("component").alias("c")), F.col("b") == F.col("n")).select(F.col("a").alias("node"), "c")
        # What a neighbour's label is goes to the node and to the node's own label.
        told = near.join(now, "node").select(F.explode(F.array("node", "component")).alias("node"), "c").groupBy("node").agg(F.min("c").alias("c"))
        step = now.join(told, "node", "left").select("node", F.least("component", F.coalesce("c", "component")).alias("up"))
        over = step.select(F.col("node").alias("mid"), F.col("up").alias("next"))
        new = step.join(over, F.col("up") == F.col("mid")).select("node", F.least("up", "next").alias("component")).checkpoint()
        if not new.join(now.withColumnRenamed("component", "was"), "node").filter("component <> was").limit(1).count():
            return new
        now = new

