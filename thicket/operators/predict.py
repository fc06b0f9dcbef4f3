"""Prediction: samples are routed through the trees, and the leaves reached are combined.

A forest of checked size goes to the samples, where each node takes a whole batch at
once; a larger one is joined with them, one level of all trees and samples at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.numeric import DropMode, positive, sanitize
from thicket.operators.forest import ROOT, leaf_features

#: Nodes that may be sent to the samples.
BROADCAST_NODES = 20_000


def present(matrix: DataFrame, mode: DropMode, as_built: bool = False) -> DataFrame:
    """The cells that count as present in routing.

    By default missing is what training drops. ``as_built`` keeps raw cells: only the
    sentinel is missing and NaN counts as small, so it goes left.
    """
    v = F.col("value")
    if as_built:
        out = matrix.filter(v.isNotNull()).withColumn("value", F.when(F.isnan(v), F.lit(float("-inf"))).otherwise(v))
        return out.filter(v != 0) if mode is DropMode.ZEROS else out.filter(v != float("inf")) if mode is DropMode.NO else out
    clean = matrix.filter(v.isNotNull() & ~F.isnan(v)).withColumn("value", sanitize(v))
    return clean.filter(v != 0) if mode is DropMode.ZEROS else clean


def route(nodes: DataFrame, matrix: DataFrame, policy: str = "branch") -> DataFrame:
    """``sample_id, tree_id, node_id``: the nodes that each sample ends in.

    ``matrix`` has the present cells. Where a split's cell is missing, ``branch`` goes on
    in both children, ``truncate`` ends in the node, and ``abort`` drops the path. Values
    above the split go right, others left. A forest of few nodes, by count, is sent to
    the samples; a larger one is joined with them level by level.
    """
    if policy not in ("branch", "truncate", "abort"):
        raise ValueError("policy must be branch, truncate or abort")
    few = nodes.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    return route_sent(nodes, matrix, policy) if few else route_joined(nodes, matrix, policy)


def route_sent(nodes: DataFrame, matrix: DataFrame, policy: str) -> DataFrame:
    """Routing with the forest in each task: a tree's node takes all samples of a batch that reach it at once."""
    rows = nodes.select("tree_id", "node_id", "parent_id", "side", "split_feature", "split_value", "is_leaf").collect()  # BROADCAST_NODES at most
    names = sorted({r["split_feature"] for r in rows if not r["is_leaf"]})
    where = {n: i for i, n in enumerate(names)}
    kids = {(r["tree_id"], r["parent_id"], r["side"]): r["node_id"] for r in rows if r["parent_id"] is not None}
    table = {(r["tree_id"], r["node_id"]): (None if r["is_leaf"] else where[r["split_feature"]], r["split_value"]) for r in rows}
    roots = sorted({r["tree_id"] for r in rows if r["node_id"] == ROOT})
    kind = matrix.schema["sample_id"].dataType.simpleString()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cells = np.full((len(pdf), max(len(names), 1)), np.nan)
            for i, row in enumerate(pdf["cells"]):
                for c in row if row is not None else ():
                    cells[i, where[c["feature"]]] = c["value"]
            ids, out = pdf["sample_id"].to_numpy(), []
            for tree in roots:
                todo = [(ROOT, np.arange(len(pdf)))]
                while todo:
                    node, own = todo.pop()
                    column, cut = table[tree, node]
                    if column is None:
                        out.append(pd.DataFrame({"sample_id": ids[own], "tree_id": tree, "node_id": node}))
                        continue
                    x = cells[own, column]
                    lost = np.isnan(x)
                    if policy == "truncate" and lost.any():
                        out.append(pd.DataFrame({"sample_id": ids[own[lost]], "tree_id": tree, "node_id": node}))
                    both = lost if policy == "branch" else np.zeros(len(x), bool)
                    for side, to in (("L", (x <= cut) | both), ("R", (x > cut) | both)):
                        if to.any():
                            todo.append((kids[tree, node, side], own[to]))
            if out:
                yield pd.concat(out)

    asked = F.when(F.col("feature").isin(names), F.struct("feature", "value"))
    each = matrix.groupBy("sample_id").agg(F.collect_list(asked).alias("cells"))  # a row of the matrix, its split features only
    return each.mapInPandas(walk, f"sample_id {kind}, tree_id int, node_id string")


def route_joined(nodes: DataFrame, matrix: DataFrame, policy: str) -> DataFrame:
    """Routing by joins, a level at a time; each level's frontier is cut off in the shared folder."""
    kids = nodes.filter("parent_id is not null").groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.max(F.when(F.col("side") == "L", F.col("node_id"))).alias("l"), F.max(F.when(F.col("side") == "R", F.col("node_id"))).alias("r"))
    table = nodes.select("tree_id", "node_id", "split_feature", "split_value", "is_leaf").join(kids, ["tree_id", "node_id"], "left").checkpoint()
    levels = nodes.agg(F.max("depth")).first()[0] or 0
    cells = matrix.select("sample_id", F.col("feature").alias("split_feature"), F.col("value").alias("at"))
    frontier = matrix.select("sample_id").distinct().crossJoin(table.filter(F.col("node_id") == ROOT).select("tree_id", "node_id"))
    done = None
    for level in range(levels + 1):
        at = frontier.join(table, ["tree_id", "node_id"]).join(cells, ["sample_id", "split_feature"], "left").checkpoint()
        ended = F.col("is_leaf") | (F.col("at").isNull() if policy == "truncate" else F.lit(False))
        own = at.filter(ended).select("sample_id", "tree_id", "node_id")
        done = own if done is None else done.unionByName(own)
        if level == levels:
            break
        go = F.when(F.col("at") > F.col("split_value"), F.col("r")).otherwise(F.col("l"))
        to = F.when(F.col("at").isNotNull(), F.array(go)).when(F.lit(policy == "branch"), F.array("l", "r")).otherwise(F.array().cast("array<string>"))
        frontier = at.filter("not is_leaf").select("sample_id", "tree_id", F.explode(to).alias("node_id"))
    return done


def weight_of(weighing: str, gain: F.Column, cov: F.Column) -> F.Column:
    g = positive(gain)
    inverse = F.when(positive(cov) > 0, 1 / positive(cov)).otherwise(F.lit(float("inf")))
    return {"flat": F.lit(1.0), "gain": g, "gain_squared": g * g, "dispersion": inverse, "dispersion_squared": inverse * inverse}[weighing]


def combine(leaves: DataFrame, weighing: str = "gain", literal: bool = False) -> DataFrame:
    """``sample_id, feature, value`` by the weighted mean of ``sample_id, feature, median, absolute_gain, cov``.

    Features whose weights sum to nothing are 0, as are those with a dispersion of 0
    among the leaves when it weighs inversely. ``literal`` squares the medians too in the
    ``dispersion_squared`` weighing, as it was first built.
    """
    w = weight_of(weighing, F.col("absolute_gain"), F.col("cov"))
    m = F.col("median")
    term = (m * w) * (m * w) if literal and weighing == "dispersion_squared" else m * w
    d = leaves.withColumn("w", w).withColumn("t", F.when(w < float("inf"), term).otherwise(0.0))
    out = d.groupBy("sample_id", "feature").agg(F.sum("t").alias("a"), F.sum("w").alias("b"))
    q = F.when((F.col("b") > 0) & (F.col("b") < float("inf")), F.try_divide(F.col("a"), F.col("b"))).otherwise(0.0)
    return out.select("sample_id", "feature", F.coalesce(F.nanvl(q, F.lit(0.0)), F.lit(0.0)).alias("value"))


def intervals(leaves: DataFrame) -> DataFrame:
    """Median plus and minus dispersion, each with score 1."""
    return leaves.select("sample_id", "feature", (F.col("median") - F.col("dispersion")).alias("start"), (F.col("median") + F.col("dispersion")).alias("end"), F.lit(1.0).alias("score"))


def interval_stack(spans: DataFrame, by: tuple[str, ...] = ("sample_id", "feature")) -> DataFrame:
    """The elementary segments between all ends, with the sum of scores that cover each.

    A sweep along the ends of each group: no interval is compared with another.
    """
    ends = spans.select(*by, F.explode(F.array(F.struct(F.col("start").alias("at"), F.col("score").alias("d")), F.struct(F.col("end").alias("at"), (-F.col("score")).alias("d")))).alias("e")).select(*by, "e.at", "e.d")
    steps = ends.groupBy(*by, "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*by).orderBy("at")
    out = steps.select(*by, F.col("at").alias("start"), F.lead("at").over(w).alias("end"), F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("score"))
    return out.filter((F.col("end") > F.col("start")) & (F.abs("score") > 1e-12))


def stacked(segments: DataFrame, by: tuple[str, ...] = ("sample_id", "feature")) -> DataFrame:
    """The middle of the segment with the highest score, of equal ones the last."""
    return segments.groupBy(*by).agg(F.max_by((F.col("start") + F.col("end")) / 2, F.struct("score", "start")).alias("value"))


def _with_all_samples(cells: DataFrame, matrix: DataFrame) -> DataFrame:
    """A null cell keeps samples in play that have no present cell."""
    bare = matrix.select("sample_id").distinct().select("sample_id", F.lit(None).cast("string").alias("feature"), F.lit(None).cast("double").alias("value"))
    return cells.select("sample_id", "feature", "value").unionByName(bare)


def predict(nodes: DataFrame, matrix: DataFrame, policy: str = "branch", averaging: str = "arithmetic", weighing: str = "gain", mode: DropMode = DropMode.ZEROS, as_built: bool = False, features: DataFrame | None = None) -> DataFrame:
    """``sample_id, feature, value`` for every sample and every feature that the forest knows or ``features`` names; 0 where no leaf was reached."""
    at = route(nodes, _with_all_samples(present(matrix, mode, as_built), matrix), policy)
    lf = leaf_features(nodes).select("tree_id", "node_id", "feature", "median", "dispersion", "cov", "absolute_gain")
    leaves = at.join(lf, ["tree_id", "node_id"])
    if averaging == "stacking":
        got = stacked(interval_stack(intervals(leaves)))
    else:
        got = combine(leaves, weighing, as_built)
    names = (features or lf).select("feature").distinct()
    grid = matrix.select("sample_id").distinct().crossJoin(F.broadcast(names))
    return grid.join(got, ["sample_id", "feature"], "left").select("sample_id", "feature", F.coalesce("value", F.lit(0.0)).alias("value"))
