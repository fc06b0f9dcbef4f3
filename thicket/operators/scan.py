"""Split scans: how dispersed the outputs are on both sides of every cut of an input.

Inputs and outputs are long tables with a ``node`` column. Variance scans are running
sums of window functions. MAD scans run the kernel once per node and input feature as
long as a node's cells fit into a task; the cells of larger nodes stay spread over
tasks, in chunks of positions and ranges of values (``wide_scan``). Both give the same
numbers. Functions that can do both take ``wide``, which ``is_wide`` finds by counting.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.numeric import LEAST_NORMAL
from thicket.operators import kernel
from thicket.operators.numbered import numbered
from thicket.operators.selection import largest
from thicket.operators.wide_scan import SIZE, wide_running

#: Cells of a node that one task may hold.
TASK_CELLS = 2_000_000
#: Fewest samples with a value of the input for a node to be cut, and cuts left out at each end.
LEAST_DRAWS, EDGE = 6, 3


def is_wide(cells: DataFrame, most: int = TASK_CELLS) -> bool:
    """Whether a node has more cells than a task may hold."""
    return largest(cells, ["node"]) > most


def draw_order(inputs: DataFrame, wide: bool = False, size: int = SIZE) -> DataFrame:
    """``node, split_feature, sample_id, split_value, k, n``: samples by ascending value, ties by sample."""
    own = inputs.filter("value is not null").select("node", F.col("feature").alias("split_feature"), "sample_id", F.col("value").alias("split_value"))
    if wide:
        placed = numbered(own, ["node", "split_feature"], ["split_value", "sample_id"], "k", 4 * size)
        n = own.groupBy(F.col("node").alias("of"), F.col("split_feature").alias("by")).agg(F.count(F.lit(1)).alias("n"))
        return placed.join(n, (F.col("node") == F.col("of")) & (F.col("split_feature") == F.col("by"))).drop("of", "by")
    w = Window.partitionBy("node", "split_feature")
    return own.withColumn("k", F.row_number().over(w.orderBy("split_value", "sample_id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))


def drawn(inputs: DataFrame, outputs: DataFrame, wide: bool = False, size: int = SIZE) -> DataFrame:
    """The outputs along each input's draw order: ``node, split_feature, k, n, sample_id, split_value, feature, value``.

    Inputs with too few draws go before anything is joined or sorted again.
    """
    order = draw_order(inputs, wide, size).filter(F.col("n") >= LEAST_DRAWS)
    return order.join(outputs.select("node", "sample_id", "feature", "value"), ["node", "sample_id"])


def variance_scan(along: DataFrame) -> DataFrame:
    """Population variance of each output before and from each draw on: ``before, onward``.

    Running sums forwards and backwards, about the output's mean for precision.
    """
    keys = ["node", "split_feature", "feature"]
    every = Window.partitionBy(*keys)
    v = F.col("value") - F.avg("value").over(every)
    d = along.withColumn("c", v)
    up = every.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    down = every.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)

    def var(w) -> F.Column:
        n = F.count("c").over(w)
        mean = F.try_divide(F.sum("c").over(w), n)
        return F.coalesce(F.greatest(F.try_divide(F.sum(F.col("c") * F.col("c")).over(w), n) - mean * mean, F.lit(0.0)), F.lit(0.0))

    return d.select(*keys, "k", "n", "sample_id", "split_value", "value", var(up).alias("before"), var(down).alias("onward"))


def _groups(along: DataFrame, schema: str, each) -> DataFrame:
    return along.groupBy("node", "split_feature").applyInPandas(lambda key, pdf: each(key, pdf), schema)


def _table(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, list[str]]:
    """Draws in order, outputs as a matrix (NaN missing), and the outputs' names."""
    draws = pdf.drop_duplicates("k").sort_values("k")
    wide = pdf.pivot_table(index="k", columns="feature", values="value", aggfunc="first", dropna=False).reindex(draws["k"])
    return draws, wide.to_numpy(float), [str(c) for c in wide.columns]


def wide_mad_scan(along: DataFrame, size: int = SIZE) -> DataFrame:
    """As ``mad_scan``, with at most a few times ``size`` cells in a task, however many a node has."""
    keys = ["node", "split_feature", "feature"]
    along = along.select(*keys, "k", "n", "value").checkpoint()
    draws = along.select("node", "split_feature", F.col("k").cast("long").alias("k"), F.col("n").cast("long").alias("n")).distinct()
    # Every output has a cell at every draw, if only an empty one.
    every = draws.join(along.select("node", "split_feature", "feature").distinct(), ["node", "split_feature"])
    cells = every.join(along.select(*keys, F.col("k").cast("long").alias("k"), "value"), [*keys, "k"], "left").checkpoint()
    before = wide_running(cells.select(*keys, "k", "value"), keys, size)
    onward = wide_running(cells.select(*keys, (F.col("n") - 1 - F.col("k")).alias("k"), "value"), keys, size)
    n = draws.select("node", "split_feature", "n").distinct()
    onward = onward.join(n, ["node", "split_feature"]).select(*keys, (F.col("n") - F.col("k")).alias("k"), F.col("median").alias("median_onward"), F.col("mad").alias("mad_onward"))
    both = before.select(*keys, "k", F.col("mad").alias("mad_before")).join(onward, [*keys, "k"])
    return both.select(*keys, F.col("k").cast("int").alias("k"), "median_onward", "mad_before", "mad_onward")


def mad_scan(along: DataFrame, wide: bool = False, size: int = SIZE) -> DataFrame:
    """``node, split_feature, feature, k, median_onward, mad_before, mad_onward`` for cuts 0 .. n."""
    if wide:
        return wide_mad_scan(along, size)

    def each(key, pdf: pd.DataFrame) -> pd.DataFrame:
        _, values, names = _table(pdf)
        out = []
        for j, name in enumerate(names):
            before = kernel.running(values[:, j])[1]
            meds, mads = (x[::-1] for x in kernel.running(values[::-1, j]))
            out.append(pd.DataFrame({"node": key[0], "split_feature": key[1], "feature": name, "k": np.arange(len(before)), "median_onward": meds, "mad_before": before, "mad_onward": mads}))
        return pd.concat(out)

    return _groups(along, f"node {along.schema['node'].dataType.simpleString()}, split_feature string, feature string, k int, median_onward double, mad_before double, mad_onward double", each)


def mad_gains(scan: DataFrame) -> DataFrame:
    """How far the MAD and the MAD over the median of what remains have fallen since the first cut; not below 0."""
    w = Window.partitionBy("node", "split_feature", "feature").orderBy("k")
    cov = F.when(F.col("median_onward") != 0, F.abs(F.col("mad_onward") / F.col("median_onward"))).otherwise(0.0)
    d = scan.withColumn("cov_onward", cov)
    return d.select("node", "split_feature", "feature", "k", F.greatest(F.first("mad_onward").over(w) - F.col("mad_onward"), F.lit(0.0)).alias("mad_gain"), "cov_onward", (F.first("cov_onward").over(w) - F.col("cov_onward")).alias("cov_gain"))


def wide_scores(along: DataFrame, mode: str, norm: str, weights: dict[str, float], size: int) -> DataFrame:
    """As ``split_scores``, from scans that leave a node's cells spread over tasks."""
    along = along.checkpoint()
    if mode == "variance":
        sides = variance_scan(along).select("node", "split_feature", "feature", "k", "before", "onward")
    else:
        sides = wide_mad_scan(along, size).select("node", "split_feature", "feature", "k", F.col("mad_before").alias("before"), F.col("mad_onward").alias("onward"))
    draws = along.select("node", "split_feature", "k", "n", "split_value").distinct()
    at = sides.join(draws, ["node", "split_feature", "k"])
    whole = F.col("n") + 1
    d = F.col("onward") * ((whole - F.col("k")) / whole) + F.col("before") * ((F.col("k") + 1) / whole)
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.create_map().cast("map<string,double>")
    w = F.when(F.col("feature") == F.col("split_feature"), 0.0).otherwise(F.coalesce(F.get(F.array(known[F.col("feature")]), F.lit(0)), F.lit(1.0)))
    at = at.withColumn("w", w).withColumn("x", F.col("w") * (d if norm == "l1" else d * d))
    # Added up by feature, so that the sum is the same whatever the order of rows.
    rows = at.groupBy("node", "split_feature", "k").agg(F.first("n").alias("n"), F.first("split_value").alias("split_value"), F.array_sort(F.collect_list(F.struct("feature", "x", "w"))).alias("all"))
    total = lambda field: F.aggregate("all", F.lit(0.0), lambda s, e: F.when(e["w"] == 0, s).otherwise(s + e[field]))
    score = F.try_divide(total("x"), total("w"))
    fine = ~F.isnan(score) & (F.abs(score) < float("inf")) & ((score == 0) | (F.abs(score) >= LEAST_NORMAL))
    return rows.select("node", "split_feature", F.col("k").cast("int").alias("k"), "n", "split_value", F.when(fine, score).otherwise(F.lit(float("inf"))).alias("score"))


def split_scores(along: DataFrame, mode: str = "mad", norm: str = "l1", weights: dict[str, float] | None = None, wide: bool = False, size: int = SIZE) -> DataFrame:
    """``node, split_feature, k, n, split_value, score`` of cuts 0 .. n - 1.

    The score sums the outputs' dispersions on both sides, weighted by how much lies on
    each; an input that is an output too has weight 0 in its own scan.
    """
    weights = dict(weights or {})
    if wide:
        return wide_scores(along, mode, norm, weights, size)

    def each(key, pdf: pd.DataFrame) -> pd.DataFrame:
        draws, values, names = _table(pdf)
        w = np.array([0.0 if name == key[1] else weights.get(name, 1.0) for name in names])
        scores = kernel.cut_scores(values, w, mode, norm)
        return pd.DataFrame({"node": key[0], "split_feature": key[1], "k": draws["k"].to_numpy(), "n": draws["n"].to_numpy(), "split_value": draws["split_value"].to_numpy(), "score": scores[: len(draws)]})

    return _groups(along, f"node {along.schema['node'].dataType.simpleString()}, split_feature string, k int, n long, split_value double, score double", each)


def best_cuts(scores: DataFrame, sizes: DataFrame, best: str = "min") -> DataFrame:
    """The best cut of each input: ``node, split_feature, k, split_value, score``.

    Cuts 3 to n - 3; the least score, of equal ones the largest k; then times how many
    samples lack a value, plus 1. ``best="max"`` takes the largest, of equal ones the
    first k, times how many have a value. ``sizes``: ``node, samples``.
    """
    inner = scores.filter((F.col("k") >= EDGE) & (F.col("k") <= F.col("n") - EDGE))
    if best == "max":
        value = F.when(F.col("score") < float("inf"), F.col("score")).otherwise(0.0)
        pick, factor = F.max_by(F.struct("k", "split_value", "n", value.alias("score")), F.struct(value, -F.col("k"))), F.col("b.n")
    else:
        pick, factor = F.min_by(F.struct("k", "split_value", "n", "score"), F.struct("score", -F.col("k"))), F.col("samples") - F.col("b.n") + 1
    out = inner.groupBy("node", "split_feature").agg(pick.alias("b")).join(sizes, "node")
    return out.select("node", "split_feature", F.col("b.k").alias("k"), F.col("b.split_value").alias("split_value"), (F.col("b.score") * factor).alias("score"))


def best_split(cuts: DataFrame) -> DataFrame:
    """The best input of each node, of equal ones the first by name. Nodes without a cut are absent: they are leaves."""
    return cuts.filter(F.col("score") < float("inf")).groupBy("node").agg(F.min_by(F.struct("split_feature", "k", "split_value", "score"), F.struct("score", "split_feature")).alias("b")).select("node", "b.*")


def children(inputs: DataFrame, splits: DataFrame, wide: bool = False, size: int = SIZE) -> DataFrame:
    """``node, side, sample_id`` after the split: draws before k left, the others right; samples without a value in neither."""
    chosen = splits.select("node", F.col("split_feature").alias("feature"))
    order = draw_order(inputs.join(chosen, ["node", "feature"], "left_semi"), wide, size).select("node", "split_feature", "sample_id", F.col("k").alias("at"))
    both = order.join(splits.select("node", "split_feature", "k"), ["node", "split_feature"])
    return both.select("node", F.when(F.col("at") < F.col("k"), "L").otherwise("R").alias("side"), "sample_id")


def route_by_value(inputs: DataFrame, splits: DataFrame) -> DataFrame:
    """``node, side, sample_id`` by the value alone, as prediction does: at most the split's left."""
    own = inputs.filter("value is not null").select("node", F.col("feature").alias("split_feature"), "sample_id", "value")
    both = own.join(splits.select("node", "split_feature", "split_value"), ["node", "split_feature"])
    return both.select("node", F.when(F.col("value") > F.col("split_value"), "R").otherwise("L").alias("side"), "sample_id")


__all__ = ["best_cuts", "best_split", "children", "draw_order", "drawn", "is_wide", "mad_gains", "mad_scan", "route_by_value", "split_scores", "variance_scan", "wide_mad_scan"]
