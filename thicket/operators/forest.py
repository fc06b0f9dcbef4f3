"""Growing forests: one task grows one tree from its own subsample.

A tree sees an exact number of samples, input features and output features, so what a
task holds is bounded by the parameters, not by the matrix. Trees come out as rows of a
flat node table, which every later question is asked of.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions.numeric import LEAST_NORMAL
from thicket.operators import kernel
from thicket.operators.matrix import dropped
from thicket.operators.sampling import draw
from thicket.plans.parameters import Parameters

NODE_SQL = (
    "tree_id int, epoch int, node_id string, parent_id string, depth int, side string, split_feature string, split_value double, is_leaf boolean, n_samples long, "
    "samples array<string>, features array<string>, medians array<double>, dispersions array<double>, weights array<double>, local_gains array<double>, absolute_gains array<double>"
)
ROOT = "RT"


def split_mode(tree: int, mode: str, seed: int) -> str:
    """The dispersion of a tree: of mixed forests six trees in ten use the MAD."""
    if mode != "mixed":
        return mode
    return "mad" if np.random.default_rng([seed, tree]).random() < 0.6 else "variance"


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    q = np.divide(a, b, out=np.zeros(len(a)), where=b != 0)
    return np.where(np.isfinite(q) & (np.abs(q) >= LEAST_NORMAL), q, 0.0)


def dispersions(values: np.ndarray, mode: str) -> tuple[np.ndarray, np.ndarray]:
    """Median and dispersion of each column; NaN values don't count, and nothing has 0."""
    meds, disp = np.zeros(values.shape[1]), np.zeros(values.shape[1])
    for j in range(values.shape[1]):
        x = np.sort(values[~np.isnan(values[:, j]), j])
        meds[j] = kernel.middle(x.tolist())
        disp[j] = kernel.deviation(x.tolist(), meds[j]) if mode == "mad" else float(x.var()) if len(x) else 0.0
    return meds, disp


class Grower:
    """Grows one tree over matrices samples x features with NaN for missing cells."""

    def __init__(self, samples: list[str], inputs: np.ndarray, outputs: np.ndarray, in_names: list[str], out_names: list[str], weights: np.ndarray, leaf_size: int, mode: str, norm: str) -> None:
        self.samples, self.inputs, self.outputs, self.in_names, self.out_names = samples, inputs, outputs, in_names, out_names
        self.weights, self.leaf_size, self.mode, self.norm = weights, leaf_size, mode, norm
        self.rows: list[dict] = []

    def best(self, own: np.ndarray) -> tuple[str, float, np.ndarray, np.ndarray] | None:
        """(feature, value, left, right): the least score over inputs, of equal ones the first input."""
        found = None
        for j, name in enumerate(self.in_names):
            x = self.inputs[own, j]
            draws = own[~np.isnan(x)]
            if len(draws) < 6:
                continue
            draws = draws[np.argsort(self.inputs[draws, j], kind="stable")]
            w = np.where(np.array(self.out_names) == name, 0.0, self.weights)
            scores = kernel.cut_scores(self.outputs[draws], w, self.mode, self.norm)
            k = kernel.best_cut(scores)
            if k is None or not np.isfinite(scores[k]):
                continue
            score = scores[k] * (len(own) - len(draws) + 1)
            if found is None or score < found[0]:
                found = score, name, float(self.inputs[draws[k], j]), np.sort(draws[:k]), np.sort(draws[k:])
        return found[1:] if found else None

    def grow(self) -> list[dict]:
        every = np.arange(len(self.samples))
        todo = [(ROOT, None, 0, None, every, None)]
        root = None
        while todo:
            node, parent, depth, side, own, above = todo.pop()
            meds, disp = dispersions(self.outputs[own], self.mode)
            cov = ratio(disp, meds)
            root = cov if root is None else root
            cut = self.best(own) if len(own) > self.leaf_size else None
            self.rows.append(
                {"node_id": node, "parent_id": parent, "depth": depth, "side": side, "split_feature": cut and cut[0], "split_value": cut[1] if cut else None, "is_leaf": cut is None, "n_samples": len(own), "samples": [self.samples[i] for i in own],
                 "features": self.out_names, "medians": meds.tolist(), "dispersions": disp.tolist(), "weights": self.weights.tolist(), "local_gains": None if above is None else (above - cov).tolist(), "absolute_gains": None if above is None else (root - cov).tolist()}
            )
            if cut:
                base = f"{node}!F{cut[0]}:S{cut[1]}"
                todo += [(base + "R", node, depth + 1, "R", cut[3], cov), (base + "L", node, depth + 1, "L", cut[2], cov)]
        return self.rows


def _subset(matrix: DataFrame, trees: DataFrame, p: Parameters) -> DataFrame:
    """``tree_id, role, sample_id, feature, value`` of each tree's subsample."""
    samples = matrix.select("sample_id").distinct()
    features = matrix.select("feature").distinct()
    drawn = draw(trees, samples, p.sample_sub, "tree_id", "sample_id", p.seed)
    roles = [draw(trees, features, k, "tree_id", "feature", p.seed + 1 + i).withColumn("role", F.lit(r)) for i, (r, k) in enumerate((("in", p.in_features), ("out", p.out_features)))]
    picked = roles[0].unionByName(roles[1])
    return matrix.join(drawn, "sample_id").join(picked, ["tree_id", "feature"])


def grown(cells: DataFrame, p: Parameters, weights: DataFrame | None = None, epoch: int = 0) -> DataFrame:
    """The node table of trees whose subsamples are ``tree_id, role, sample_id, feature, value``.

    ``weights`` has ``feature, weight`` of the outputs; missing ones weigh 1.
    """
    if weights is not None:
        cells = cells.join(weights.select("feature", "weight"), "feature", "left")
    else:
        cells = cells.withColumn("weight", F.lit(1.0))
    columns = [c.split()[0] for c in NODE_SQL.split(", ")]

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        by = {r: pdf[pdf["role"] == r] for r in ("in", "out")}
        names = sorted(pdf["sample_id"].unique())
        tables, cols = {}, {}
        for r, part in by.items():
            wide = part.pivot_table(index="sample_id", columns="feature", values="value", aggfunc="first", dropna=False).reindex(names)
            tables[r], cols[r] = wide.to_numpy(float), [str(c) for c in wide.columns]
        w = by["out"].drop_duplicates("feature").set_index("feature")["weight"].reindex(cols["out"]).fillna(1.0).to_numpy(float)
        rows = Grower([str(s) for s in names], tables["in"], tables["out"], cols["in"], cols["out"], w, p.leaf_size, split_mode(tree, p.split, p.seed), p.norm).grow()
        return pd.DataFrame([{"tree_id": tree, "epoch": epoch, **r} for r in rows], columns=columns)

    return cells.select("tree_id", "role", "sample_id", "feature", "value", "weight").groupBy("tree_id").applyInPandas(one, NODE_SQL)


def fit(matrix: DataFrame, p: Parameters, prototype: bool = False) -> DataFrame:
    """A forest of ``p.trees`` trees over a raw long matrix; with ``prototype`` also tree 0, a bare root.

    Trees are tasks of their own; the matrix is read once for all of them.
    """
    spark: SparkSession = matrix.sparkSession
    # Missing cells stay as NULL rows here, so that a sample without any value can be drawn.
    full = matrix.join(dropped(matrix, p.drop).select("sample_id", "feature", F.col("value").alias("kept")), ["sample_id", "feature"], "left").select("sample_id", "feature", F.col("kept").alias("value"))
    trees = spark.range(1, p.trees + 1).select(F.col("id").cast("int").alias("tree_id"))
    out = grown(_subset(full, trees, p), p)
    return out.unionByName(root_only(full, p)) if prototype else out


def fit_levels(cells: DataFrame, leaf_size: int, depth: int, mode: str = "mad", norm: str = "l1", most: int | None = None, size: int | None = None) -> DataFrame:
    """Trees over whole tables, all of them a level at a time: for nodes that are too large for one task's tree.

    ``cells`` has ``tree_id, sample_id, feature, value`` of each tree's samples; all
    features are inputs and outputs. Draws, scores and cuts are those of the split scans:
    a level whose nodes have ``most`` cells at most runs a node and input in a task, one
    with a larger node leaves cells spread over tasks of about ``size``. Nodes are named by
    their sides from the root (RT, RTL, RTLR, ..); those of ``leaf_size`` samples or fewer, at
    ``depth``, or without a valid cut are leaves. A node's row lists its samples if it has
    no more than ``most`` cells; else ``samples`` is null, for a row couldn't hold them.
    Each level is cut off in the shared folder.
    """
    from thicket.operators import scan

    most, size = most or scan.TASK_CELLS, size or scan.SIZE
    from thicket.operators.stats import summary

    key = ["tree_id", "node_id"]
    at = cells.select("tree_id", F.lit(ROOT).alias("node_id"), "sample_id", "feature", "value")
    kept, out = ["node", *key, "sample_id", "feature", "value"], None
    for level in range(depth + 1):
        at = at.withColumn("node", F.concat_ws("/", *key)).select(*kept).checkpoint()
        wide, listed = scan.is_wide(at, most), F.array_sort(F.collect_set(F.col("sample_id").cast("string"))).alias("samples")
        if wide:
            counts = at.select("node", *key, "sample_id").distinct().groupBy("node", *key).agg(F.count(F.lit(1)).alias("n_samples"))
            small = at.groupBy("node").agg(F.count(F.lit(1)).alias("cells")).filter(F.col("cells") <= most).select("node")
            members = counts.join(at.join(small, "node", "left_semi").groupBy("node").agg(listed), "node", "left")
        else:
            members = at.groupBy("node", *key).agg(listed).withColumn("n_samples", F.size("samples").cast("long"))
        disp = F.col("mad") if mode == "mad" else F.col("var_pop")
        own = at.select(*key, "feature").distinct().join(summary(at, [*key, "feature"]), [*key, "feature"], "left")
        own = own.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("feature", F.coalesce("median", F.lit(0.0)).alias("m"), F.coalesce(disp, F.lit(0.0)).alias("d")))).alias("x"))
        cut = at.sparkSession.createDataFrame([], "node string, split_feature string, k int, split_value double, score double")
        if level < depth:
            inner = at.join(members.filter(F.col("n_samples") > leaf_size).select("node"), "node", "left_semi")
            scores = scan.split_scores(scan.drawn(inner, inner, wide, size), mode, norm, wide=wide, size=size)
            cut = scan.best_split(scan.best_cuts(scores, members.select("node", F.col("n_samples").alias("samples")))).checkpoint()
            at_next = at.join(scan.children(inner, cut, wide, size), ["node", "sample_id"]).withColumn("node_id", F.concat("node_id", "side")).drop("node", "side")
        rows = members.join(own, key).join(cut.select("node", "split_feature", "split_value"), "node", "left")
        parent = F.when(F.lit(level > 0), F.substring("node_id", 1, len(ROOT) + level - 1))
        side = F.when(F.lit(level > 0), F.substring("node_id", len(ROOT) + level, 1))
        values = {
            "epoch": F.lit(0), "parent_id": parent, "depth": F.lit(level), "side": side, "is_leaf": F.col("split_feature").isNull(), "features": F.col("x.feature"), "medians": F.col("x.m"), "dispersions": F.col("x.d"), "weights": F.transform("x", lambda _: F.lit(1.0)),
            "local_gains": F.lit(None), "absolute_gains": F.lit(None),
        }
        rows = rows.select(*[values.get(n, F.col(n)).cast(t).alias(n) for n, t in (c.split() for c in NODE_SQL.split(", "))]).checkpoint()
        out = rows if out is None else out.unionByName(rows)
        if level < depth:
            at = at_next
    return with_gains(out).checkpoint()


def with_gains(nodes: DataFrame) -> DataFrame:
    """The node table with the gains of its own dispersions in it."""
    ordered = F.struct(F.col("feature"), "local_gain", "absolute_gain")
    g = gains(nodes).groupBy("tree_id", "node_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", ordered))).alias("g"))
    full = nodes.drop("local_gains", "absolute_gains").join(g, ["tree_id", "node_id"])
    known = F.col("parent_id").isNotNull()
    for name in ("local_gain", "absolute_gain"):
        full = full.withColumn(f"{name}s", F.when(known, F.transform("features", lambda f: F.col("g")[f][name])))  # noqa: B023
    return full.select(*[c.split()[0] for c in NODE_SQL.split(", ")])


def root_only(matrix: DataFrame, p: Parameters) -> DataFrame:
    """The prototype: one root over all samples and features, not split."""
    from thicket.operators.stats import summary

    s = summary(matrix)
    disp = F.col("mad") if p.split != "variance" else F.coalesce("var_pop", F.lit(0.0))
    rows = s.agg(F.array_sort(F.collect_list(F.struct("feature", "median", disp.alias("d")))).alias("x"))
    n = matrix.select("sample_id").distinct().agg(F.count(F.lit(1)).alias("n_samples"), F.array_sort(F.collect_list(F.col("sample_id").cast("string"))).alias("samples"))
    values = {
        "tree_id": F.lit(0), "epoch": F.lit(0), "node_id": F.lit(ROOT), "parent_id": F.lit(None), "depth": F.lit(0), "side": F.lit(None), "split_feature": F.lit(None), "split_value": F.lit(None), "is_leaf": F.lit(True), "n_samples": F.col("n_samples"), "samples": F.col("samples"),
        "features": F.col("x.feature"), "medians": F.col("x.median"), "dispersions": F.col("x.d"), "weights": F.transform("x", lambda _: F.lit(1.0)), "local_gains": F.lit(None), "absolute_gains": F.lit(None),
    }
    return rows.crossJoin(n).select(*[values[c.split()[0]].cast(c.split()[1]).alias(c.split()[0]) for c in NODE_SQL.split(", ")])


def leaf_features(nodes: DataFrame) -> DataFrame:
    """One row a node and output feature, with its coefficient of variation."""
    from thicket.functions.numeric import safe_ratio

    z = F.explode(F.arrays_zip("features", "medians", "dispersions", "weights", F.coalesce("local_gains", F.array()).alias("local_gains"), F.coalesce("absolute_gains", F.array()).alias("absolute_gains"))).alias("z")
    return nodes.select("tree_id", "epoch", "node_id", "parent_id", "depth", "is_leaf", z).select(
        "tree_id", "epoch", "node_id", "parent_id", "depth", "is_leaf", F.col("z.features").alias("feature"), F.col("z.medians").alias("median"), F.col("z.dispersions").alias("dispersion"), F.col("z.weights").alias("weight"),
        safe_ratio(F.col("z.dispersions"), F.col("z.medians")).alias("cov"), F.col("z.local_gains").alias("local_gain"), F.col("z.absolute_gains").alias("absolute_gain"),
    )


def gains(nodes: DataFrame) -> DataFrame:
    """Local gains (parent less node) and absolute gains (root less node), from the table's own dispersions."""
    lf = leaf_features(nodes).select("tree_id", "epoch", "node_id", "parent_id", "feature", "cov")
    up = lf.select("tree_id", "epoch", F.col("node_id").alias("parent_id"), "feature", F.col("cov").alias("above"))
    root = lf.filter(F.col("node_id") == ROOT).select("tree_id", "epoch", "feature", F.col("cov").alias("root"))
    keys = ["tree_id", "epoch", "feature"]
    return lf.join(up, [*keys, "parent_id"], "left").join(root, keys, "left").select("tree_id", "epoch", "node_id", "feature", (F.col("above") - F.col("cov")).alias("local_gain"), F.when(F.col("node_id") != ROOT, F.col("root") - F.col("cov")).alias("absolute_gain"))
