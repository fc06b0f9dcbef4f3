"""Boosting: epochs of trees, each over what the epochs before left unexplained."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.functions.numeric import DropMode
from thicket.operators import matrix as mx
from thicket.operators.forest import grown, leaf_features
from thicket.operators.predict import predict
from thicket.operators.sampling import draw
from thicket.plans.parameters import Parameters


def draw_features(names: list[str], inputs: int, outputs: int, similarity: dict[tuple[str, str], float], seed: int) -> tuple[list[str], list[str]]:
    """Inputs first, then outputs among the rest; each output drawn makes those like it likelier."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(names))
    chosen = [names[i] for i in order[:inputs]]
    left = {n: 1.0 for n in names if n not in chosen}
    out: list[str] = []
    while left and len(out) < outputs:
        keys = sorted(left)
        w = np.array([left[k] for k in keys])
        if w.sum() <= 0:
            break
        pick = keys[int(rng.choice(len(keys), p=w / w.sum()))]
        out.append(pick)
        del left[pick]
        for k in left:
            left[k] = max(left[k] * (1 + similarity.get((pick, k), 0.0) / 2), 0.0)
    return chosen, out


def gain_correlation(nodes: DataFrame, gain: str = "local_gain") -> DataFrame:
    """``tree_id, f1, f2, corr``: how gains of output features go together over a tree's leaves; 0 where one is constant."""
    lf = leaf_features(nodes.filter("is_leaf")).select("tree_id", "node_id", "feature", F.coalesce(gain, F.lit(0.0)).alias("g"))
    a, b = lf.select("tree_id", "node_id", F.col("feature").alias("f1"), F.col("g").alias("x")), lf.select("tree_id", "node_id", F.col("feature").alias("f2"), F.col("g").alias("y"))
    sums = a.join(b, ["tree_id", "node_id"]).groupBy("tree_id", "f1", "f2").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg(F.col("x") * F.col("y")).alias("mxy"), F.avg(F.col("x") * F.col("x")).alias("mxx"), F.avg(F.col("y") * F.col("y")).alias("myy"))
    spread = F.sqrt(F.greatest(F.col("mxx") - F.col("mx") * F.col("mx"), F.lit(0.0)) * F.greatest(F.col("myy") - F.col("my") * F.col("my"), F.lit(0.0)))
    flat = (F.col("mxx") - F.col("mx") * F.col("mx") <= 1e-12 * F.col("mxx")) | (F.col("myy") - F.col("my") * F.col("my") <= 1e-12 * F.col("myy"))
    return sums.select("tree_id", "f1", "f2", F.when(flat, 0.0).otherwise(F.coalesce(F.try_divide(F.col("mxy") - F.col("mx") * F.col("my"), spread), F.lit(0.0))).alias("corr"))


def similarity(nodes: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """``f1, f2, corr``: the mean correlation over all trees so far; pairs not seen keep what they had."""
    now = gain_correlation(nodes).groupBy("f1", "f2").agg(F.avg("corr").alias("corr"))
    if before is None:
        return now
    return now.withColumnRenamed("corr", "new").join(before, ["f1", "f2"], "full").select("f1", "f2", F.coalesce("new", "corr").alias("corr"))


def residuals(truth: DataFrame, prediction: DataFrame) -> DataFrame:
    return mx.combine(truth, prediction, "subtract")


def epoch_trees(nodes: DataFrame, epoch: int, duration: int, as_built: bool = False) -> DataFrame:
    """The trees of an epoch, or the narrower slice by place that was first built."""
    if not as_built:
        return nodes.filter(F.col("epoch") == epoch)
    first, last = epoch * duration, (epoch + 1) * duration - (epoch + 1)
    return nodes.filter((F.col("tree_id") > first) & (F.col("tree_id") <= last))


class Boosted:
    """``nodes`` of all epochs, the last ``error`` matrix, and each epoch's ``predictions`` and ``similarities``."""

    def __init__(self, matrix: DataFrame, p: Parameters) -> None:
        self.matrix, self.p = matrix, p
        self.truth = mx.filled(matrix, 0.0).drop("value").join(mx.dropped(matrix, p.drop), ["sample_id", "feature"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
        self.truth = self.truth.checkpoint()
        self.error = self.truth if p.boost == "additive" else mx.filled(self.truth, 1.0)
        self.nodes: DataFrame | None = None
        self.similarities: list[DataFrame] = []
        self.predictions: list[DataFrame] = []

    @property
    def similarity(self) -> DataFrame | None:
        """That of the last epoch."""
        return self.similarities[-1] if self.similarities else None

    def weights(self, epoch: int, names: list[str]) -> dict[str, DataFrame]:
        """Sampling weights of inputs, outputs and samples: all 1."""
        spark = self.matrix.sparkSession
        one = spark.createDataFrame([(epoch, n, 1.0) for n in names], "epoch int, feature string, weight double")
        samples = self.truth.select(F.lit(epoch).alias("epoch"), "sample_id", F.lit(1.0).alias("weight")).distinct()
        return {"inputs": one, "outputs": one, "samples": samples}

    def grow(self, epoch: int) -> DataFrame:
        """An epoch's trees: outputs are weighed by the size of the sums of their errors.

        As first built the sums kept their sign, so that an output that was predicted too
        high made splits look for dispersion.
        """
        p, spark = self.p, self.matrix.sparkSession
        names = sorted(r[0] for r in self.truth.select("feature").distinct().collect())  # the matrix's width
        like = {} if self.similarity is None else {(r["f1"], r["f2"]): r["corr"] for r in self.similarity.collect()}  # width squared
        rows = []
        for i in range(p.epoch_duration):
            tree = epoch * p.epoch_duration + i + 1
            ins, outs = draw_features(names, p.in_features, p.out_features, like, p.seed * 7919 + tree)
            rows += [(tree, f, "in") for f in ins] + [(tree, f, "out") for f in outs]
        picked = spark.createDataFrame(rows, "tree_id int, feature string, role string")
        trees = picked.select("tree_id").distinct()
        drawn = draw(trees, self.truth.select("sample_id").distinct(), p.sample_sub, "tree_id", "sample_id", p.seed + epoch)
        raw = self.truth.withColumn("value", F.when(F.col("value") != 0, F.col("value"))) if p.drop is DropMode.ZEROS else self.truth
        out = self.error if p.boost == "additive" else raw
        cells = raw.join(F.broadcast(picked.filter("role = 'in'")), "feature").unionByName(out.join(F.broadcast(picked.filter("role = 'out'")), "feature"))
        weights = self.error.groupBy("feature").agg(F.abs(F.sum("value")).alias("weight"))
        return grown(cells.join(drawn, ["tree_id", "sample_id"]), p, weights, epoch).checkpoint()

    def run(self) -> Boosted:
        """Grow, predict, take the error and the similarity, epoch by epoch; each epoch's tables are cut off in the shared folder."""
        for epoch in range(self.p.epochs):
            nodes = self.grow(epoch)
            self.nodes = nodes if self.nodes is None else self.nodes.unionByName(nodes).checkpoint()
            got = predict(nodes, self.matrix, self.p.prediction, self.p.averaging, self.p.weighing, self.p.drop).withColumn("epoch", F.lit(epoch)).checkpoint()
            self.predictions.append(got)
            base = self.error if self.p.boost == "additive" else self.truth
            self.error = residuals(base, got.drop("epoch")).checkpoint()
            self.similarities.append(similarity(self.nodes, self.similarity).checkpoint())
        return self

    def predict(self) -> DataFrame:
        """Additive: the sum of the epochs. Subsampling: one prediction by all trees."""
        if self.p.boost == "additive":
            every = self.predictions[0]
            for x in self.predictions[1:]:
                every = every.unionByName(x)
            return every.groupBy("sample_id", "feature").agg(F.sum("value").alias("value"))
        return predict(self.nodes, self.matrix, self.p.prediction, self.p.averaging, self.p.weighing, self.p.drop)
