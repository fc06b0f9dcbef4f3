"""Questions about a fitted forest, asked of its node table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.numeric import safe_ratio
from thicket.operators import stats
from thicket.operators.forest import ROOT, leaf_features


def ancestors(nodes: DataFrame) -> DataFrame:
    """``tree_id, node_id, ancestor_id, distance``: each node with itself and all above it.

    Doubles the distance a step, so a tree of depth d takes log2(d) joins.
    """
    one = nodes.filter("parent_id is not null").select("tree_id", "node_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("distance"))
    depth = nodes.agg(F.max("depth")).first()[0] or 0
    known, span = one.checkpoint(), 1
    while span < depth:
        a = known.filter(F.col("distance") == span).select("tree_id", "node_id", F.col("ancestor_id").alias("mid"))
        b = known.select("tree_id", F.col("node_id").alias("mid"), "ancestor_id", (F.col("distance") + span).alias("distance"))
        known = known.unionByName(a.join(b, ["tree_id", "mid"]).select("tree_id", "node_id", "ancestor_id", "distance")).checkpoint()
        span *= 2
    return known.unionByName(nodes.select("tree_id", "node_id", F.col("node_id").alias("ancestor_id"), F.lit(0).alias("distance")))


def requirements(nodes: DataFrame) -> DataFrame:
    """``tree_id, node_id, feature, split_value, sign``: what a sample must satisfy to reach a node."""
    up = ancestors(nodes).filter("distance < 1000000")
    step = nodes.filter("parent_id is not null").select("tree_id", F.col("node_id").alias("ancestor_id"), "parent_id", "side")
    top = nodes.select("tree_id", F.col("node_id").alias("parent_id"), "split_feature", "split_value")
    return up.join(step, ["tree_id", "ancestor_id"]).join(top, ["tree_id", "parent_id"]).select("tree_id", "node_id", F.col("split_feature").alias("feature"), "split_value", F.when(F.col("side") == "L", "<").otherwise(">").alias("sign"))


def requirement_paths(nodes: DataFrame) -> DataFrame:
    """``tree_id, node_id, path``: the requirements in a line, by feature."""
    text = F.concat("feature", "sign", F.col("split_value").cast("string"))
    got = requirements(nodes).groupBy("tree_id", "node_id").agg(F.array_join(F.array_sort(F.collect_list(text)), ";").alias("path"))
    return nodes.select("tree_id", "node_id").join(got, ["tree_id", "node_id"], "left").select("tree_id", "node_id", F.coalesce("path", F.lit("")).alias("path"))


def to_depth(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.filter(F.col("depth") <= depth)


def leaves_at(nodes: DataFrame, depth: int) -> DataFrame:
    """The leaves of the forest cut off at a depth."""
    return nodes.filter((F.col("depth") == depth) | (F.col("is_leaf") & (F.col("depth") < depth)))


def above_leaves(nodes: DataFrame) -> DataFrame:
    """Inner nodes whose children are all leaves."""
    inner = nodes.filter("not is_leaf and parent_id is not null").select("tree_id", F.col("parent_id").alias("node_id")).distinct()
    return nodes.filter("not is_leaf").join(inner, ["tree_id", "node_id"], "left_anti")


def feature_levels(nodes: DataFrame) -> DataFrame:
    """``feature, levels, frequency, score``: the levels (root 1) at which each feature splits, how often, and the sum of 5 / level."""
    own = nodes.filter("not is_leaf").select(F.col("split_feature").alias("feature"), (F.col("depth") + 1).alias("level"))
    return own.groupBy("feature").agg(F.array_sort(F.collect_list("level")).alias("levels"), F.count(F.lit(1)).alias("frequency"), F.sum(5.0 / F.col("level")).alias("score"))


def top(df: DataFrame, column: str, k: int, largest: bool = True) -> DataFrame:
    return df.orderBy(F.desc(column) if largest else F.asc(column), *[c for c in df.columns if c != column and not c.endswith("s")]).limit(k)


def gain_pairs(nodes: DataFrame, gain: str = "local_gain") -> DataFrame:
    """``split_feature, feature, n, gain``: the mean gain of each output in the children of each splitting feature."""
    kids = leaf_features(nodes).filter("parent_id is not null").select("tree_id", "parent_id", "feature", F.col(gain).alias("g"))
    if gain == "absolute_gain":
        kids = leaf_features(nodes.filter("is_leaf and parent_id is not null")).select("tree_id", "parent_id", "feature", F.col("absolute_gain").alias("g"))
    up = nodes.select("tree_id", F.col("node_id").alias("parent_id"), "split_feature")
    return kids.join(up, ["tree_id", "parent_id"]).groupBy("split_feature", "feature").agg(F.count("g").alias("n"), F.avg("g").alias("gain"))


def strong_pairs(pairs: DataFrame, least: float = 0.3) -> DataFrame:
    return pairs.filter(F.col("gain") > least)


def root_leaf(nodes: DataFrame) -> DataFrame:
    """``tree_id, feature, root_cov, leaf_cov, gain``: dispersion at the root and over the leaves, by their mean, and the total gain."""
    lf = leaf_features(nodes)
    leaves = lf.filter("is_leaf").groupBy("tree_id", "feature").agg(F.avg("cov").alias("leaf_cov"))
    root = lf.filter(F.col("node_id") == ROOT).select("tree_id", "feature", F.col("cov").alias("root_cov"))
    return root.join(leaves, ["tree_id", "feature"]).select("tree_id", "feature", "root_cov", "leaf_cov", (F.col("root_cov") - F.col("leaf_cov")).alias("gain"))


def membership(nodes: DataFrame) -> DataFrame:
    """``tree_id, node_id, sample_id``: the samples of each node; the boolean matrix in its sparse form."""
    return nodes.select("tree_id", "node_id", F.explode("samples").alias("sample_id"))


def median_matrix(nodes: DataFrame) -> DataFrame:
    """``tree_id, node_id, feature, median``."""
    return leaf_features(nodes).select("tree_id", "node_id", "feature", "median")


def gain_vectors(nodes: DataFrame, features: list[str], gain: str = "absolute_gain") -> DataFrame:
    """A row a node, a column a feature: its gains."""
    return leaf_features(nodes).groupBy("tree_id", "node_id").pivot("feature", features).agg(F.first(gain))


def cooccurrence(nodes: DataFrame) -> DataFrame:
    """``f1, f2, trees, covariance``: of how often two features split in the same tree, over all trees, zeros included."""
    counts = nodes.filter("not is_leaf").groupBy("tree_id", F.col("split_feature").alias("f")).agg(F.count(F.lit(1)).alias("n"))
    trees = nodes.select("tree_id").distinct().count()
    a, b = counts.select("tree_id", F.col("f").alias("f1"), F.col("n").alias("x")), counts.select("tree_id", F.col("f").alias("f2"), F.col("n").alias("y"))
    both = a.join(b, "tree_id").groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("trees"), F.sum(F.col("x") * F.col("y")).alias("xy"))
    sums = counts.groupBy("f").agg(F.sum("n").alias("s"))
    out = both.join(sums.select(F.col("f").alias("f1"), F.col("s").alias("sx")), "f1").join(sums.select(F.col("f").alias("f2"), F.col("s").alias("sy")), "f2")
    return out.select("f1", "f2", "trees", ((F.col("xy") - F.col("sx") * F.col("sy") / trees) / max(trees - 1, 1)).alias("covariance"))


def jaccard_distances(nodes: DataFrame) -> DataFrame:
    """``a, b, distance`` of nodes that share a sample: 1 less shared over all samples; others have distance 1."""
    m = nodes.select(F.concat_ws("/", "tree_id", "node_id").alias("node"), F.explode("samples").alias("s"))
    sizes = nodes.select(F.concat_ws("/", "tree_id", "node_id").alias("node"), F.size("samples").alias("n"))
    shared = m.select(F.col("node").alias("a"), "s").join(m.select(F.col("node").alias("b"), "s"), "s").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"))
    out = shared.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", (1 - F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("distance"))


def clusters(distances: DataFrame, nodes: DataFrame, radius: float, least: int) -> DataFrame:
    """``node, cluster``: density clusters (DBSCAN) over Jaccard distances below 1; noise has a null cluster.

    Core nodes have ``least`` neighbours within the radius, themselves included; joined
    cores are one cluster, named by its least node, and border nodes join the least of theirs.
    """
    near = distances.filter(F.col("distance") <= radius)
    both = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    cores = both.groupBy("a").agg((F.count(F.lit(1)) + 1).alias("n")).filter(F.col("n") >= least).select(F.col("a").alias("core"))
    linked = both.join(cores, F.col("a") == F.col("core")).drop("core").join(cores, F.col("b") == F.col("core")).select("a", "b")
    label = cores.select(F.col("core").alias("node"), F.col("core").alias("cluster")).checkpoint()
    while True:
        step = linked.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("cluster").alias("other"))
        new = label.join(step, F.col("node") == F.col("a"), "left").select("node", F.least("cluster", F.coalesce("other", "cluster")).alias("cluster")).checkpoint()
        if not new.join(label.withColumnRenamed("cluster", "was"), "node").filter("cluster <> was").limit(1).count():
            break
        label = new
    border = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("cluster").alias("near"))
    names = nodes.select(F.concat_ws("/", "tree_id", "node_id").alias("n"))
    return names.join(label, F.col("n") == F.col("node"), "left").join(border, F.col("n") == F.col("a"), "left").select(F.col("n").alias("node"), F.coalesce("cluster", "near").alias("cluster"))


def principal_components(vectors: DataFrame, features: list[str], k: int) -> DataFrame:
    """Node vectors on their first k principal components."""
    from pyspark.ml.feature import PCA, VectorAssembler

    filled = vectors.fillna(0.0, features)
    x = VectorAssembler(inputCols=features, outputCol="vector").transform(filled)
    return PCA(k=k, inputCol="vector", outputCol="components").fit(x).transform(x).drop("vector")


def cluster_stats(nodes: DataFrame, labels: DataFrame, k: int = 20) -> DataFrame:
    """``cluster, nodes, trees, top_features``: sizes, how many trees, and the ``k`` outputs that gain most."""
    keyed = labels.filter("cluster is not null").join(nodes.withColumn("node", F.concat_ws("/", "tree_id", "node_id")), "node")
    size = keyed.groupBy("cluster").agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("tree_id").alias("trees"))
    g = leaf_features(keyed).join(keyed.select("tree_id", "node_id", "cluster"), ["tree_id", "node_id"]).groupBy("cluster", "feature").agg(F.avg("absolute_gain").alias("g"))
    w = Window.partitionBy("cluster").orderBy(F.desc("g"), "feature")
    best = g.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "feature"))), lambda x: x["feature"]).alias("top_features"))
    return size.join(best, "cluster", "left")


def requirement_frequency(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``cluster, feature, sign, n``: how often nodes of a cluster ask for a feature above or below."""
    keyed = labels.filter("cluster is not null").select(F.split("node", "/", 2)[0].cast("int").alias("tree_id"), F.split("node", "/", 2)[1].alias("node_id"), "cluster")
    return requirements(nodes).join(keyed, ["tree_id", "node_id"]).groupBy("cluster", "feature", "sign").agg(F.count(F.lit(1)).alias("n"))


def tree_histogram(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``cluster, tree_id, n``."""
    keyed = labels.filter("cluster is not null").select(F.split("node", "/", 2)[0].cast("int").alias("tree_id"), "cluster")
    return keyed.groupBy("cluster", "tree_id").agg(F.count(F.lit(1)).alias("n"))


def node_cells(nodes: DataFrame, matrix: DataFrame, tree_id: int, node_id: str) -> DataFrame:
    """The matrix's cells of a node's samples, in order of its split feature: ``pos, sample_id, feature, value``."""
    own = nodes.filter((F.col("tree_id") == tree_id) & (F.col("node_id") == node_id)).select("split_feature", F.explode("samples").alias("sample"))
    cells = matrix.join(F.broadcast(own), F.col("sample_id").cast("string") == F.col("sample")).drop("sample")  # one node
    at = cells.filter("feature = split_feature").select("sample_id", F.row_number().over(Window.orderBy("value", "sample_id")).alias("pos"))
    return cells.join(at, "sample_id").select("pos", "sample_id", "feature", "value")


def node_correlations(cells: DataFrame, feature: str) -> DataFrame:
    """``feature, r`` with one feature over a node's cells, from high to low."""
    return stats.correlations(cells.select("sample_id", "feature", "value")).filter(F.col("f1") == feature).select(F.col("f2").alias("feature"), "r").orderBy(F.desc("r"), "feature")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """``bin, n`` of equal widths; bin 0 lies below, bins + 1 above."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.expr(f"width_bucket({column}, {low}D, {high}D, {bins})").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def dispersion_values(nodes: DataFrame, where: str = "leaf") -> DataFrame:
    """``feature, dispersion`` of leaves, roots or all nodes."""
    keep = {"leaf": F.col("is_leaf"), "root": F.col("node_id") == ROOT, "all": F.lit(True)}[where]
    return leaf_features(nodes).filter(keep).select("feature", "dispersion")


def checked(nodes: DataFrame, matrix: DataFrame) -> DataFrame:
    """``tree_id, node_id, feature, median, dispersion, true_median, true_mad``: what nodes hold, and the same from the matrix."""
    own = membership(nodes)
    cells = own.join(matrix.withColumn("sample_id", F.col("sample_id").cast("string")), "sample_id")
    true = stats.summary(cells, ["tree_id", "node_id", "feature"]).select("tree_id", "node_id", "feature", F.col("median").alias("true_median"), F.col("mad").alias("true_mad"))
    return leaf_features(nodes).select("tree_id", "node_id", "feature", "median", "dispersion").join(true, ["tree_id", "node_id", "feature"], "left")


def interactions(nodes: DataFrame, matrix: DataFrame) -> DataFrame:
    """What a split gains below an ancestor beyond what it would have gained in the ancestor itself.

    ``tree_id, node_id, ancestor_id, feature, sign, split_value, ancestor_feature,
    ancestor_sign, ancestor_split, output, interaction``: each split is applied to the
    samples of every ancestor by value, and the children's gains are compared. Samples
    without a value are in neither child, as in growth.
    """
    up = ancestors(nodes).filter("distance > 0")
    split = nodes.filter("not is_leaf").select("tree_id", "node_id", "split_feature", "split_value")
    path = nodes.select("tree_id", F.col("node_id").alias("below"), F.col("parent_id").alias("ancestor_id"), "side")
    whole = ancestors(nodes).select("tree_id", "node_id", F.col("ancestor_id").alias("below"))
    sign = whole.join(path, ["tree_id", "below"]).select("tree_id", "node_id", "ancestor_id", F.when(F.col("side") == "L", "<").otherwise(">").alias("ancestor_sign"))
    asked = up.join(split, ["tree_id", "node_id"]).join(sign, ["tree_id", "node_id", "ancestor_id"])
    cells = matrix.select(F.col("sample_id").cast("string").alias("sample_id"), "feature", "value").filter("value is not null")
    members = membership(nodes).withColumnRenamed("node_id", "ancestor_id")
    sides = asked.join(members, ["tree_id", "ancestor_id"]).join(cells.select("sample_id", F.col("feature").alias("split_feature"), F.col("value").alias("at")), ["sample_id", "split_feature"])
    sides = sides.withColumn("sign", F.when(F.col("at") > F.col("split_value"), ">").otherwise("<"))
    outs = leaf_features(nodes).select("tree_id", "node_id", "feature", "cov", "local_gain")
    keys = ["tree_id", "node_id", "ancestor_id", "sign", "feature"]
    told = sides.select("tree_id", "node_id", "ancestor_id", "sign", "sample_id").join(cells, "sample_id").join(outs.select("tree_id", F.col("node_id").alias("ancestor_id"), "feature", F.col("cov").alias("above")), ["tree_id", "ancestor_id", "feature"])
    there = stats.summary(told, [*keys, "above"]).select(*keys, (F.col("above") - F.col("cov")).alias("gain_there"))
    kid = nodes.filter("parent_id is not null").select("tree_id", F.col("node_id").alias("kid"), F.col("parent_id").alias("node_id"), F.when(F.col("side") == "L", "<").otherwise(">").alias("sign"))
    here = kid.join(outs.select("tree_id", F.col("node_id").alias("kid"), "feature", "local_gain"), ["tree_id", "kid"])
    top_ = nodes.select("tree_id", F.col("node_id").alias("ancestor_id"), F.col("split_feature").alias("ancestor_feature"), F.col("split_value").alias("ancestor_split"))
    out = here.join(there, ["tree_id", "node_id", "sign", "feature"]).join(asked.select("tree_id", "node_id", "ancestor_id", "split_feature", "split_value", "ancestor_sign"), ["tree_id", "node_id", "ancestor_id"]).join(top_, ["tree_id", "ancestor_id"])
    return out.select("tree_id", "node_id", "ancestor_id", F.col("split_feature").alias("split"), "sign", "split_value", "ancestor_feature", "ancestor_sign", "ancestor_split", F.col("feature").alias("output"), (F.col("local_gain") - F.col("gain_there")).alias("interaction"))


def leaf_weights(nodes: DataFrame, truth: DataFrame, feature: str, ridge: float = 1e-6, tolerance: float = 1e-12) -> DataFrame:
    """``leaf, weight``: how much each leaf's median should count so that the leaves of a sample add up to the truth.

    Least squares of the truth over leaf medians with a small ridge, over samples whose
    truth is known, by conjugate gradients: a step multiplies the rows by a vector, one for each
    sample, where the rows are. The driver holds vectors as long as the forest has leaves,
    never their products. Leaves of which no sample's truth is known have weight 0.
    """
    import numpy as np
    import pyarrow as pa

    spark = nodes.sparkSession
    leaves = nodes.filter("is_leaf")
    own = leaf_features(leaves).filter(F.col("feature") == feature).select("tree_id", "node_id", "median")
    names = sorted(r[0] for r in own.select(F.concat_ws("/", "tree_id", "node_id")).collect())  # the forest's leaves
    if not names:
        return spark.createDataFrame([], "leaf string, weight double")
    places = spark.createDataFrame(list(enumerate(names)), "at int, leaf string")
    m = membership(leaves).join(own, ["tree_id", "node_id"]).select("sample_id", F.concat_ws("/", "tree_id", "node_id").alias("leaf"), "median").join(places, "leaf")
    known = truth.filter((F.col("feature") == feature) & F.col("value").isNotNull()).select(F.col("sample_id").cast("string").alias("sample_id"), F.col("value").alias("y"))
    rows = m.groupBy("sample_id").agg(F.collect_list("at").alias("at"), F.collect_list("median").alias("x")).join(known, "sample_id").select("at", "x", "y").checkpoint()  # a tree has one leaf of a sample

    def products(vector: np.ndarray | None) -> np.ndarray:
        """The rows' transpose times the truths or, with a vector, times the rows times the vector; without a row's other entries ever meeting."""
        sent = spark.sparkContext.broadcast(vector)
        n = len(names)

        def run(parts):
            total, v = np.zeros(n), sent.value
            for batch in parts:
                at, x = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1))
                size = np.diff(batch.column(0).offsets.to_numpy())
                row = np.repeat(np.arange(len(size)), size)
                y = batch.column(2).to_numpy(zero_copy_only=False) if v is None else np.bincount(row, x * v[at], len(size))
                total += np.bincount(at, x * y[row], n)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["at", "v"])

        out = np.zeros(n)
        for r in rows.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
            out[r["at"]] = r["v"]
        sent.unpersist()
        return out

    b = products(None)
    w, r = np.zeros(len(names)), b.copy()
    p, size = r.copy(), float(r @ r)
    for _ in range(2 * len(names)):
        if size <= tolerance**2 * float(b @ b):
            break
        q = products(p) + ridge * p
        step = size / float(p @ q)
        w, r = w + step * p, r - step * q
        size, before = float(r @ r), size
        p = r + size / before * p
    return spark.createDataFrame([(x, float(v)) for x, v in zip(names, w, strict=True)], "leaf string, weight double")


def covs(nodes: DataFrame) -> DataFrame:
    """``tree_id, node_id, feature, cov``: dispersion over median, 0 where that is no number."""
    return leaf_features(nodes).select("tree_id", "node_id", "feature", safe_ratio(F.col("dispersion"), F.col("median")).alias("cov"))
