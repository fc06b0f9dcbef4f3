"""Leaf weights by conjugate gradients against a direct solution of the same least squares."""

import numpy as np
from pyspark.sql import functions as F

from thicket.operators import analytics, forest
from thicket.operators.forest import leaf_features
from thicket.plans.parameters import Parameters
from thicket.queries import checkpoints


def test_leaf_weights_solve_the_least_squares(spark):
    checkpoints(spark)
    cells = [(i, f"f{j}", None if j == 0 and i % 9 == 4 else float((i * 37 + j * 11) % 23 + 20 * (i % 2) + j)) for i in range(60) for j in range(4)]
    m = spark.createDataFrame(cells, "sample_id int, feature string, value double")
    nodes = forest.fit(m, Parameters(trees=3, leaf_size=8, in_features=4, out_features=4, sample_sub=45, drop="no", prediction="branch", seed=5)).checkpoint()
    ridge = 1e-3
    got = {r["leaf"]: r["weight"] for r in analytics.leaf_weights(nodes, m, "f0", ridge).collect()}
    leaves = nodes.filter("is_leaf")
    median = {(r["tree_id"], r["node_id"]): r["median"] for r in leaf_features(leaves).filter("feature = 'f0'").collect()}
    names = sorted(f"{t}/{n}" for t, n in median)
    truth = {str(i): v for i, f, v in cells if f == "f0" and v is not None}
    a = np.zeros((len(truth), len(names)))
    place = {s: k for k, s in enumerate(truth)}
    for r in leaves.select("tree_id", "node_id", F.explode("samples").alias("s")).collect():
        if r["s"] in place:
            a[place[r["s"]], names.index(f"{r['tree_id']}/{r['node_id']}")] = median[r["tree_id"], r["node_id"]]
    want = np.linalg.solve(a.T @ a + ridge * np.eye(len(names)), a.T @ np.array(list(truth.values())))
    assert sorted(got) == names and np.allclose([got[x] for x in names], want, rtol=1e-6, atol=1e-8)


def test_leaf_weights_of_no_forest(spark):
    nodes = spark.createDataFrame([], forest.NODE_SQL)
    m = spark.createDataFrame([], "sample_id int, feature string, value double")
    assert analytics.leaf_weights(nodes, m, "f0").count() == 0
