"""Operators on small tables with known answers."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket import cli
from thicket.functions.numeric import DropMode, sanitize
from thicket.operators import analytics, boost, forest, matrix, predict, sampling, scan, stats
from thicket.plans.parameters import Parameters, auto_parameters, parse, shape_rules
from thicket.sources import text

from .small_trees import trees

ONE = [10, -3, 0, 5, -2, -1, 15, 20]


def long(spark, **columns):
    rows = [(i, f, float(v)) for f, values in columns.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "sample_id int, feature string, value double")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_medians_of_the_small_tables(spark):
    m = long(spark, one=[1, 2, 3], two=[4, 5, 6], three=[7, 8, 9])
    assert rows(stats.summary(m), "feature", "median", "mad") == [("one", 2, 1), ("three", 8, 1), ("two", 5, 1)]
    m = matrix.dropped(long(spark, one=ONE), DropMode.ZEROS)
    for keep, want in (([0, 2, 4, 6], (10.0, 5.0)), ([1, 3, 5, 7], (2.0, 4.0))):
        assert rows(stats.summary(m.filter(F.col("sample_id").isin(keep))), "median", "mad") == [want]
    m = matrix.dropped(long(spark, x=[0, 0, 0, -5, -5, -5, 10, 10, 10, 10, 10]), DropMode.ZEROS)
    assert rows(stats.summary(m), "median", "mad") == [(10, 0)]
    assert stats.summary(m.limit(0)).count() == 0


def test_draw_order_and_split_of_the_example(spark):
    m = matrix.dropped(long(spark, one=ONE), DropMode.ZEROS).withColumn("node", F.lit("RT"))
    order = [r["sample_id"] for r in scan.draw_order(m).orderBy("k").collect()]
    assert order == [1, 4, 5, 3, 0, 6, 7]
    outs = m.withColumn("feature", F.lit("two"))
    scores = scan.split_scores(scan.drawn(m, outs))
    cut = scan.best_split(scan.best_cuts(scores, spark.createDataFrame([("RT", 8)], "node string, samples int")))
    assert rows(cut, "split_feature", "k", "split_value", "score") == [("one", 4, 10.0, 3.125 * 2)]
    sides = scan.children(m, cut)
    assert rows(sides, "side", "sample_id") == [("L", 1), ("L", 3), ("L", 4), ("L", 5), ("R", 0), ("R", 6), ("R", 7)]
    assert rows(scan.route_by_value(m, cut).filter("sample_id = 0"), "side") == [("L",)]


def test_odd_floats(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1e-310,), (2.0,), (None,)], "x double")
    assert [r[0] for r in df.select(sanitize(F.col("x"))).collect()] == [0, 0, 0, 2, None]


def test_interval_stacks(spark):
    def stack(*spans):
        df = spark.createDataFrame([(0, "f", float(a), float(b), float(s)) for a, b, s in spans], "sample_id int, feature string, start double, end double, score double")
        got = predict.interval_stack(df)
        return rows(got, "start", "end", "score"), [r["value"] for r in predict.stacked(got).collect()]

    assert stack((0, 20, 1), (10, 20, 2))[0] == [(0, 10, 1), (10, 20, 3)]
    assert stack((0, 10, 1), (20, 30, 1))[0] == [(0, 10, 1), (20, 30, 1)]
    assert stack((0, 10, 1), (0, 10, 1))[0] == [(0, 10, 2)]
    assert stack((0, 10, 1), (4, 6, 1), (5, 7, 1)) == ([(0, 4, 1), (4, 5, 2), (5, 6, 3), (6, 7, 2), (7, 10, 1)], [5.5])
    assert stack((3, 3, 1)) == ([], [])


@pytest.mark.parametrize("policy", ["branch", "truncate", "abort"])
def test_both_ways_of_routing_agree(spark, policy):
    m = spark.createDataFrame([(i, f, float(v)) for i in range(30) for f, v in (("discount", i % 11 / 100), ("tax", i % 7 / 100), ("quantity", i * 2 % 50)) if v], "sample_id int, feature string, value double")
    keys = ("sample_id", "tree_id", "node_id")
    assert rows(predict.route_sent(trees(spark), m, policy), *keys) == rows(predict.route_joined(trees(spark), m, policy), *keys)


def test_growth_keeps_its_promises(spark):
    m = spark.createDataFrame([(i, f"f{j}", float((i * 37 + j * 11) % 23 + (i % 2) * j)) for i in range(40) for j in range(4)], "sample_id int, feature string, value double")
    p = Parameters(trees=2, leaf_size=8, in_features=3, out_features=3, sample_sub=30, drop="no", prediction="branch", seed=5)
    nodes = forest.fit(m, p).checkpoint()
    assert rows(nodes, "tree_id", "node_id", "split_value") == rows(forest.fit(m, p), "tree_id", "node_id", "split_value")
    roots = nodes.filter("node_id = 'RT'").collect()
    assert len(roots) == 2 and all(r["n_samples"] == 30 and len(set(r["features"])) == 3 for r in roots)
    kids = nodes.filter("parent_id is not null").groupBy("tree_id", "parent_id").agg(F.sum("n_samples").alias("n"), F.count("*").alias("k"))
    up = nodes.select("tree_id", F.col("node_id").alias("parent_id"), F.col("n_samples").alias("all"))
    assert kids.join(up, ["tree_id", "parent_id"]).filter("n <> all or k <> 2").count() == 0
    assert analytics.checked(nodes, m).filter("abs(median - true_median) > 1e-9 or abs(dispersion - true_mad) > 1e-9").count() == 0
    again = text.from_nested(text.nested(nodes))
    assert rows(again, "tree_id", "node_id", "split_value", "n_samples") == rows(nodes, "tree_id", "node_id", "split_value", "n_samples")
    assert predict.predict(nodes, m, mode=DropMode.NO).count() == 40 * nodes.select(F.explode("features")).distinct().count()


def test_empty_matrix(spark):
    m = spark.createDataFrame([], "sample_id int, feature string, value double")
    assert forest.fit(m, Parameters(trees=2)).count() == 0
    assert predict.predict(trees(spark), m).count() == 0


def test_boosting_reduces_the_error(spark):
    m = spark.createDataFrame([(i, f"f{j}", float(10 * (i % 2) + j + (i * 7 % 5) / 10 + 1)) for i in range(40) for j in range(4)], "sample_id int, feature string, value double")
    p = Parameters(epochs=2, epoch_duration=2, leaf_size=6, in_features=2, out_features=2, sample_sub=30, drop="no", prediction="branch", boost="additive", weighing="flat", seed=2)
    b = boost.Boosted(m, p).run()
    before, after = m.agg(F.avg(F.col("value") ** 2)).first()[0], b.error.agg(F.avg(F.col("value") ** 2)).first()[0]
    assert after < before


def test_names_are_made_unique(spark):
    names = spark.createDataFrame([(0, "a"), (1, "a"), (2, "a1"), (3, "a"), (4, "b")], "pos long, name string")
    got = [r["name"] for r in text.unique_names(names).orderBy("pos").collect()]
    assert len(set(got)) == 5 and got[0] == "a" and got[2] == "a1" and got[4] == "b"


def test_text_matrices(spark, tmp_path):
    (tmp_path / "m.txt").write_text("1 2.5\nnan x\n-3e2 1d\n")
    got = {(r["sample_id"], r["feature"]): r["value"] for r in text.read_matrix(spark, str(tmp_path / "m.txt")).collect()}
    assert got["0", "1"] == 2.5 and got["2", "0"] == -300 and all(got[k] != got[k] for k in (("1", "0"), ("1", "1"), ("2", "1")))
    (tmp_path / "empty.txt").write_text("")
    assert text.read_matrix(spark, str(tmp_path / "empty.txt")).count() == 0


def test_parameters(spark):
    assert shape_rules(2, 9) == {"in_features": 2, "out_features": 2, "sample_sub": 9, "leaf_size": 3, "trees": 100}
    assert shape_rules(50, 900)["sample_sub"] == 600 and shape_rules(50, 3000)["sample_sub"] == 1500
    given, auto = parse(["-auto", "-t", "3", "-tg", "a", "b"])
    assert auto and given == {"trees": 3, "tree_glob": ("a", "b")}
    with pytest.raises(ValueError):
        parse(["-nothing", "1"])
    m = long(spark, a=[0, 0, 0, 1], b=[0, 0, 2, 1])
    assert auto_parameters(m).drop is DropMode.ZEROS and auto_parameters(m).prediction == "truncate"


def test_commands(spark, tmp_path):
    (tmp_path / "m.txt").write_text("\n".join(" ".join(str((i * k) % 13 + 1) for k in (1, 2, 3)) for i in range(30)))
    cli.main(["combined", "-c", str(tmp_path / "m.txt"), "-o", str(tmp_path / "out"), "-t", "2", "-l", "8", "-ss", "20", "-if", "2", "-of", "2", "-d", "no", "-m", "branch"])
    lines = spark.read.text(str(tmp_path / "out.prediction")).count()
    assert lines == 30 and text.read_forest(spark, str(tmp_path / "out")).count() > 2


def test_gradient_writes_a_similarity_an_epoch(spark, tmp_path):
    m = spark.createDataFrame([(i, f"f{j}", float(10 * (i % 2) + j + (i * 7 % 5) / 10 + 1)) for i in range(30) for j in range(4)], "sample_id int, feature string, value double")
    p = Parameters(epochs=2, epoch_duration=2, leaf_size=6, in_features=2, out_features=2, sample_sub=20, drop="no", prediction="branch", boost="additive", weighing="flat", seed=2)
    cli.gradient(m, p, str(tmp_path / "out"))
    first, last = (spark.read.parquet(str(tmp_path / f"out.{k}.similarity")) for k in (0, 1))
    assert first.columns == ["f1", "f2", "corr"] and 0 < first.count() <= last.count()


def test_interactions_and_coordinates_as_text(spark, tmp_path):
    row = (1, "RTL", "RT", "a", "<", 2.5, "b", ">", 4.0, "c", -0.25)
    given = spark.createDataFrame([row], "tree_id int, node_id string, ancestor_id string, split string, sign string, split_value double, ancestor_feature string, ancestor_sign string, ancestor_split double, output string, interaction double")
    text.write_interactions(given, str(tmp_path / "t"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "t.interactions")).collect()] == ["a\t<\t2.5\tb\t>\t4.0\tc\t-0.25"]
    text.write_coordinates(spark.createDataFrame([(1, "RT", 0.5, -1.0)], "tree_id int, node_id string, x double, y double"), str(tmp_path / "xy"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "xy")).collect()] == ["1/RT\t[0.5 -1.0]"]


def test_streaming_scores_equal_batch(spark, tmp_path):
    from thicket.streaming.score import score_stream

    m = spark.createDataFrame([(i, f, float(v)) for i in range(12) for f, v in (("discount", i / 100), ("tax", i % 7 / 100), ("quantity", i * 4))], "sample_id int, feature string, value double")
    m.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(m.schema).parquet(str(tmp_path / "in"))
    score_stream(stream, trees(spark), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows(got, "sample_id", "feature", "value") == rows(predict.predict(trees(spark), m), "sample_id", "feature", "value")


def test_clusters_and_weights(spark):
    n = trees(spark)
    d = analytics.jaccard_distances(n)
    assert d.filter("distance < 0 or distance >= 1").count() == 0
    labels = analytics.clusters(d, n, 0.5, 2)
    got = {r["node"]: r["cluster"] for r in labels.collect()}
    near = {(r["a"], r["b"]) for r in d.filter("distance <= 0.5").collect()}
    assert got == by_hand(sorted(got), near, 2)
    stat = {r["cluster"]: (r["nodes"], r["trees"]) for r in analytics.cluster_stats(n, labels).collect()}
    assert stat == {c: (sum(x == c for x in got.values()), len({k.split("/")[0] for k, x in got.items() if x == c})) for c in set(got.values()) - {None}}


def by_hand(names, near, least):
    """DBSCAN a node at a time."""
    beside = {n: {b if a == n else a for a, b in near if n in (a, b)} for n in names}
    core = {n for n in names if len(beside[n]) + 1 >= least}
    out = {}
    for n in sorted(core):
        todo = [n]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = n
                todo += beside[x] & core
    return {n: out.get(n, min((out[x] for x in beside[n] & core), default=None)) for n in names}


def test_levels_grow_the_trees_that_one_task_grows(spark):
    cells = [(t, i, f"f{j}", float((i * 37 + j * 11 + t * i * j) % 23 + (i % 2) * j) if (i + j) % 9 else None) for t in (1, 2) for i in range(60) for j in range(3)]
    df = spark.createDataFrame(cells, "tree_id int, sample_id int, feature string, value double")
    for mode in ("mad", "variance"):
        got = {(r["tree_id"], r["node_id"]): r for r in forest.fit_levels(df, 12, 3, mode).collect()}
        p = Parameters(trees=2, leaf_size=12, split=mode, drop="no", prediction="branch")
        both = df.withColumn("role", F.explode(F.array(F.lit("in"), F.lit("out"))))
        short = lambda node: "RT" + "".join(re.findall(r"!F[^!]+:S[-+0-9.eE]+([LR])", node))
        want = {(r["tree_id"], short(r["node_id"])): r for r in forest.grown(both, p).filter("depth <= 3").collect()}
        assert set(got) == set(want) and len(got) > 8
        for k, r in got.items():
            assert sorted(r["samples"]) == sorted(want[k]["samples"]) and r["medians"] == want[k]["medians"]
            assert all(abs(a - b) < 1e-9 for a, b in zip(r["dispersions"], want[k]["dispersions"]))
            if r["depth"] < 3:
                assert (r["split_feature"], r["split_value"]) == (want[k]["split_feature"], want[k]["split_value"])


def test_best_cut_by_brute_force(spark):
    """Every cut of every input, with medians and deviations taken anew."""
    rng = np.random.default_rng(3)
    values = rng.integers(-50, 50, (25, 3)).astype(float)
    mad = lambda x: float(np.median(np.abs(x - np.median(x)))) if len(x) > 1 else 0.0
    found = []
    for j in range(3):
        order = sorted(range(25), key=lambda i: (values[i, j], i))
        for k in range(3, 23):
            own = [o for o in range(3) if o != j]
            d = [mad(values[order[k:], o]) * (26 - k) / 26 + mad(values[order[:k], o]) * (k + 1) / 26 for o in own]
            found.append((sum(d) / 2, j, -k, values[order[k], j]))
    score, j, k, at = min(found)
    m = spark.createDataFrame([("RT", i, f"f{f}", float(values[i, f])) for i in range(25) for f in range(3)], "node string, sample_id int, feature string, value double").cache()
    cut = scan.best_split(scan.best_cuts(scan.split_scores(scan.drawn(m, m)), spark.createDataFrame([("RT", 25)], "node string, samples int"))).first()
    assert (cut["split_feature"], cut["k"], cut["split_value"]) == (f"f{j}", -k, at) and abs(cut["score"] - score) < 1e-9


def test_draws_with_replacement_follow_the_weights(spark):
    items = spark.createDataFrame([(i, float(i % 5)) for i in range(50)], "item int, w double")
    draws = sampling.with_replacement(items, 20000, "item", "w", 3).toPandas()
    assert sorted(draws["draw"]) == list(range(20000))
    for i in range(50):
        assert abs((draws["item"] == i).sum() - 20000 * (i % 5) / 100) <= 5 * (20000 * (i % 5) / 100) ** 0.5
    one = sampling.choice(items, "item", "w", 9).collect()
    assert len(one) == 1 and one[0]["item"] % 5 > 0
    assert sampling.with_replacement(items.limit(0), 5, "item", "w", 3).count() == 0


def test_draws_are_the_least_hashes(spark):
    groups, items = spark.createDataFrame([(g,) for g in range(5)], "g int"), spark.range(3000)
    for k in (1, 40, 2999, 5000):
        got = sampling.draw(groups, items, k, "g", "id", 4)
        want = sampling.without_replacement(groups.crossJoin(items), k, ["g"], "id", 4)
        assert got.exceptAll(want).count() == 0 and got.count() == 5 * min(k, 3000)
    assert sampling.draw(groups, items.limit(0), 3, "g", "id", 4).count() == 0


def test_cells_are_drawn_by_their_error(spark):
    errors = spark.createDataFrame([(i, f"f{j}", float(-j)) for i in range(400) for j in range(4)], "sample_id int, feature string, value double")
    got = sampling.cells_by_error(errors, 300, 5)
    share = {r["feature"]: r["count"] for r in got.groupBy("feature").count().collect()}
    assert got.distinct().count() == 300 and "f0" not in share and share["f1"] < share["f2"] < share["f3"]


def test_output_weights_are_sizes_of_errors(spark, monkeypatch):
    seen = []
    real = boost.grown
    monkeypatch.setattr(boost, "grown", lambda cells, p, weights, epoch: seen.append({r["feature"]: r["weight"] for r in weights.collect()}) or real(cells, p, weights, epoch))
    m = spark.createDataFrame([(i, f"f{j}", float((i % 4 + 1) * (-1) ** j)) for i in range(20) for j in range(3)], "sample_id int, feature string, value double")
    boost.Boosted(m, Parameters(epochs=1, epoch_duration=1, leaf_size=6, in_features=2, out_features=2, sample_sub=20, drop="no", prediction="branch", boost="additive", seed=2)).run()
    assert seen == [{f"f{j}": 50.0 for j in range(3)}]
