"""Reading matrices, names and forests, and writing results."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.operators.forest import NODE_SQL

#: What counts as a number: Java's suffixes and names don't.
NUMBER = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|Inf|infinity|nan|NaN|NAN)$"


#: Splits of files whose table may be broadcast.
FEW_SPLITS = 50_000


def lines(spark: SparkSession, path: str, keep_empty: bool = False) -> DataFrame:
    """``pos, value``: the lines of a text file, or of a folder's files by name, in order; the place is a line's number.

    A split's rows are numbered where they are read; how many lines lie before a split
    follows from the splits' counts, one row each in the driver.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    splits = sorted(rows.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")).collect(), key=lambda r: (r["file"], r["start"]))
    before, places = 0, []
    for r in splits:
        places.append((r["file"], r["start"], before - r["first"]))
        before += r["n"]
    at = spark.createDataFrame(places, "of string, at long, shift long")
    out = rows.join(F.broadcast(at) if len(places) <= FEW_SPLITS else at, (F.col("file") == F.col("of")) & (F.col("start") == F.col("at"))).select((F.col("row") + F.col("shift")).alias("pos"), "value")
    return out if keep_empty else out.filter(F.trim("value") != "")


def read_matrix(spark: SparkSession, path: str, header: DataFrame | None = None, samples: DataFrame | None = None) -> DataFrame:
    """A white-space separated text matrix as ``sample_id, feature, value``.

    Lines are samples. Cells that are no number are NaN. Names come from ``header`` and
    ``samples`` (``pos, name``), or are places from 0.
    """
    cells = lines(spark, path).select("pos", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("column", "raw"))
    number = F.when(F.col("raw").rlike(NUMBER), F.expr("try_cast(raw as double)"))
    m = cells.select("pos", "column", F.coalesce(number, F.lit(float("nan"))).alias("value"))
    m = m.withColumn("feature", F.col("column").cast("string")) if header is None else m.join(header.select(F.col("pos").alias("column"), F.col("name").alias("feature")), "column")
    m = m.withColumn("sample_id", F.col("pos").cast("string")) if samples is None else m.join(samples.select("pos", F.col("name").alias("sample_id")), "pos")
    return m.select("sample_id", "feature", "value")


def unique_names(names: DataFrame) -> DataFrame:
    """``pos, name`` with repeated names made unique by a count behind them.

    A name's later occurrences get 1, 2, .. in order; where such a name exists already,
    counting goes on from there until it doesn't.
    """
    w = Window.partitionBy("name").orderBy("pos")
    out = names.withColumn("rank", F.row_number().over(w) - 1).withColumn("base", F.col("name"))
    out = out.withColumn("name", F.when(F.col("rank") > 0, F.concat("base", F.col("rank").cast("string"))).otherwise(F.col("base"))).checkpoint()
    while True:
        w = Window.partitionBy("name").orderBy("rank", "pos")
        out = out.withColumn("again", F.row_number().over(w) - 1)
        if not out.filter("again > 0").limit(1).count():
            return out.select("pos", "name")
        step = F.col("rank") + F.col("again")
        out = out.withColumn("rank", step).withColumn("name", F.when(F.col("again") > 0, F.concat("base", step.cast("string"))).otherwise(F.col("name"))).drop("again").checkpoint()


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """Feature names, one a line, made unique: ``pos, name``."""
    return unique_names(lines(spark, path).select("pos", F.trim("value").alias("name")))


def read_sample_names(spark: SparkSession, path: str) -> DataFrame:
    """Sample names, one a line, trimmed: ``pos, name``."""
    return lines(spark, path).select("pos", F.trim("value").alias("name"))


def read_forest(spark: SparkSession, *paths: str, prototype: bool = False) -> DataFrame:
    """A node table from Parquet paths or globs; tree 0, a bare root, is left out unless asked for."""
    out = spark.read.schema(NODE_SQL).parquet(*paths)
    return out if prototype else out.filter("tree_id > 0")


def write_forest(nodes: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The node table as Parquet, a folder a tree."""
    nodes.write.mode(mode).partitionBy("tree_id").parquet(path)


def nested(nodes: DataFrame) -> DataFrame:
    """``tree_id, json``: each tree as one nested document, children within their parents."""

    def one(key, pdf):
        import pandas as pd

        kids: dict = {}
        for r in pdf.to_dict("records"):
            kids.setdefault(r["parent_id"], []).append(r)

        def tree(r: dict) -> dict:
            listed = lambda x: None if x is None else [v if isinstance(v, str) else float(v) for v in x]
            own = {k: listed(r[k]) for k in ("features", "samples", "medians", "dispersions", "weights", "local_gains", "absolute_gains")}
            split = None if r["is_leaf"] else float(r["split_value"])
            return {"feature": r["split_feature"], "split": split, **own, "children": [tree(c) for c in sorted(kids.get(r["node_id"], []), key=lambda c: c["side"])]}

        return pd.DataFrame({"tree_id": [int(key[0])], "json": [json.dumps(tree(r)) for r in kids[None]][:1]})

    return nodes.groupBy("tree_id").applyInPandas(one, "tree_id int, json string")


def from_nested(trees: DataFrame) -> DataFrame:
    """The node table of ``tree_id, json`` documents, of any depth."""

    def rows(batches: Iterator) -> Iterator:
        import pandas as pd

        names = [c.split()[0] for c in NODE_SQL.split(", ")]
        for pdf in batches:
            out = []
            for tree_id, text in zip(pdf["tree_id"], pdf["json"], strict=True):
                todo = [(json.loads(text), "RT", None, 0, None)]
                while todo:
                    node, name, parent, depth, side = todo.pop()
                    kids = node.get("children") or []
                    out.append({"tree_id": tree_id, "epoch": 0, "node_id": name, "parent_id": parent, "depth": depth, "side": side, "split_feature": node.get("feature"), "split_value": node.get("split"), "is_leaf": not kids, "n_samples": len(node["samples"]), **{k: node.get(k) for k in names[10:]}})
                    base = f"{name}!F{node.get('feature')}:S{node.get('split')}"
                    todo += [(kid, base + s, name, depth + 1, s) for kid, s in zip(kids, "LR", strict=False)]
            yield pd.DataFrame(out, columns=names)

    return trees.select("tree_id", "json").mapInPandas(rows, NODE_SQL)


def read_compact(spark: SparkSession, path: str) -> DataFrame:
    """Trees of a file with one nested JSON document a line; trees are numbered from 1."""
    return from_nested(lines(spark, path).select((F.col("pos") + 1).cast("int").alias("tree_id"), F.col("value").alias("json")))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Trees of the JSON files that a list file names, one a line."""
    names = [r["value"].strip() for r in lines(spark, path).orderBy("pos").collect()]  # a list of files
    whole = spark.read.text(names, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("json"))
    places = spark.createDataFrame([(i + 1, f) for i, f in enumerate(sorted(set(whole.inputFiles())))], "tree_id int, of string")
    return from_nested(whole.join(places, F.col("file") == F.col("of")).select("tree_id", "json"))


def write_compact(nodes: DataFrame, path: str, mode: str = "append") -> None:
    nested(nodes).select("json").write.mode(mode).text(path)


def summary_lines(nodes: DataFrame) -> DataFrame:
    """Id, feature and split of the inner nodes, a line each."""
    return nodes.filter("not is_leaf").select(F.concat_ws("\t", "node_id", "split_feature", F.col("split_value").cast("string")).alias("value"))


def dump_lines(nodes: DataFrame) -> DataFrame:
    """All of a node, as a marked line of JSON."""
    return nodes.select(F.concat(F.lit("!ID:"), "node_id", F.lit("\n"), F.to_json(F.struct("*")), F.lit("\n")).alias("value"))


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of a dump: text between ``!ID:`` marks, the id first and then the node's JSON."""
    parts = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", "!ID:")).alias("part")).filter(F.trim("part") != "")
    return parts.select(F.from_json(F.regexp_extract("part", r"(?s)^[^\n]*\n(\{.*\})", 1), NODE_SQL).alias("n")).select("n.*")


def dump_field(parts: DataFrame, name: str) -> DataFrame:
    """A field of each part of an older dump, by its name: the text up to the end of the line."""
    return parts.select(F.regexp_extract("part", rf"{re.escape(name)}\s*[:=]\s*([^\n]*)", 1).alias(name))


def tsv(matrix: DataFrame, features: list[str]) -> DataFrame:
    """``sample_id, value``: a line a sample, cells in the order of ``features``, numbers with a point."""
    wide = matrix.groupBy("sample_id").pivot("feature", features).agg(F.first("value"))
    return wide.select("sample_id", F.concat_ws("\t", *[F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")) for f in features]).alias("value"))


def write_prediction(prediction: DataFrame, truth: DataFrame | None, features: list[str], path: str, epoch: int | None = None) -> None:
    """``.prediction``, ``.prediction_truth`` and ``.prediction_header`` under a path, an epoch in a name of its own."""
    stem = path if epoch is None else f"{path}.{epoch}.e"
    dot = "." if epoch is None else "_"
    spark = prediction.sparkSession
    for name, m in (("prediction", prediction), ("prediction_truth", truth)):
        if m is not None:
            tsv(m, features).orderBy("sample_id").select("value").write.mode("overwrite").text(f"{stem}{dot}{name}")
    spark.createDataFrame([("\t".join(f'"{f}"' for f in features),)], "value string").write.mode("overwrite").text(f"{stem}{dot}prediction_header")


def write_weights(weights: dict[str, DataFrame], path: str, epoch: int) -> None:
    """The sampling weights of an epoch: ``.i_weights``, ``.o_weights`` and ``.s_weights``."""
    for name, short in (("inputs", "i"), ("outputs", "o"), ("samples", "s")):
        weights[name].write.mode("overwrite").parquet(f"{path}.{epoch}.{short}_weights")


def write_similarity(similarity: DataFrame, path: str, epoch: int) -> None:
    similarity.write.mode("overwrite").parquet(f"{path}.{epoch}.similarity")


def write_matches(pairs: DataFrame, path: str) -> None:
    """Pairs of features with their gains, as tab separated lines."""
    pairs.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in pairs.columns]).alias("value")).write.mode("overwrite").text(path)


#: Columns of an interactions file, in their order; fixed values.
INTERACTIONS = ["split", "sign", "split_value", "ancestor_feature", "ancestor_sign", "ancestor_split", "output", "interaction"]


def write_interactions(interactions: DataFrame, path: str) -> None:
    """``.interactions`` under a path: what splits gain beyond their ancestors, eight tab separated columns."""
    interactions.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in INTERACTIONS]).alias("value")).write.mode("overwrite").text(f"{path}.interactions")


def write_coordinates(coordinates: DataFrame, path: str) -> None:
    """Nodes and their coordinates ``tree_id, node_id, x, y``, a tab between: ``tree/node`` and ``[x y]``."""
    where = F.concat(F.lit("["), F.concat_ws(" ", F.col("x").cast("string"), F.col("y").cast("string")), F.lit("]"))
    coordinates.select(F.concat_ws("\t", F.concat_ws("/", "tree_id", "node_id"), where).alias("value")).write.mode("overwrite").text(path)
