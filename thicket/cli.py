"""Commands: ``python -m thicket.cli construct|predict|combined|gradient [options]``."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from thicket.operators import boost, forest, predict
from thicket.plans.parameters import Parameters, auto_parameters, parse
from thicket.sources import text

#: Names of the commands; fixed values.
COMMANDS = {"construct": "construct", "predict": "predict", "combined": "combined", "conpred": "combined", "construct_predict": "combined", "gradient": "gradient"}


def load(spark: SparkSession, given: dict[str, object]) -> DataFrame:
    header = text.read_header(spark, str(given["features"])) if given.get("features") else None
    samples = text.read_sample_names(spark, str(given["samples"])) if given.get("samples") else None
    return text.read_matrix(spark, str(given["counts"]), header, samples)


def names_of(matrix: DataFrame) -> list[str]:
    return sorted(r[0] for r in matrix.select("feature").distinct().collect())


def fit(matrix: DataFrame, p: Parameters, path: str) -> DataFrame:
    text.write_forest(forest.fit(matrix, p), path)
    return text.read_forest(matrix.sparkSession, path)


def score(matrix: DataFrame, nodes: DataFrame, p: Parameters, path: str) -> DataFrame:
    out = predict.predict(nodes, matrix, p.prediction, p.averaging, p.weighing, p.drop).checkpoint()
    text.write_prediction(out, matrix, names_of(out), path)
    return out


def gradient(matrix: DataFrame, p: Parameters, path: str) -> DataFrame:
    b = boost.Boosted(matrix, p).run()
    names = names_of(matrix)
    for epoch, (got, like) in enumerate(zip(b.predictions, b.similarities, strict=True)):
        text.write_prediction(got, b.truth, names, path, epoch)
        text.write_weights(b.weights(epoch, names), path, epoch)
        text.write_similarity(like, path, epoch)
    text.write_forest(b.nodes, f"{path}.forest")
    out = b.predict()
    text.write_prediction(out, b.truth, names, path)
    return out


def main(args: list[str]) -> None:
    if not args or args[0] not in COMMANDS:
        raise SystemExit(f"{__doc__}\nCommands: {', '.join(COMMANDS)}")
    given, auto = parse(args[1:])
    spark = SparkSession.builder.appName("thicket").getOrCreate()
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(f"{given.get('output', '.')}.checkpoints")
    matrix = load(spark, given)
    if auto or given.get("prediction") == "auto":
        if given.get("prediction") == "auto":
            given.pop("prediction")
        chosen = auto_parameters(matrix, {k: v for k, v in given.items()})
        p = chosen if auto else Parameters(**(given | {"prediction": chosen.prediction}))
    else:
        p = Parameters(**given)
    path, command = str(given.get("output", "forest")), COMMANDS[args[0]]
    if command == "construct":
        fit(matrix, p, path)
    elif command == "combined":
        score(matrix, fit(matrix, p, path), p, path)
    elif command == "predict":
        score(matrix, text.read_forest(spark, *(p.tree_glob or (path,))), p, path)
    else:
        gradient(matrix, p, path)


if __name__ == "__main__":
    main(sys.argv[1:])
