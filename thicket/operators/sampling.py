"""Seeded sampling: by hashes, so that a rerun on other executors draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Buckets of items for draws with replacement.
BUCKETS = 1024


def uniform(seed: int, *keys: str) -> Column:
    """A number in (0, 1) that is a function of the seed and the keys."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def without_replacement(items: DataFrame, k: int, by: list[str], id_: str, seed: int, key: Column | None = None) -> DataFrame:
    """Exactly ``k`` items of each group, or all: those with the least ``key``, a hash if none is given."""
    w = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), *by, id_) if key is None else key, id_)
    return items.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def draw(groups: DataFrame, items: DataFrame, k: int, group: str, id_: str, seed: int) -> DataFrame:
    """``k`` of all items, or all, for each of the groups (few, by count): those with the least hashes.

    Hashes far above the k-th are dropped where they are made, so about k rows a group
    are shuffled and sorted, however many items there are.
    """
    n, share = items.count(), 0.0
    key = F.xxhash64(F.lit(seed), group, id_)
    while True:
        share = 4 * share if share else (k + 6 * k**0.5 + 20) / max(n, 1)
        likely = items.crossJoin(F.broadcast(groups.select(group))).select(group, *items.columns)
        if share < 1:
            likely = likely.filter(key < int((share - 0.5) * 2.0**64))
            # A group short of rows has hashes above the threshold among its k least: rare, and then all is done again.
            found = groups.select(group).join(likely.groupBy(group).agg(F.count(F.lit(1)).alias("found")), group, "left")
            if found.filter(F.coalesce("found", F.lit(0)) < min(k, n)).limit(1).count():
                continue
        return without_replacement(likely, k, [group], id_, seed)


def weighted(items: DataFrame, k: int, by: list[str], id_: str, weight: str, seed: int, u: Column | None = None) -> DataFrame:
    """``k`` items of each group without replacement, each draw in proportion to the weights.

    The largest of ln(u) / weight, with u by a hash if it isn't given; items without weight
    are never drawn. Without groups every task keeps its ``k`` best, and only those are merged.
    """
    key = F.ln(uniform(seed, *by, id_) if u is None else u) / F.col(weight)
    items = items.filter(F.col(weight) > 0)
    if not by:
        return items.orderBy(F.desc(key), id_).limit(k)
    w = Window.partitionBy(*by).orderBy(F.desc(key), id_)
    return items.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def with_replacement(items: DataFrame, k: int, id_: str, weight: str, seed: int, u: Column | None = None, bucket: Column | None = None) -> DataFrame:
    """``k`` draws, by the place of uniform numbers among the cumulative weights: ``draw, <id_>``.

    ``u`` gives the uniform number of the draw ``id``, by a hash if there is none. Items lie in
    BUCKETS by their hash, or as ``bucket`` (0 and up) says. A draw finds its bucket among the buckets' sums,
    and then its item among those of the bucket.
    """
    spark = items.sparkSession
    own = items.filter(F.col(weight) > 0).select(id_, F.col(weight).cast("double").alias("w"), (F.pmod(F.xxhash64(id_), F.lit(BUCKETS)) if bucket is None else bucket).alias("bucket"))
    inside, along = Window.partitionBy("bucket").orderBy(id_), Window.orderBy("bucket")
    own = own.withColumn("upto", F.sum("w").over(inside)).withColumn("from", F.lag("upto", 1, 0.0).over(inside))
    sums = own.groupBy("bucket").agg(F.max("upto").alias("all")).withColumn("end", F.sum("all").over(along)).withColumn("begin", F.lag("end", 1, 0.0).over(along))  # BUCKETS rows
    total = sums.agg(F.max("end")).first()[0] or 0.0
    draws = spark.range(k).select(F.col("id").alias("draw"), ((uniform(seed, "id") if u is None else u) * float(total)).alias("u"))
    placed = draws.join(F.broadcast(sums), (F.col("u") >= F.col("begin")) & (F.col("u") < F.col("end")))
    placed = placed.select("draw", "bucket", F.least(F.col("u") - F.col("begin"), F.col("all") * (1 - 2.0**-52)).alias("at"))
    return placed.join(own, "bucket").filter((F.col("at") >= F.col("from")) & (F.col("at") < F.col("upto"))).select("draw", id_)


def choice(items: DataFrame, id_: str, weight: str, seed: int, u: Column | None = None, bucket: Column | None = None) -> DataFrame:
    """One weighted draw."""
    return with_replacement(items, 1, id_, weight, seed, u, bucket)


def masked(cells: DataFrame, share: float, seed: int, u: Column | None = None) -> DataFrame:
    """Add ``held_out``: whether a cell ``sample_id, feature`` is among about that share of them, by its hash or by ``u``."""
    return cells.withColumn("held_out", (uniform(seed, "sample_id", "feature") if u is None else u) < share)


def cells_by_error(errors: DataFrame, k: int, seed: int, u: Column | None = None) -> DataFrame:
    """``k`` cells of an error matrix, drawn by the size of their error."""
    cells = errors.select("sample_id", "feature", F.abs("value").alias("w"), F.xxhash64("sample_id", "feature").alias("cell"))
    return weighted(cells, k, [], "cell", "w", seed, u).select("sample_id", "feature")


def pieces(items: DataFrame, n: int, id_: str, seed: int, key: Column | None = None) -> DataFrame:
    """A random part, 0 to n - 1, for each item, by its hash or ``key``: no sort and no shuffle."""
    return items.withColumn("piece", F.pmod(F.xxhash64(F.lit(seed), id_) if key is None else key, F.lit(n)).cast("int"))
