"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and by ranges of a document hash. The range in which a
source's budget ends is refined, and only that one, until it holds single hashes;
then one comparison with the threshold takes or leaves each document. Nothing is
sorted, and hot sources cost one row per range and task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.llm.shared import WORD, attach, shared_table

#: Bits of the 63-bit hash that a level of the histogram tells apart.
LEVEL_BITS = 12


def word_count(text) -> F.Column:
    """Words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], repeat: float) -> DataFrame:
    """Add ``target``: shares of all sizes by weight, each at most ``repeat`` times its source's size.

    Weights are dealt to the sources by code point, null last, over and over. What a
    source can't take is shared again by weight until no target is above its limit.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))).cast("int") + 1)
    sources = sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(repeat)).checkpoint()
    total, over = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.lit(0)).first()
    level = -1.0
    while True:
        above = F.col("weight") * level > F.col("most") if level >= 0 else F.lit(False)
        full, free = sources.agg(F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        new = (total - full) / free if free else level
        if new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(F.col("weight") * level, F.col("most")))


def with_hash(docs: DataFrame, seed: int) -> DataFrame:
    """Add ``mix_hash`` to rows with ``doc_id, source``, a hash ``mix_text`` of the text and their partition ``mix_part``.

    A doc_id has one hash. Rows without one are numbered within those of the same source and
    text, by partition, so each has a hash of its own, and the hashes are the same however
    the rows lie; no task sees more of them than a partition has.
    """
    hashed = lambda *c: F.shiftrightunsigned(F.xxhash64(*c, F.lit(seed)), 1)
    known = docs.filter("doc_id is not null").withColumn("mix_hash", hashed(F.col("doc_id")))
    bare = docs.filter("doc_id is null").withColumn("mix_nth", F.row_number().over(Window.partitionBy("mix_text", "source", "mix_part").orderBy(F.lit(0))))
    sums = docs.filter("doc_id is null").groupBy(F.col("mix_text").alias("a"), F.col("source").alias("b"), F.col("mix_part").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    sums = sums.withColumn("mix_before", F.sum("n").over(Window.partitionBy("a", "b").orderBy("c")) - F.col("n")).drop("n")  # a row a partition
    bare = attach(bare, sums, (F.col("mix_text") == F.col("a")) & F.col("source").eqNullSafe(F.col("b")) & (F.col("mix_part") == F.col("c"))).drop("a", "b", "c")
    bare = bare.withColumn("mix_hash", hashed(F.col("mix_text"), F.col("mix_before") + F.col("mix_nth"))).drop("mix_before", "mix_nth")
    return known.unionByName(bare).drop("mix_text", "mix_part")


def text_and_part() -> list[F.Column]:
    return [F.xxhash64("text").alias("mix_text"), F.spark_partition_id().alias("mix_part")]


def thresholds(sized: DataFrame, weights: tuple[float, ...], repeat: int) -> DataFrame:
    """One row a source: ``s, source_size, target, whole, top``.

    ``sized`` has ``source, size, mix_hash``. A document is taken ``whole`` times, and
    once more if its hash is at most ``top``.
    """
    rows = sized.select("source", "size", F.col("mix_hash").alias("h"))
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeat)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(repeat))).otherwise(0).cast("long")
    budget = sources.select(F.col("source").alias("s"), F.col("source_size").cast("long"), F.col("target").cast("double"), whole.alias("whole"))
    budget = budget.withColumn("left", F.when(F.col("whole") < repeat, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(0.0)).checkpoint()
    # The edge of a source: all below `low` fits into its budget, and `left` is what then remains.
    edge = budget.select("s", "left", F.lit(0).cast("long").alias("low"))
    rows, before = rows.filter("size > 0"), 63
    for shift in (63 - LEVEL_BITS, 63 - 2 * LEVEL_BITS, 0):
        near = attach(rows, edge, F.col("source").eqNullSafe(F.col("s")))
        if before < 63:
            near = near.filter(F.shiftright("h", before) == F.shiftright("low", before))
        sums = near.groupBy("s", F.shiftleft(F.shiftright("h", shift), shift).alias("at")).agg(F.sum("size").alias("n"), F.first("left").alias("left"))
        sums = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("s").orderBy("at")))
        if shift:
            found = sums.filter(F.col("upto") > F.col("left")).groupBy("s").agg(F.min(F.struct("at", (F.col("left") - F.col("upto") + F.col("n")).alias("left"))).alias("edge"))
            edge = found.select("s", "edge.left", F.col("edge.at").alias("low")).checkpoint()
        else:
            # The last hash at which the sum is still nearer to the budget than before it.
            found = sums.filter(F.col("upto") - F.col("n") / 2 <= F.col("left")).groupBy("s").agg(F.max("at").alias("top"))
            top = edge.select(F.col("s").alias("e"), "low").join(found, F.col("e").eqNullSafe(F.col("s")), "left").select("e", F.coalesce("top", F.col("low") - 1).alias("top"))
        before = shift
    return budget.join(top, F.col("s").eqNullSafe(F.col("e")), "left").select("s", "source_size", "target", "whole", F.coalesce("top", F.lit(-1)).alias("top")).checkpoint()


def copies(docs: DataFrame, plan: DataFrame, repeat: int) -> DataFrame:
    """Add the plan's columns and ``copies``, how often each document is taken."""
    taken = F.least(F.col("whole") + (F.col("mix_hash") <= F.col("top")).cast("long"), F.lit(repeat)).cast("long")
    return attach(docs, plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", taken)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), repeat: int = 3, seed: int = 17, scope: str = "") -> DataFrame:
    """Choose how often each document is taken so that sources meet their targets.

    Returns ``doc_id, size, source_size, target, taken, source, copies``. Whole rounds
    over a source come first; what is left of the target is met by the documents whose
    hash is at most the source's threshold, so the documents taken for a smaller budget
    are always among those for a larger one. The last document is taken if that brings
    the source nearer to its target.

    Null text: size 0. Null source: a source of its own, last. Rows that repeat a
    doc_id share its hash and are taken or left together; rows without one are chosen
    each. Very long texts count whole. An empty table gives an empty result; other
    columns are ignored.
    """
    sized = shared_table(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *text_and_part()), "mix-sizes", scope)
    sized = with_hash(sized, seed)
    out = copies(sized, thresholds(sized, weights, repeat), repeat)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), repeat: int = 3, seed: int = 17) -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as it is taken, columns unchanged."""
    hashed = with_hash(docs.select("doc_id", "source", "text", F.struct("*").alias("row"), *text_and_part()), seed)
    plan = thresholds(hashed.select("source", "mix_hash", word_count(F.col("text")).alias("size")), weights, repeat)
    out = copies(hashed.select("row", "source", "mix_hash"), plan, repeat)
    return out.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
