"""From raw documents to packed sequences: five stages, each an operator of thicket.llm.

In every stage null and empty texts stay, as do null ids and sources, repeated rows
(but for the near-duplicate stage, which leaves one of them) and columns that the
stage doesn't know; an empty table gives an empty one. Texts are read whole. The first
stage sets how many rows go to Python at once in this session, to bound its memory.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm import mixing, ordinal, packing, pii, setsketch
from thicket.llm.queries import table, tokenizer_path
from thicket.llm.shared import attach, delete, drop_tables, shared_root, small_batches

SCOPE = "pipeline"


def free(columns: list[str], name: str) -> str:
    """The name, lengthened until no column has it."""
    while name.lower() in map(str.lower, columns):
        name += "_"
    return name


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier accepts."""
    drop_tables(spark, SCOPE)
    small_batches(spark)
    return ordinal.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the least id; groups of five-word shingles at 0.8."""
    drop_tables(spark, SCOPE)
    gone, gone_t = (free(docs.columns, x) for x in ("gone", "gone_t"))
    groups = setsketch.near_rows(docs, width=5, percent=80, scope=SCOPE).filter("not kept").select(F.col("doc_id").alias(gone), F.col("t").alias(gone_t), "copy").distinct().checkpoint()
    # A row has the doc_id and the text of one that goes, or of the kept one: of those rows any one stays.
    same = F.col("doc_id").eqNullSafe(F.col(gone)) & (setsketch.text_hash() == F.col(gone_t))
    others, copies = (groups.filter(c).select(gone, gone_t) for c in ("not copy", "copy"))
    docs = attach(docs, others, same, "left_anti")
    if not copies.limit(1).count():
        return docs
    return attach(docs, copies, same, "left_anti").unionByName(attach(docs, copies, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; the counts of characters follow."""
    drop_tables(spark, SCOPE)
    return pii.redacted(docs).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents as often as the mixture takes them."""
    drop_tables(spark, SCOPE)
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    drop_tables(spark, SCOPE)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), scope=SCOPE)


STAGES = [("quality classifier", classify), ("near duplicates", near_duplicates), ("personal data", redact), ("mixture", mix), ("packing", pack)]

#: SQL has no tokenizer and no classifier; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again, and deleted when the next one stands."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        path = f"{shared_root(spark)}/pipeline-{i}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        drop_tables(spark, SCOPE)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
