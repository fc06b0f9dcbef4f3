"""The queries of this subpackage, by name, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from thicket.llm import fingerprint_index, hmm, mixing, ngram_join, ordinal, packing, pii, preference, prefix_hash, quality_rules, setsketch, vocabulary_audit, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.scores(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by code point have 5, 2, 1, 5, .. parts of each window, as long as they last."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), weights=(5, 2, 1))


def op3_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.graded(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op6_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.formatted(preference.swapped_pairs(table(spark, sf_dir, "conversations")))


def op7_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_index.digest(fingerprint_index.deduplicated(table(spark, sf_dir, "documents")))


def op8_prefix_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hash.fingerprints(table(spark, sf_dir, "documents"))


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_groups(table(spark, sf_dir, "documents"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents"))


def op12_vocabulary_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary_audit.audit(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_hmm, op2_packing, op3_risk_rules, op4_ordinal, op5_pii, op6_preference, op7_fingerprint_index, op8_prefix_hash, op9_mixture, op10_setsketch, op11_ngram_join, op12_vocabulary_audit, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op3_risk_rules": quality_rules.sql(), "op6_preference": preference.SQL, "op12_vocabulary_audit": vocabulary_audit.sql()}
