"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import attention_lm, decontamination, exact_dedup, minhash, packing, pii, records, sharding, suffix_dedup, toxicity
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer lies; the files are not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_private(read(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_strings(read(spark, sf_dir, "documents"), length=400)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_records(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0, length=2048)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.drop("longest", "spans")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(read(spark, sf_dir, "documents"), shards=24)


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score_texts(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), n=2, threshold=0.8)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_pii, op2_suffix_dedup, op3_exact_dedup, op4_token_records, op5_packing, op6_toxicity, op7_decontamination, op8_sharding, op9_lm_scores, op10_minhash)
}
ORACLES: dict[str, str] = {"op3_exact_dedup": exact_dedup.SQL, "op7_decontamination": decontamination.SQL, "op10_minhash": minhash.SQL}
