"""A corpus from raw documents to packed sequences, in five written stages.

Each stage reads what its predecessor wrote. Near duplicates are judged on shingles of five
words at a similarity of 0.8; hit words are cut out of a contaminated document, which goes as a whole
where they are over a fifth of it.

Defined cases: null texts count as empty and go through all stages like empty ones; of equal texts
one row stays, whatever its id; rows that share an id, or have none, are judged each on their own;
an empty table gives an empty result; columns beside doc_id and text pass through unread up to packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontamination, exact_dedup, minhash, packing, toxicity
from siltstone.llm.catalogue import tokenizer_path
from siltstone.llm.common import cut, read

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _keep(docs: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs, all columns, without the rows that ``decide`` (doc_id and kept of each row) does not keep.

    A decision is one row's own. Where ids repeat or are null, the operator sees numbers in
    their stead that follow the order of doc_id (nulls last) and, within one id, of a hash of the text.
    """
    doubtful = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if doubtful.isEmpty():
        gone = decide(docs).where("not kept").select("doc_id")
        return docs.join(cut(gone, "gone"), "doc_id", "left_anti").select(*docs.columns)
    number = "row_" + "_".join(docs.columns)  # a name that no column has
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.monotonically_increasing_id())
    rows = cut(ordered.withColumn(number, F.monotonically_increasing_id()), "numbered")
    gone = decide(rows.select(F.col(number).alias("doc_id"), "text")).where("not kept").select(F.col("doc_id").alias(number))
    return rows.join(cut(gone, "gone"), number, "left_anti").select(*docs.columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _keep(docs, exact_dedup.exact_dedup)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _keep(docs, lambda rows: minhash.near_duplicates(rows, n=5, threshold=0.8))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_spans(docs, read(spark, sf_dir, "benchmark"), coverage=0.2)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0, length=2048)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("minhash", drop_near_copies),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: The toxicity stage is a trained model, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
