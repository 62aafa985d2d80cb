"""From raw documents to packed training sequences, in five stages.

Every stage takes all documents its predecessor kept. Rejected documents go in the first stage, copies
in the second, secrets are blotted out in the third, the fourth draws the mix (a document as often as it
is taken), the last one packs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from onsetframe.llm import jaccard, mixing, packing, quality_rules, secrets
from onsetframe.session import checkpointed


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one_of_each(docs, length=5, percent=80)


def blot_out_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("ngram_jaccard_join", keep_one_copy),
    ("secret_scans", blot_out_secrets),
    ("mixing", mix),
    ("packing", pack),
]

# tokens, fitted trees and decoded layers can't be written in SQL; tests hold the rows against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
