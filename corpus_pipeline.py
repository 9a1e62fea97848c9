"""The corpus pipeline: five stages over documents, each written as Parquet before the next one reads it.

All but the last return the columns of the documents they got. Nulls, empty texts, repeated rows and further columns are
handled as the operators' own docstrings say; an empty table goes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackframe.llm import decontaminate, mixing, quality, secret_scan, simhash
from trackframe.llm.common import configure, cut, discard


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: keeps the documents whose probability of the highest grade is quality.KEEP or more."""
    configure(spark)
    weights, thresholds = quality.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, weights, thresholds, keep_columns=True).filter("keep").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of documents whose sets of five-word shingles have a similarity of 0.8 or more the smallest doc_id stays."""
    configure(spark)
    return simhash.keep_one(docs, simhash.NEAR_COPIES)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that hold a test item, whole or edited, go."""
    configure(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: secrets in the texts are replaced by a mark; all documents stay."""
    configure(spark)
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: how often the mix takes each document."""
    configure(spark)
    return mixing.mix(docs)


STAGES = [
    ("quality", reject_low_quality),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: The stages rest on fitted weights, fingerprints and seeded sampling, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, cut(stage(spark, docs, sf_dir), name)
        if k:
            discard(before)
    return docs
