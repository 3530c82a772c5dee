"""From raw documents to a training mix: five stages, each an operator of recordsearch.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordsearch.llm import decontaminate, mixing, neardup, pii, quality
from recordsearch.llm.common import new_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers find good and not toxic; null texts count as empty ones."""
    return quality.accepted_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest id; documents without words stay."""
    return neardup.without_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark question; null and empty texts hold none."""
    return decontaminate.without_questions(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked; n_chars is that of the new text."""
    return pii.mask_pii(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with the words taken from each."""
    return mixing.mixed(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", neardup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mix", mix_stage),
]

#: A trained classifier and approximate candidates have no SQL form; tests/llm checks every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; each stage is written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
