"""A training-data pipeline over ``documents``: classify, deduplicate, decontaminate, mask secrets, mix.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and
read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from splatloom.llm import decontaminate, mixing, near_dedup, quality_model, secrets
from splatloom.llm.session import written


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it is fitted on the rated ones among them."""
    return quality_model.selected(docs, quality_model.train(docs, quality_model.ratings_of(_read(spark, sf_dir, "labels"))))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    return near_dedup.deduplicated(docs, shingle=5)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words inside benchmark windows."""
    return decontaminate.decontaminated(docs, _read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return secrets.masked(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words taken of each and its source's target."""
    return mixing.mixed(docs)


STAGES = [
    ("quality classifier", classify),
    ("near duplicates", deduplicate),
    ("benchmark decontamination", remove_benchmark),
    ("secret masking", mask_secrets),
    ("source mixing", mix),
]

#: The classifier and the signatures have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, in order."""
    docs = _read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
