"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, clusters, decontaminate, html_extract, language_id, licences, line_quality, mixing, near_dedup, pii, quality_model, secrets, token_counts
from .session import shared_dir


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), shingle=2)


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_read(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = _read(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~held_out))
    found = language_id.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.quality(_read(spark, sf_dir, "documents"))


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality_model.grades(docs, quality_model.train(docs, quality_model.ratings_of(_read(spark, sf_dir, "labels"))))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.drop("hit_spans")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted; then deleted, revised or both; then replaced by what the table holds.

    Each batch is committed twice: the second time changes nothing.
    """
    ledger = token_counts.Ledger(spark, f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}")
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text").withColumns({"op": F.lit("insert"), "seq": F.lit(2)})
    known, deal = docs.where("doc_id is not null"), F.pmod(F.xxhash64("doc_id"), F.lit(3))
    deleted = known.withColumns({"op": F.lit("delete"), "text": F.lit(None).cast("string")})
    revised = known.withColumns({"op": F.lit("revise"), "seq": F.lit(1), "text": F.upper("text")})
    changed = deleted.where(deal < 2).unionByName(revised.where(deal > 0))
    restored = deleted.withColumn("seq", F.lit(1)).unionByName(known)
    for batch, changes in (("documents", docs), ("changed", changed), ("restored", restored)):
        ledger.commit(batch, changes)
        ledger.commit(batch, changes)
    return ledger.totals()


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return pii.scan(docs, pii.train(docs))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_read(spark, sf_dir, "documents"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(_read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_licences": op2_licences,
    "op3_language_id": op3_language_id,
    "op4_line_quality": op4_line_quality,
    "op5_quality_model": op5_quality_model,
    "op6_html_extract": op6_html_extract,
    "op7_decontaminate": op7_decontaminate,
    "op8_mixing": op8_mixing,
    "op9_secrets": op9_secrets,
    "op10_token_counts": op10_token_counts,
    "op11_pii": op11_pii,
    "op12_token_alignment": op12_token_alignment,
    "op13_centroid_clusters": op13_centroid_clusters,
}
SQL: dict[str, str] = {
    "op2_licences": licences.SQL,
    "op4_line_quality": line_quality.SQL,
    "op8_mixing": mixing.SQL,
    "op13_centroid_clusters": clusters.sql(),
}
