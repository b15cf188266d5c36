"""Queries of the training-data operators over the whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_ivfpq, chat_format, exact_topk, line_dedup, near_dedup, packing, quality, source_mix, url_filter, warc_archive
from .sql import SQL

__all__ = ["QUERIES", "SQL"]

URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
_TEMPLATE_CASE = "\\### Assistant: </turn> ok"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = source_mix.mix_report(_read(spark, sf_dir, "documents"))
    return report.select("doc_id", "size", "source_size", "target", "taken")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    case = spark.createDataFrame(
        [(-7, 0, "user", _TEMPLATE_CASE), (-7, 1, "assistant", _TEMPLATE_CASE)], "conv_id long, turn long, role string, text string"
    )
    return chat_format.digest(chat_format.format_examples(turns.unionByName(case)))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_topk.exact_top_k(vectors, F.expr("pmod(vec_id, 100) = 0"), k=10, scale=1024.0)


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    histories = warc_archive.archive_and_read(_read(spark, sf_dir, "pages"))
    return histories.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_ann_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann_ivfpq.ann_search(vectors, F.expr("pmod(vec_id, 20) = 0"), k=20)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"), URL_RULES)


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    rated = labels.select("doc_id", quality.grade_of(F.col("quality"), F.col("toxic")).cast("int").alias("grade"))
    return quality.train(docs.select("doc_id", "text"), rated)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    scored = quality.score(docs, quality_model(docs, _read(spark, sf_dir, "labels")))
    kept = F.col("tail_probability") >= quality.LEAST
    return scored.select("doc_id", "expected_grade", "tail_probability", kept.alias("kept"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_source_mix,
        op3_chat_format,
        op4_exact_topk,
        op5_warc_archive,
        op6_ann_ivfpq,
        op7_url_filter,
        op8_minhash_dedup,
        op9_quality,
        op10_packing,
    )
}
