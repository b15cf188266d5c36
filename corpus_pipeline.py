"""A corpus from raw documents to packed sequences, in five stages that each call one operator of tideloom.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
A stage's result is written as Parquet to the shared folder and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideloom.llm import line_dedup, near_dedup, packing, quality, source_mix
from tideloom.llm.common import discard, settle
from tideloom.llm.queries import quality_model


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likely of the highest grade, by ratings in ``labels``."""
    return quality.select(docs, quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that an earlier one holds; n_chars follows the text."""
    others = F.struct(*[docs[c] for c in docs.columns if c != "text"])  # whatever their names
    out = line_dedup.dedup_lines(docs.select("doc_id", "text", others.alias("others")))
    made = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return out.select(*[(made.get(c) if c in made else F.col("others")[c]).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each component of near-duplicates."""
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them."""
    return source_mix.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents with their places in sequences of 2048 ids."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: A fitted classifier, MinHash and token ids can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, settle(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), f"stage-{name}")
        discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
