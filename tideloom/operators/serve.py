"""Prediction by all pipelines, and query responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideloom.sources.storage import durable

from .learners import accuracy, classify, margin, rmse

#: The reference values that stand for "no prediction" and "no score", for consumers that expect numbers.
NO_PREDICTION, NO_SCORE = 1.7976931348623157e308, -9223372036854775808.0


def predicted(kind: Column, x: Column, w: Column, b: Column) -> Column:
    m = margin(x, w, b)
    return F.when(kind == "PA", classify(m)).otherwise(m)


def predict_all(data: DataFrame, models: DataFrame, sentinel: bool = False, block: int = 256, largest: int = 64 << 20) -> DataFrame:
    """Every record by every model (pipeline, kind, w, b).

    Models are computed once, packed into blocks of about ``block`` and joined by block number: broadcast where all of
    them take ``largest`` bytes at most, and left to the join strategy beyond that.
    """
    held = durable(models.select("pipeline", "kind", "w", "b"), "models")
    facts = held.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("w") + 4).alias("numbers")).first()
    blocks = max(1, -(-facts["n"] // block))
    packed = held.groupBy(F.pmod(F.xxhash64("pipeline"), F.lit(blocks)).alias("_block")).agg(F.collect_list(F.struct("pipeline", "kind", "w", "b")).alias("_ms"))
    packed = F.broadcast(packed) if 8 * (facts["numbers"] or 0) <= largest else packed
    each = data.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(packed, "_block")
    each = each.withColumn("_m", F.explode("_ms")).drop("_block", "_ms")
    out = predicted(F.col("_m.kind"), F.col("x"), F.col("_m.w"), F.col("_m.b"))
    out = F.coalesce(out, F.lit(NO_PREDICTION)) if sentinel else out
    return each.withColumns({"pipeline": F.col("_m.pipeline"), "prediction": out}).drop("_m")


def scores(test: DataFrame, models: DataFrame) -> DataFrame:
    """Per pipeline of ``models`` (pipeline, kind, w, b) its score on its test rows (pipeline, x, y): accuracy or RMSE."""
    m = margin(F.col("x"), F.col("w"), F.col("b"))
    joined = test.join(models, "pipeline")
    out = joined.groupBy("pipeline", "kind").agg(accuracy(F.col("y"), m).alias("_accuracy"), rmse(F.col("y"), m).alias("_rmse"))
    return out.select("pipeline", "kind", F.when(F.col("kind") == "PA", F.col("_accuracy")).otherwise(F.col("_rmse")).alias("score"))


def responses(queries: DataFrame, models: DataFrame, scored: DataFrame, sentinel: bool = False) -> DataFrame:
    """(responseId, id, learner, protocol, dataFitted, score) for queries (requestId, pipeline)."""
    joined = queries.join(models, "pipeline").join(scored.select("pipeline", "score"), "pipeline", "left")
    score = F.coalesce("score", F.lit(NO_SCORE)) if sentinel else F.col("score")
    return joined.select(
        F.col("requestId").alias("responseId"),
        F.col("pipeline").alias("id"),
        F.struct(F.col("kind").alias("name"), F.col("w").alias("a"), F.col("b")).alias("learner"),
        F.lit("Asynchronous").alias("protocol"),
        F.col("fitted").alias("dataFitted"),
        score.alias("score"),
    )
