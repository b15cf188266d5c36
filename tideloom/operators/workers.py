"""Logical workers: assignment, holdout split, reservoir, mini-batch rounds, and per-round deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideloom.functions.ordered import with_position

HOLDOUT, BATCH, RESERVOIR = (8, 9), 64 * 4, 500


def assigned(df: DataFrame, workers: int, by: Column) -> DataFrame:
    return df.withColumn("worker", F.pmod(by, F.lit(workers)).cast("int"))


def holdout(df: DataFrame, order: str, keys: list[str] | None = None) -> DataFrame:
    """Adds ``position`` in the worker's stream and ``held``: of worker 0's every ten records the last two."""
    out = with_position(df, [*(keys or []), "worker"], order)
    return out.withColumn("held", (F.col("worker") == 0) & F.pmod("position", F.lit(10)).isin(*HOLDOUT))


def rounds(training: DataFrame, order: str, keys: list[str] | None = None, batch: int = BATCH) -> DataFrame:
    """Adds ``round``: so many training records per worker and synchronisation."""
    out = with_position(training, [*(keys or []), "worker"], order, "_n")
    return out.withColumn("round", F.floor(F.col("_n") / F.lit(batch)).cast("int")).drop("_n")


def mixed(key: Column, seed: int = 0) -> Column:
    """A multiplicative hash below 2**31 that SQL engines share."""
    return F.pmod((F.pmod(key, F.lit(1 << 31)) + seed) * F.lit(1103515245) + F.lit(12345), F.lit(1 << 31))


def reservoir(held: DataFrame, key: str, capacity: int = RESERVOIR, seed: int = 0) -> DataFrame:
    """The ``capacity`` records with the smallest hashes stay the test set; others go back to training.

    Sampling by hash needs no order and gives the same set on every run.  The smallest are found by a top-k per task, and
    every record is compared with the last of them.
    """
    rank = F.struct(mixed(F.col(key), seed).alias("h"), F.col(key).alias("k"))
    last = held.select(rank.alias("_r")).orderBy("_r").limit(capacity).agg(F.max("_r").alias("_last"))
    return held.join(F.broadcast(last), how="left").withColumn("kept", F.coalesce(rank <= F.col("_last"), F.lit(False))).drop("_last")


def _overflow(df: DataFrame, keys: list[str], order: str, capacity: int) -> DataFrame:
    """The last ``capacity`` records per key by ``order``."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    placed = with_position(df, keys, order, "_n")
    return placed.join(counts, keys).where(F.col("_n") >= F.col("_all") - capacity).drop("_n", "_all")


def oldest_out(df: DataFrame, keys: list[str], order: str, capacity: int) -> DataFrame:
    """The newest ``capacity`` records per key, as a buffer that drops its oldest keeps them."""
    return _overflow(df, keys, order, capacity)


def random_out(df: DataFrame, keys: list[str], order: str, capacity: int, seed: int = 0) -> DataFrame:
    """``capacity`` records per key that a buffer which drops at random may hold: those of the largest hashes."""
    return _overflow(df.withColumn("_h", mixed(F.col(order), seed)), keys, "_h", capacity).drop("_h")


def interleaved(buffers: DataFrame, keys: list[str], buffer: str, order: str) -> DataFrame:
    """Buffers merged into one: their first records in the buffers' order, then their second ones, and so on; adds ``place``."""
    each = with_position(buffers, [*keys, buffer], order, "_n")
    turn = each.groupBy(*keys, "_n").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    bases = turn.select(*keys, "_n", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    among = Window.partitionBy(*keys, "_n").orderBy(buffer)
    return each.join(bases, [*keys, "_n"]).withColumn("place", F.col("_base") + F.row_number().over(among) - 1).drop("_n", "_base")
