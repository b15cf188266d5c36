"""Positions and running sums along an order within keys, without one task per key.

Rows are cut into blocks by ranges of the order column, as wide as they have to be to hold ``block`` rows on average,
whether its values are dense (numbers) or sparse (times).  Block totals are partial aggregates; totals of earlier blocks
are summed over the block table, which is smaller by the rows of a block; only rows of one block share a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 4096


def _matched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(named, condition).drop(*[f"_r_{k}" for k in keys])


def running(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """Adds, for each name, the sum of its column over the rows of ``keys`` up to and with the current one.

    ``order`` is a number that tells the rows of a key apart.
    """
    facts = df.agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count(order).alias("n")).first()
    span = max(1.0, (float(facts["high"]) - float(facts["low"]) + 1.0) / facts["n"]) * block if facts["n"] else 1.0
    low = float(facts["low"]) if facts["n"] else 0.0
    cut = df.withColumn("_block", F.floor((F.col(order) - F.lit(low)) / F.lit(span)).cast("long")).withColumns({f"_in_{n}": c for n, c in sums.items()})
    here, names = [*keys, "_block"], list(sums)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut.groupBy(*here).agg(*[F.sum(f"_in_{n}").alias(f"_sum_{n}") for n in names])
    blocks = blocks.select(*here, *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_low_{n}") for n in names])
    upto = Window.partitionBy(*here).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = _matched(cut, blocks, here)
    out = joined.withColumns({n: F.col(f"_low_{n}") + F.coalesce(F.sum(f"_in_{n}").over(upto), F.lit(0)) for n in names})
    return out.drop("_block", *[f"_in_{n}" for n in names], *[f"_low_{n}" for n in names])


def with_position(df: DataFrame, keys: list[str], order: str, name: str = "position", block: int = BLOCK) -> DataFrame:
    """Adds the row's place (from 0) among the rows of ``keys`` by ``order``."""
    out = running(df, keys, order, {name: F.lit(1).cast("long")}, block)
    return out.withColumn(name, F.col(name) - 1)
