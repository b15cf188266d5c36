"""Connected components by alternating large and small stars, all in DataFrames.

Each round links every node's larger neighbours to its smallest one, then its smaller neighbours likewise, until the
edges stand still as stars.  Minima are partial aggregates and a hub's edges are one side of a join against one row,
which skew handling can split; rounds are written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, settled


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = settled(both.groupBy("u").agg(F.min("v").alias("m")), rows).select("u", F.least("u", "m").alias("m"))
    return settled(both.join(low, "u"), rows).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    low = settled(edges.groupBy("u").agg(F.min("v").alias("m")), rows)
    moved = settled(edges.join(low, "u"), rows).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b) links of any orderable type to (node, component): every linked node with the smallest node it reaches.

    Null ends and links of a node to itself are ignored; repeated links count once.
    """
    now = durable(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), "links")
    first, seen = now, None
    now = durable(settled(first, first.count()).distinct(), "links")
    discard(first)
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or (state["n"], state["h"]) == seen:
            break
        seen, n = (state["n"], state["h"]), state["n"]
        large, last = durable(settled(_large_star(settled(now, n), n).distinct(), n), "links"), now
        now = durable(settled(_small_star(large, n).distinct(), n), "links")
        discard(large, last)
    centres = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)


def merged_components(found: DataFrame, links: DataFrame, rows: int) -> DataFrame:
    """``found`` (node, component; ``rows`` of them) after more links (a, b): only the components they join are worked on."""
    side = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    ends = settled(settled(links.join(side("a"), "a", "left"), rows).join(side("b"), "b", "left"), rows)
    joined = connected_components(ends.select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b")))
    moved = durable(joined.select(F.col("node").alias("component"), F.col("component").alias("_to")), "joined")
    kept = settled(found.join(moved, "component", "left"), rows).select("node", F.coalesce("_to", "component").alias("component"))
    fresh = moved.join(found, moved["component"] == found["node"], "left_anti").select(F.col("component").alias("node"), F.col("_to").alias("component"))
    return kept.unionByName(settled(fresh, rows))
