"""Mixing sources to target weights by systematic sampling.

Each source gets a share of a word budget by weight, stopped at ``most`` times its own size, with the excess shared
again by weight (water filling).  Its documents are laid on a line, each as long as its expected copies (target over
source size), one random offset is added per source, and a document is emitted once per integer boundary that its
stretch crosses.  The line runs through size classes, so words as well as documents come out near their target: the
words of a source miss it by about the size of one document.

Positions come from three levels of prefix sums: classes within a source, blocks (hashes of doc_id and text) within a
class, and rows within a block.  Only the last works on rows, and a block holds a few hundred, whatever one source or one
doc_id holds; only rows that are alike in both share a block.

Defined cases: a null text has size 0; a null source is a source of its own, the last; an empty table gives no rows;
a source without words has target 0 and no copies; repeated rows are separate documents; copies agree between reruns,
as the offset is drawn from the seed and the source's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, n_words, text_key

_KEYS = ["_src", "_cls"]


def _hex(text: Column) -> Column:
    """The first 32 bits of an MD5 as a number, a hash that SQL engines share."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _size_class(size: Column) -> Column:
    """Eight classes per doubling; sizes below 16 are their own class."""
    bits = F.length(F.bin(size))
    return F.when(size < 16, size).otherwise(16 + (bits - 5) * 8 + F.expr("shiftright(_size, length(bin(_size)) - 4) & 7")).cast("int")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(_src, _total) to (_src, _total, _target): one row per source."""
    order = Window.orderBy(F.col("_src").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    weighed = sources.withColumn("_w", turn).withColumn("_cap", F.lit(float(most)) * F.col("_total"))
    rising = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_src").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    return (
        weighed.withColumn("_budget", F.lit(float(share)) * F.sum("_total").over(all_rows))
        .withColumn(
            "_capped",
            F.coalesce(F.sum("_cap").over(before), F.lit(0.0)) + F.col("_cap") / F.col("_w") * F.sum("_w").over(onward) <= F.col("_budget"),
        )
        .withColumn("_spent", F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_cap"))).over(all_rows), F.lit(0.0)))
        .withColumn("_open", F.sum(F.when(~F.col("_capped"), F.col("_w"))).over(all_rows))
        .select(
            "_src",
            "_total",
            F.when(F.col("_capped"), F.col("_cap"))
            .otherwise(F.least(F.col("_cap"), F.col("_w") * ((F.col("_budget") - F.col("_spent")) / F.col("_open"))))
            .alias("_target"),
        )
    )


def _with_keys(docs: DataFrame) -> DataFrame:
    own = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    return docs.withColumns(
        {"_src": F.col("source"), "_size": n_words(F.col("text")), "_key": text_key(F.col("text")), "_hash": _hex(own)}
    ).withColumn("_cls", _size_class(F.col("_size")))


def _in_block(rows: DataFrame, subs: int) -> DataFrame:
    return rows.withColumn("_sub", F.col("_hash") % F.lit(subs))


def plan(docs: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: str, rows_each: int = 256):
    """Per block (_src, _cls, _sub): rows of the source before it, expected copies, offset, target; and the narrow rows."""
    rows = durable(_with_keys(docs.select("doc_id", "text", "source")).drop("text", "source"), "mix-sizes")
    largest = rows.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    subs = max(1, -(-largest // rows_each))
    blocks = durable(_in_block(rows, subs).groupBy(*_KEYS, "_sub").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_words")), "mix-blocks")

    classes = blocks.groupBy(*_KEYS).agg(F.sum("_n").alias("_n"), F.sum("_words").alias("_words"))
    lower = Window.partitionBy("_src").orderBy("_cls").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*_KEYS).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    sums = targets(classes.groupBy("_src").agg(F.sum("_words").alias("_total")), weights, share, most)
    offset = _hex(F.concat(F.lit(seed), F.coalesce(F.col("_src"), F.lit("")))) / F.lit(float(1 << 32))
    per_class = (
        classes.withColumn("_low", F.coalesce(F.sum("_n").over(lower), F.lit(0)))
        .alias("c")
        .join(sums.alias("s"), F.col("c._src").eqNullSafe(F.col("s._src")))
        .select(
            F.col("c._src").alias("_src"),
            "_cls",
            "_low",
            "_total",
            "_target",
            F.when(F.col("_total") > 0, F.col("_target") / F.col("_total")).otherwise(F.lit(0.0)).alias("_rate"),
        )
        .withColumn("_offset", offset)
    )
    out = (
        blocks.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .alias("b")
        .join(per_class.alias("c"), F.col("b._src").eqNullSafe(F.col("c._src")) & (F.col("b._cls") == F.col("c._cls")))
        .select("b._src", "b._cls", "b._sub", (F.col("_low") + F.col("_base")).alias("_base"), "_total", "_target", "_rate", "_offset")
    )
    return out, rows, subs


def _copies(rows: DataFrame, blocks: DataFrame, most: float) -> DataFrame:
    """``rows`` (with block keys) and their copies, target and source size."""
    names = ["_src", "_cls", "_sub"]
    right = blocks.select(*[F.col(n).alias(f"{n}_b") for n in names], "_base", "_total", "_target", "_rate", "_offset")
    joined = rows.join(right, F.col("_src").eqNullSafe(F.col("_src_b")) & (F.col("_cls") == F.col("_cls_b")) & (F.col("_sub") == F.col("_sub_b")))
    rank = F.col("_base") + F.row_number().over(Window.partitionBy(*names).orderBy("_size", F.col("doc_id").asc_nulls_last(), "_key"))
    numbered = joined.withColumn("_rank", rank)
    reach = lambda r: F.floor(F.col("_rate") * r + F.col("_offset"))
    crossed = reach(F.col("_rank")) - reach(F.col("_rank") - 1)
    return numbered.withColumn("copies", F.least(crossed, F.lit(int(most))).cast("int"))


def mix_report(docs: DataFrame, weights=(5, 2, 1), share=1.5, most=2.0, seed="mix-1:") -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's), taken and copies."""
    blocks, rows, subs = plan(docs, weights, share, most, seed)
    return _copies(_in_block(rows, subs), blocks, most).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_total").cast("long").alias("source_size"),
        F.col("_target").cast("double").alias("target"),
        (F.col("copies") * F.col("_size")).cast("long").alias("taken"),
        F.col("copies"),
    )


def mix(docs: DataFrame, weights=(5, 2, 1), share=1.5, most=2.0, seed="mix-1:") -> DataFrame:
    """The mixed documents themselves: each row as often as it is drawn, with the columns of ``docs``."""
    blocks, _, subs = plan(docs, weights, share, most, seed)
    own = docs.select("doc_id", "text", "source", F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    out = _copies(_in_block(_with_keys(own).drop("text", "source"), subs), blocks, most).where(F.col("copies") > 0)
    each = out.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_copy"))
    return each.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
