"""Line dedup [native]: first holders of a line keep it, later documents lose it.

Line hashes are range-partitioned and sorted by (hash, document, position); a running window streams the first
holder of each hash past its later lines.  What comes back is a compressed keep bitmap per document, never text.

A hash so frequent that it would burden one range is found exactly beforehand: counts of hash slices (a partial
aggregate) name the slices that can hold one, and only these slices are counted by hash.  A hash counts as frequent
from total / (4 x ranges) lines on, and from total / ``FREQUENT`` on at the most, so at most ``FREQUENT`` hashes can pass,
whatever the corpus; their owners are broadcast and their lines never enter the ranges.

Defined cases: a null text is one empty line; a null ``doc_id`` orders after all others and all null ids are one
document; rows that repeat a doc_id are one document, each row keeps its own output row; a key found only within one
document loses nothing; columns besides ``doc_id`` and ``text`` are carried through ``apply_bitmaps`` whatever their
names, and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, ascii_lower, durable, partitions_for, text_key

#: Frequent hashes at most (32 bytes each go out), and slices per frequent hash: a slice that is full holds many times its share.
FREQUENT, SLICES = 1 << 18, 16


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(_doc, _text, _pos, _h1, _h2) of every line whose key has at least ``min_chars`` code points."""
    lines = docs.select(
        F.col("doc_id").alias("_doc"),
        text_key(F.col("text")).alias("_text"),
        F.posexplode(split_lines(ascii_lower(F.col("text")))).alias("_pos", "_line"),
    )
    key = F.btrim(F.col("_line"), F.lit(SPACES))
    return lines.where(F.char_length(key) >= min_chars).select(
        "_doc", "_text", "_pos", F.xxhash64(F.lit(1), key).alias("_h1"), F.xxhash64(F.lit(2), key).alias("_h2")
    )


def _frequent(lines: DataFrame, least: int, most: int) -> DataFrame:
    """Hashes on at least ``least`` lines, with their smallest document: at most ``most``, as there are no more than ``most x least`` lines."""
    slices = max(1 << 16, SLICES * most)
    slot = F.pmod(F.col("_h1"), F.lit(slices))
    full = lines.groupBy(slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("_slot")
    return (
        lines.withColumn("_slot", slot)
        .join(F.broadcast(full), "_slot", "left_semi")
        .groupBy("_h1", "_h2")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_doc").alias("_owner"))
        .where(F.col("_n") >= least)
        .select("_h1", "_h2", "_owner")
    )


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """One row per document that loses lines: _doc, _text, n_dropped, _keep.

    ``_keep`` holds 64 lines per word, a set bit keeps the line; words after the last that drops one are left out.
    """
    spark = docs.sparkSession
    lines = durable(line_hashes(docs, min_chars), "line-hashes")
    total = lines.count()
    parts = partitions_for(spark, total, 1_000_000)
    most = min(4 * parts, FREQUENT)
    hot = F.broadcast(durable(_frequent(lines, max(64, -(-total // most)), most), "frequent-lines"))

    first = Window.partitionBy("_h1", "_h2").orderBy(F.col("_doc").asc_nulls_last(), F.col("_pos").asc())
    ranged = (
        lines.join(hot, ["_h1", "_h2"], "left_anti")
        .repartitionByRange(parts, "_h1", "_h2")
        .sortWithinPartitions(F.col("_h1"), F.col("_h2"), F.col("_doc").asc_nulls_last(), F.col("_pos").asc())
        .withColumn("_owner", F.first("_doc").over(first.rowsBetween(Window.unboundedPreceding, 0)))
    )
    known = lines.join(hot, ["_h1", "_h2"])
    columns = ["_doc", "_text", "_pos"]
    gone = ranged.where(~F.col("_doc").eqNullSafe(F.col("_owner"))).select(*columns)
    gone = gone.unionByName(known.where(~F.col("_doc").eqNullSafe(F.col("_owner"))).select(*columns))

    words = gone.groupBy("_doc", "_text", F.expr("_pos div 64").cast("int").alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, _pos % 64)")).alias("_bits")
    )
    sparse = words.groupBy("_doc", "_text").agg(
        F.array_sort(F.collect_list(F.struct("_word", "_bits"))).alias("_words"),
        F.sum(F.bit_count("_bits")).cast("long").alias("n_dropped"),
    )
    # gaps between words that drop lines are filled with all-ones words
    return sparse.select(
        "_doc",
        "_text",
        "n_dropped",
        F.expr(
            "flatten(transform(_words, (w, i) -> concat("
            "array_repeat(-1L, w._word - if(i = 0, -1, get(_words, i - 1)._word) - 1), array(~w._bits))))"
        ).alias("_keep"),
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept`` (the text that remains), which replace columns so named."""
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_own"), text_key(F.col("text")).alias("_own_key"))
    joined = own.join(bitmaps, F.col("_own").eqNullSafe(F.col("_doc")) & (F.col("_own_key") == F.col("_text")), "left")
    kept = F.expr(
        "array_join(filter(split(coalesce(_row.text, ''), '\\n', -1), "
        "(x, i) -> (shiftright(coalesce(get(_keep, i div 64), -1L), i % 64) & 1) = 1), '\\n')"
    )
    made = {
        "n_lines": F.size(split_lines(F.col("_row.text"))).cast("long"),
        "n_dropped": F.coalesce(F.col("n_dropped"), F.lit(0)).cast("long"),
        "kept": F.when(F.col("_keep").isNull(), F.coalesce(F.col("_row.text"), F.lit(""))).otherwise(kept),
    }
    carried = [F.col("_row")[c].alias(c) for c in docs.columns if c.lower() not in made]
    return joined.select(*carried, *[c.alias(n) for n, c in made.items()])


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Every row of ``docs`` with its remaining lines in ``kept`` and both counts."""
    return apply_bitmaps(docs, keep_bitmaps(docs.select("doc_id", "text"), min_chars))
