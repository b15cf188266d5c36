"""MinHash near-dedup by an LSH forest.

Every document's set of word shingles gives 128 minima, read as 32 hashes of four.  Tree t sorts the documents by the
hashes t, t+1, t+2: documents next to each other share the longest prefix, and sharing the first hash (four minima)
makes them candidates.  Where a region is crowded, its members are ordered by eight and twelve minima, so the depth at
which neighbours meet adapts to the region.  Each document meets the next ``reach`` documents of its region in each
tree.  Regions with more documents than that and several components are finished exactly: every pair of their members
in different components is compared, by size and by parity sketches, which refuse no pair that is similar enough.
Candidates are confirmed on the full shingle sets, links become components.  So two similar documents are missed only
if they share none of the 32 regions.

Work that grows with the square of a group of copies is avoided: documents with equal sets fall together first (a
partial aggregate) and stand behind the one with the smallest doc_id, and pairs inside a region's largest component
are never formed.  Sketches of the members outside it meet those of all members, in blocks; twice only the nearest of
other components become rows, which joins most, and then every pair that is left.

Trees are range-partitioned by the whole sort key, so a region that holds a third of all rows spreads over ranges;
the first and last rows of each range are matched across the border.  Sets are recomputed from the texts of
candidates only, found through a bitmap of fixed size.

Documents without words have an empty set and link with nothing.  Defined cases: null text is empty; a null doc_id
can't be named in a link, has no component and is kept; repeated rows of a doc_id are one node; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, lean, partitions_for, settled, sized_join
from .components import connected_components, merged_components
from .shingles import mix, set_digest, shingle_sets

TREES, DEPTH = 32, 4
#: Members of a crowded region in a block, and 64-bit words of a set's parity sketch.
BLOCK, WORDS = 4_000, 32
#: Slots of the bitmap that finds the texts of candidates; 64 ids to a slot.
SLOTS = 1 << 17
_U = np.uint64


def _multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1)


def region_hashes(sets: list[np.ndarray], seed: int = 7) -> np.ndarray:
    """32 hashes of four minima for each non-empty set: sets x TREES, signed."""
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), TREES), dtype=np.uint64)
    factors = _multipliers(TREES * DEPTH, seed)
    for t in range(TREES):
        h = np.full(len(sets), t + 1, dtype=np.uint64)
        for a in factors[t * DEPTH : (t + 1) * DEPTH]:
            h = mix(h + np.minimum.reduceat(flat * a, starts))
        out[:, t] = h
    return out.view(np.int64)


def _signer(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, held, size = b["doc_id"].to_numpy(), [], 0

            def flush(held):
                full = [s for _, s in held if len(s)]
                regions = iter(region_hashes(full)) if full else iter(())
                rows = [(i, len(s), *set_digest(s), next(regions) if len(s) else []) for i, s in held]
                frame = pd.DataFrame(rows, columns=["doc_id", "n_shingles", "s1", "s2", "regions"])
                return frame.astype({"doc_id": "Int64"})

            for i, s in zip(ids, shingle_sets(b["text"], width)):
                held.append((None if pd.isna(i) else int(i), s))
                size += len(s)
                if size > 1 << 17:
                    yield flush(held)
                    held, size = [], 0
            if held:
                yield flush(held)

    return run


def signatures(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, regions): the set's size, its two digests, and its 32 region hashes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(lean(_signer(width)), "doc_id long, n_shingles long, s1 long, s2 long, regions array<long>")


_MET = "kind int, a long, b long, range int, region long, place int"
PAIR, TAIL, HEAD, CROWDED = range(4)


def _neighbours(reach: int):
    """Pairs within ``reach`` of each other in a region, rows at a range's borders, and members of crowded regions."""

    def rows(kind, rep, other, number, region, place) -> pd.DataFrame:
        return pd.DataFrame({"kind": kind, "a": rep, "b": other, "range": number, "region": region, "place": place})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [batch[["region", "rep"]].to_numpy(np.int64) for batch in batches]
        if not sum(map(len, held)):
            return
        region, rep = np.concatenate(held).T.copy()  # a range: a few hundred thousand rows
        number, n = TaskContext.get().partitionId(), len(rep)
        a, b = [], []
        for d in range(1, min(reach, n - 1) + 1):
            i = np.flatnonzero(region[d:] == region[:-d])
            a.append(np.minimum(rep[i], rep[i + d]))
            b.append(np.maximum(rep[i], rep[i + d]))
        if a and sum(map(len, a)):
            pairs = pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()
            yield rows(PAIR, pairs["a"], pairs["b"], 0, 0, 0)
        for kind, part in ((HEAD, slice(0, reach)), (TAIL, slice(max(0, n - reach), n))):
            place = np.arange(n)[part] if kind == HEAD else n - 1 - np.arange(n)[part]
            yield rows(kind, rep[part], rep[part], number, region[part], place)
        start = np.flatnonzero(np.concatenate(([True], region[1:] != region[:-1])))
        length = np.diff(np.append(start, n))
        large = length > reach + 1
        large[[0, -1]] = True  # they may go on beyond the border
        m = np.flatnonzero(np.repeat(large, length))
        for at in range(0, len(m), 10_000):
            k = m[at : at + 10_000]
            yield rows(CROWDED, rep[k], rep[k], number, region[k], 0)

    return run


def forest(reps: DataFrame, reach: int) -> tuple[DataFrame, DataFrame]:
    """All trees over ``reps`` (rep, regions): pairs (a, b) with a < b, and the members (region, rep) of crowded regions."""
    at = lambda k: f"get(regions, (t + {k}) % {TREES})"
    each = f"explode(transform(sequence(0, {TREES - 1}), t -> struct({at(0)} AS region, {at(1)} AS k1, {at(2)} AS k2)))"
    trees = reps.select("rep", F.expr(each).alias("_t")).select("rep", "_t.*")
    rows = reps.count() * TREES
    ranges = max(1, min(partitions_for(reps.sparkSession, rows, 400_000), rows // 10_000))
    key = ["region", "k1", "k2", "rep"]
    met = durable(trees.repartitionByRange(ranges, *key).sortWithinPartitions(*key).mapInPandas(lean(_neighbours(reach)), _MET), "forest-neighbours")
    tails = met.where(F.col("kind") == TAIL).select(F.col("a").alias("x"), "region", (F.col("range") + 1).alias("range"), F.col("place").alias("back"))
    heads = met.where(F.col("kind") == HEAD).select(F.col("a").alias("y"), "region", "range", "place")
    border = 2 * reach * ranges
    across = settled(settled(tails, border).join(settled(heads, border), ["region", "range"]), border).where(F.col("back") + F.col("place") < reach)
    across = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = met.where(F.col("kind") == PAIR).select("a", "b").unionByName(across).where("a <> b")
    members = met.where(F.col("kind") == CROWDED).select("region", F.col("a").alias("rep"))
    return settled(pairs, met.count()).distinct(), members


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "set": [s.tobytes() for s in shingle_sets(b["text"], width)]})

    return run


def _confirm(part: int, whole: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = []
            for x, y in zip(b["x"], b["y"]):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                if whole * min(len(x), len(y)) < part * max(len(x), len(y)):  # too different in size
                    ok.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(whole * both >= part * (len(x) + len(y) - both))
            yield b.loc[ok, ["a", "b"]]

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, part: int, whole: int, rows: int) -> DataFrame:
    """The pairs whose sets share at least part/whole of their union; ``rows``: how many pairs there are at most."""
    x = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y"))
    both = sized_join(sized_join(pairs.select("a", "b"), x, "a", rows, 5_000), y, "b", rows, 5_000)
    return both.mapInPandas(lean(_confirm(part, whole)), "a long, b long")


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id may be among ``ids``: at most SLOTS x 64 bits are broadcast, whatever the corpus."""
    bit = lambda c: F.pmod(F.xxhash64(F.lit(5), c), F.lit(SLOTS * 64))
    marked = ids.select(bit(F.col("doc_id")).alias("_bit")).groupBy(F.expr("_bit div 64").alias("_slot")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_bit % 64 as int))")).alias("_bits")
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_bit", bit(F.col("doc_id")))
    rows = rows.withColumn("_slot", F.expr("_bit div 64")).join(F.broadcast(marked), "_slot")
    return rows.where("(shiftright(_bits, cast(_bit % 64 as int)) & 1) = 1").select("doc_id", "text")


def _split(members: DataFrame, components: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """Members (region, rep) of regions with several components, with their component; and how many."""
    if not rows:
        return members, 0
    own = components.select(F.col("node").alias("rep"), F.col("component").alias("_c"))
    placed = settled(members.drop("component").join(own, "rep", "left"), rows).withColumn("component", F.coalesce("_c", "rep")).drop("_c")
    placed = durable(placed, "crowded")
    several = placed.groupBy("region").agg(F.min("component").alias("_l"), F.max("component").alias("_h")).where("_l < _h").select("region")
    out = durable(settled(placed.join(settled(several, rows), "region", "left_semi"), rows), "crowded")
    discard(placed)
    return out, out.count()


def parity_sketch(own: np.ndarray) -> bytes:
    """Every element flips one of the bits: two sketches differ in at most as many bits as their sets in elements."""
    odd = np.bincount((mix(own) % _U(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        sets = [np.frombuffer(s, dtype=np.uint64) for s in b["set"]]
        yield pd.DataFrame({"rep": b["doc_id"], "n": [len(s) for s in sets], "sketch": [parity_sketch(s) for s in sets]})


def _cells(members: DataFrame, rows: int) -> DataFrame:
    """Members (region, rep, component) dealt to cells (region, i, j).

    The left side of a cell is a block of those outside the region's largest component, the right side one of all.
    """
    sizes = settled(members.groupBy("region", "component").agg(F.count(F.lit(1)).alias("_n")), rows)
    main = settled(sizes.groupBy("region").agg(F.sum("_n").alias("_all"), F.max(F.struct("_n", "component")).alias("_m")), rows)
    main = main.select("region", F.ceil(F.col("_all") / BLOCK).alias("_js"), F.ceil((F.col("_all") - F.col("_m._n")) / BLOCK).alias("_is"), F.col("_m.component").alias("_main"))
    placed = settled(members.join(main, "region"), rows).withColumn("outside", F.col("component") != F.col("_main"))
    own = lambda k, seed: F.pmod(F.xxhash64(F.lit(seed), "rep"), F.col(k)).alias(k[1])
    each = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1)).alias(k[1])
    side = lambda left: F.lit(left).alias("left")
    right = placed.select("region", "rep", "component", "outside", side(False), own("_js", 1), each("_is"))
    left = placed.where("outside").select("region", "rep", "component", "outside", side(True), own("_is", 2), each("_js"))
    return left.unionByName(right)


def _compare(part: int, whole: int, nearest: bool):
    """Pairs of different components in a cell that may be similar enough; or of each left row only the nearest.

    A pair with part/whole of its union in common differs in at most (whole - part) / (whole + part) of its sizes' sum.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        t = pd.concat(held, ignore_index=True).sort_values(["region", "i", "j", "left", "n"], ignore_index=True)
        cell = t[["region", "i", "j"]].to_numpy(np.int64)
        rep, component, n = (t[c].to_numpy(np.int64) for c in ("rep", "component", "n"))
        left, outside = t["left"].to_numpy(bool), t["outside"].to_numpy(bool)
        bits = np.frombuffer(b"".join(t["sketch"]), dtype=np.uint64).reshape(len(t), WORDS)
        start = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]).any(1))))
        a, b, size = [], [], 0
        for lo, hi in zip(start, np.append(start[1:], len(t))):
            mid = lo + int(np.searchsorted(left[lo:hi], True))  # right rows by size, then left ones
            for x in range(mid, hi):
                k = np.arange(lo + np.searchsorted(n[lo:mid], -(-part * n[x] // whole)), lo + np.searchsorted(n[lo:mid], whole * n[x] // part, "right"))
                keep = component[k] != component[x]
                if not nearest:  # two outside ones meet from both sides
                    keep &= ~outside[k] | (rep[k] > rep[x])
                k = k[keep]
                differ = np.bitwise_count(bits[k] ^ bits[x]).sum(1, dtype=np.int64)
                may = (whole + part) * differ <= (whole - part) * (n[k] + n[x])
                k = k[may]
                if nearest and len(k):
                    k = k[[np.argmin(differ[may] / (n[k] + n[x]))]]
                a.append(np.minimum(rep[k], rep[x]))
                b.append(np.maximum(rep[k], rep[x]))
                size += len(k)
            if size > 100_000:
                yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()
                a, b, size = [], [], 0
        if size:
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()

    return run


def _finish(members: DataFrame, rows: int, sketches: DataFrame, part: int, whole: int, nearest: bool) -> DataFrame:
    """Pairs (a, b) with a < b of ``members`` (region, rep, component) in different components of a region."""
    dealt = durable(_cells(members, rows), "cells")
    tasks = max(1, -(-dealt.count() // 5_000))
    return dealt.join(sketches, "rep").repartition(tasks, "region", "i", "j").mapInPandas(lean(_compare(part, whole, nearest)), "a long, b long")


def link(docs: DataFrame, width: int = 5, part: int = 75, whole: int = 100, reach: int = 2) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    signed = durable(signatures(docs, width), "signatures")
    named = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    groups = named.groupBy("s1", "s2", "n_shingles").agg(F.min(F.struct("doc_id", "regions")).alias("_g"))
    groups = durable(groups.select("s1", "s2", "n_shingles", F.col("_g.doc_id").alias("rep"), F.col("_g.regions").alias("regions")), "equal-sets")
    pairs, crowded = forest(groups.select("rep", "regions"), reach)
    pairs = durable(pairs, "candidates")
    n_pairs = pairs.count()

    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    sets = durable(_texts_of(docs, ends).mapInPandas(lean(_sets(width)), "doc_id long, set binary"), "candidate-sets")
    links = durable(confirmed(pairs, sets, part, whole, n_pairs), "links")
    found = durable(connected_components(links), "components")

    # regions that hold several components: the nearest of other components twice, then every pair that is left
    members, n, tried, sketches, used = crowded, crowded.count(), pairs, None, [pairs, sets, links]
    for nearest in (True, True, False):
        members, n = _split(members, found, n)
        if not n:
            break
        if sketches is None:
            reps = settled(members.select(F.col("rep").alias("doc_id")).distinct(), n)
            sketches = durable(settled(sets.join(reps, "doc_id", "left_semi"), n, 5_000).mapInPandas(lean(_sketches), "rep long, n long, sketch binary"), "sketches")
        met = durable(_finish(members, n, sketches, part, whole, nearest), "met")
        n_met = met.count()
        used += [members, sketches, met]
        fresh = durable(settled(settled(met, n_met).distinct().join(tried, ["a", "b"], "left_anti"), n_met), "candidates")
        new = durable(confirmed(fresh, sets, part, whole, fresh.count()), "links")
        tried = tried.unionByName(fresh)
        used += [fresh, new]
        if not new.isEmpty():
            used.append(found)
            found = durable(merged_components(found, new, found.count()), "components")
    discard(*used)

    placed = groups.drop("regions").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    placed = placed.select("s1", "s2", F.col("n_shingles").alias("_n"), F.coalesce("component", "rep").alias("component"))
    joined = signed.drop("regions").join(
        placed, (signed["s1"] == placed["s1"]) & (signed["s2"] == placed["s2"]) & (F.col("n_shingles") == F.col("_n")), "left"
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("component"), F.col("doc_id")))
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stand for their component, with their own columns."""
    lost = link(docs.select("doc_id", "text"), **options).where(~F.col("kept")).select(F.col("doc_id").alias("_lost")).distinct()
    return docs.join(lost, docs["doc_id"] == lost["_lost"], "left_anti")
