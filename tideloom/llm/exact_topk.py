"""Exact top-k search by inner product over integer vectors.

Candidates are processed by descending length.  Query and candidate are turned into a basis of singular vectors of
all candidates (eigenvectors of their Gram matrix, summed over the whole table), where a few leading components hold
most of a product; the rest is bounded by Cauchy-Schwarz on the residual lengths.  A pair is scored in full only if
its bound reaches the query's current k-th score.  Bounds carry a margin above float error, and scores are exact
integers, so no pair is lost.

The globally longest ``seeds`` candidates are scored first: their k-th score is where a query's search starts.  All
candidates are dealt to classes of length, and classes to parts of about ``part`` rows by a hash, so vectors of one
length spread.  Queries are dealt to blocks of about ``block`` by a hash, and each goes only to the classes that its
length bound can reach.  A task meets a block's queries with a part's candidates, which stream by, longest first:
whatever the number of queries, none passes the driver, and plan and memory stay the same.

Defined cases: vectors null or holding null or non-finite components, and rows with a null vec_id, take no part;
vectors of unequal length are compared as if padded with zeros, so an empty vector scores 0; repeated rows count
once; a query meets every row but those with its own vec_id; an id that has several different vectors queries with
each of them, and is one candidate per vector; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_EXACT = float(1 << 53)


def usable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embedding.isNotNull() & F.coalesce(finite, F.lit(False))


def padded(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def stacked(vectors, width: int) -> np.ndarray:
    """Rows as a float64 matrix; the common case of equal lengths takes one copy."""
    if len(vectors) and all(len(v) == width for v in vectors):
        return np.concatenate(list(vectors)).astype(np.float64).reshape(len(vectors), width)
    return padded(vectors, width)


def scaled(vectors, width: int, scale: float) -> np.ndarray:
    return np.floor(stacked(vectors, width) * scale)


def distinct_rows(part: pd.DataFrame) -> pd.DataFrame:
    """Without rows that repeat both id and vector; ids that are distinct already cost one look."""
    if part["vec_id"].is_unique:
        return part
    return part[~pd.Series([(i, np.asarray(v).tobytes()) for i, v in zip(part["vec_id"], part["embedding"])], index=part.index).duplicated()]


def _gram_of(width: int, scale: float):
    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for b in batches:
            x = scaled(b["embedding"].to_numpy(), width, scale)
            total += x.T @ x
        i, j = np.divmod(np.arange(width * width), width)
        yield pd.DataFrame({"i": i, "j": j, "x": total.ravel()})

    return gram


def rotation(vectors: DataFrame, width: int, scale: float) -> np.ndarray:
    """Right singular vectors of the whole table of vectors: the driver gets width x width sums."""
    sums = vectors.mapInPandas(_gram_of(width, scale), "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x"))
    gram = np.zeros((width, width))
    for row in sums.collect():
        gram[row["i"], row["j"]] = row["x"]
    return np.linalg.eigh(gram)[1][:, ::-1].copy()


class Best:
    """The k best (score descending, id ascending) of every query so far."""

    def __init__(self, queries: int, k: int, least: np.ndarray | None = None):
        self.k, self.query = k, np.empty(0, dtype=np.int64)
        self.vec, self.score = np.empty(0, dtype=np.int64), np.empty(0)
        self.least = np.full(queries, -np.inf) if least is None else least.astype(float)

    def add(self, query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        if not len(query):
            return
        query, vec, score = (np.concatenate(x) for x in ((self.query, query), (self.vec, vec), (self.score, score)))
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        new = np.ones(len(query), dtype=bool)
        new[1:] = (query[1:] != query[:-1]) | (vec[1:] != vec[:-1]) | (score[1:] != score[:-1])
        query, vec, score = query[new], vec[new], score[new]
        first = np.searchsorted(query, query)
        place = np.arange(len(query)) - first
        keep = place < self.k
        self.query, self.vec, self.score = query[keep], vec[keep], score[keep]
        full = place[keep] == self.k - 1
        self.least[self.query[full]] = np.maximum(self.least[self.query[full]], self.score[full])


def _exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise integer products; beyond 2**53 in Python integers."""
    largest = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    if largest < _EXACT:
        return np.einsum("ij,ij->i", q, x)
    big = lambda m: np.array([[int(v) for v in r] for r in m], dtype=object)
    out = (big(q) * big(x)).sum(axis=1)
    if any(not -(1 << 63) <= v < 1 << 63 for v in out):
        raise OverflowError("an inner product doesn't fit a 64-bit integer")
    return out


def search_block(q_ids: np.ndarray, q: np.ndarray, basis: np.ndarray, k: int, lead: int, best: Best, ids: np.ndarray, x: np.ndarray) -> None:
    """Meets all queries with one chunk of candidates (descending lengths)."""
    q_turned, x_turned = q @ basis, x @ basis
    q_len, x_len = np.sqrt((q**2).sum(1)), np.sqrt((x**2).sum(1))
    q_rest, x_rest = np.sqrt((q_turned[:, lead:] ** 2).sum(1)), np.sqrt((x_turned[:, lead:] ** 2).sum(1))
    slack = 1e-9 * q_len * x_len.max(initial=0) + 1e-6
    live = np.flatnonzero(q_len * x_len.max(initial=0) + slack >= best.least)
    for part in np.array_split(live, max(1, -(-len(live) * len(ids) // 2_000_000))):
        if not len(part):
            continue
        bound = q_turned[part, :lead] @ x_turned[:, :lead].T
        own = q_ids[part][:, None] == ids[None, :]
        least = best.least[part]
        if np.isinf(least).any() and len(ids) > k:  # a first idea of the k-th score: full products of this chunk
            full = q[part] @ x.T
            full[own] = -np.inf
            kth = np.partition(full, len(ids) - k, axis=1)[:, len(ids) - k]
            least = np.maximum(least, kth - slack[part])
        bound += q_rest[part][:, None] * x_rest[None, :]
        bound[own] = -np.inf
        r, c = np.nonzero(bound + slack[part][:, None] >= least[:, None])
        r, c = r[(alive := ~own[r, c])], c[alive]
        for at in range(0, len(r), 1 << 18):
            rr, cc = r[at : at + (1 << 18)], c[at : at + (1 << 18)]
            score = _exact_products(q[part[rr]], x[cc])
            good = score >= np.maximum(best.least[part[rr]], least[rr])
            best.add(part[rr[good]], ids[cc[good]], score[good])


def _seeder(seeds, width: int, scale: float, k: int):
    """Adds ``least``: a query's k-th score among the seeds with other ids (no bound where there are fewer)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, x = seeds.value
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.iloc[at : at + 1024]
                least = np.full(len(part), -np.inf)
                if len(ids) > k:
                    q = scaled(part["embedding"].to_numpy(), width, scale)
                    score = q @ x.T
                    score[part["vec_id"].to_numpy(np.int64)[:, None] == ids[None, :]] = -np.inf
                    least = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
                    least -= 1e-9 * np.abs(least) + 1e-6 + 1e-9 * np.sqrt((q**2).sum(1)) * np.sqrt((x**2).sum(1)).max(initial=0)
                yield part.assign(least=least)

    return run


def _searcher(basis, width: int, scale: float, k: int, lead: int, chunk: int):
    """Rows sorted by (_block, _part), queries before candidates, candidates by descending length."""

    def found(ids: np.ndarray, best: Best) -> pd.DataFrame:
        return pd.DataFrame({"query_id": ids[best.query], "vec_id": best.vec, "score": best.score.astype(object)}).astype({"score": "int64"})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turned, now, asked, best, ids, q = basis.value, None, [], None, None, None
        for b in batches:
            key = b["_block"].to_numpy(np.int64) * (1 << 32) + b["_part"].to_numpy(np.int64)
            turn = key * 2 + b["_candidate"].to_numpy(np.int64)
            edge = np.flatnonzero(np.concatenate(([True], turn[1:] != turn[:-1])))
            for lo, hi in zip(edge, np.append(edge[1:], len(b))):
                if key[lo] != now:
                    if best is not None:
                        yield found(ids, best)
                    now, asked, best = key[lo], [], None
                if turn[lo] % 2 == 0:
                    asked.append(b.iloc[lo:hi])
                    continue
                if not asked:  # no query reaches this part
                    continue
                if best is None:
                    held = pd.concat(asked, ignore_index=True)
                    ids, q = held["vec_id"].to_numpy(np.int64), scaled(held["embedding"].to_numpy(), width, scale)
                    best = Best(len(ids), k, held["least"].to_numpy(float))
                for at in range(lo, hi, chunk):
                    part = distinct_rows(b.iloc[at : min(at + chunk, hi)])
                    x = scaled(part["embedding"].to_numpy(), width, scale)
                    search_block(ids, q, turned, k, lead, best, part["vec_id"].to_numpy(np.int64), x)
        if best is not None:
            yield found(ids, best)

    return search


def length_classes(valid: DataFrame, classes: int, part: int, least_parts: int) -> list[tuple[float, float, int]]:
    """(shortest, longest, parts) of at most ``classes`` classes of length, longest first; together they hold all rows."""
    cuts = sorted(set(valid.approxQuantile("_length", [i / classes for i in range(1, classes)], 0.25 / classes)))
    place = F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda c: c <= F.col("_length"))) if cuts else F.lit(0)
    rows = valid.groupBy(place.alias("c")).agg(F.min("_length").alias("low"), F.max("_length").alias("high"), F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["n"] for r in rows)
    each = max(4096, min(part, -(-total // least_parts)))
    return sorted(((r["low"], r["high"], -(-r["n"] // each)) for r in rows), reverse=True)


def exact_top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, block: int = 16_384, part: int = 100_000, chunk: int = 2048, seeds: int = 4096, classes: int = 64
) -> DataFrame:
    """(query_id, rank, vec_id, score) over ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    valid = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    # not under the length of the vector as it is searched for: floor(v) is at most |v| + 1
    most = lambda x: F.abs(x.cast("double")) * F.lit(float(scale)) + F.lit(1.0)
    valid = valid.withColumn("_length", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + most(x) * most(x))))
    facts = valid.agg(F.max(F.size("embedding")).alias("width"), F.count(F.when(is_query, 1)).alias("n")).first()
    schema = T.StructType.fromDDL("query_id long, vec_id long, score long")
    found = spark.createDataFrame([], schema)
    if facts["n"]:
        width = max(1, facts["width"])
        basis = spark.sparkContext.broadcast(rotation(valid.select("vec_id", "embedding"), width, scale))
        longest = valid.orderBy(F.desc("_length"), "vec_id").limit(seeds).select("vec_id", "embedding").toPandas()
        longest = longest[~longest["vec_id"].duplicated(keep=False)]  # an id that stands twice may score twice alike
        sent = spark.sparkContext.broadcast((longest["vec_id"].to_numpy(np.int64), scaled(longest["embedding"].to_numpy(), width, scale)))
        parts_least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ranges = length_classes(valid, classes, part, parts_least)
        table = F.lit([float(x) for low, high, n in ranges for x in (low, high, n)]).cast("array<double>")
        each = F.transform(F.sequence(F.lit(0), F.lit(len(ranges) - 1)), lambda i: F.struct(
            i.alias("c"), F.get(table, i * 3).alias("low"), F.get(table, i * 3 + 1).alias("high"), F.get(table, i * 3 + 2).cast("long").alias("n")))
        first = np.concatenate(([0], np.cumsum([n for _, _, n in ranges]))).astype(int).tolist()
        start = lambda c: F.get(F.lit(first).cast("array<long>"), c)
        blocks = max(1, -(-facts["n"] // block))

        queries = valid.where(is_query).dropDuplicates(["vec_id", "embedding"])
        seeded = queries.mapInPandas(_seeder(sent, width, scale, k), T.StructType([*queries.schema.fields, T.StructField("least", T.DoubleType())]))
        reach = F.filter(each, lambda r: F.col("_length") * r["high"] * F.lit(1 + 1e-9) + F.lit(1e-6) >= F.col("least"))
        asked = seeded.withColumn("_r", F.explode(reach)).withColumn("_part", F.explode(F.sequence(start(F.col("_r.c")), start(F.col("_r.c")) + F.col("_r.n") - 1)))
        asked = asked.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("_block"), "_part", F.lit(False).alias("_candidate"), "_length", "vec_id", "embedding", "least")

        own = F.get(F.filter(each, lambda r: (F.col("_length") >= r["low"]) & (F.col("_length") <= r["high"])), F.lit(0))
        placed = valid.withColumn("_r", own).withColumn("_part", start(F.col("_r.c")) + F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.col("_r.n")))
        placed = placed.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        placed = placed.select("_block", "_part", F.lit(True).alias("_candidate"), "_length", "vec_id", "embedding", F.lit(None).cast("double").alias("least"))
        tasks = max(1, blocks * first[-1])
        dealt = asked.unionByName(placed).repartition(min(tasks, 100_000), "_block", "_part")
        order = ["_block", "_part", "_candidate", F.desc("_length"), "vec_id"]
        found = dealt.sortWithinPartitions(*order).mapInPandas(_searcher(basis, width, scale, k, lead=max(1, width // 4), chunk=chunk), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
