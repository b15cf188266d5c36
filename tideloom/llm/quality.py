"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's grade is modelled as P(grade <= j) = sigmoid(threshold_j - score), with one score (shared weights over
hashed text) and ordered thresholds.  It gives the expected grade and the tail probability P(grade >= top), by which
documents are selected.

Text features are hashes of tokens (runs of letters, digits and non-ASCII characters, or runs of punctuation, A-Z
lower-cased) that occur anywhere in the text and of their first bytes, and bands of a few whole-text measures (share of capitals,
punctuation and digits, repetition, token length, size).  The weights are fitted on at most ``sample`` rated documents
(smallest hashes of doc_id, a bounded sample on the driver); every document is scored by its whole text.  The model
that goes out has ``2**bits`` weights, whatever the corpus.

Defined cases: null and empty texts have only the measures' features; ratings with a null doc_id or null quality are
left out, a null toxic counts as 0; documents that repeat a doc_id are scored row by row, and their rows are learned from
while the sample has room; without two grades among the ratings every document gets the same score; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, text_key
from .shingles import _blocks, _grow, mix

_U = np.uint64
#: Bytes of a token's stems that are features of their own.
STEMS = (4, 6)
#: Numbers of the bands of measures, and what a band counts for against a token.
MEASURED = 7 << 6
BAND_VALUE = 3.0
#: Documents with a smaller probability of the highest grade are rejected.
LEAST = 0.4
#: Documents whose features are held together when they are scored.
SCORED = 256


def _tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (whole tokens, then each kind of stem), first byte and length of every token."""
    from . import shingles

    space = (data == 32) | ((data >= 9) & (data <= 13))
    upper = (data >= 65) & (data <= 90)
    folded = data + upper.view(np.uint8) * np.uint8(32)
    word = ((folded >= 97) & (folded <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)
    kind = np.where(space, 0, np.where(word, 1, 2)).astype(np.int8)
    edge = np.flatnonzero(np.diff(kind, prepend=-1, append=-1))
    start, end = edge[:-1], edge[1:]
    live = kind[start] > 0
    start, end = start[live], end[live]
    _grow(len(data) + 1)
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((folded.astype(np.uint64) + _U(1)) * shingles._POW[: len(data)], out=total[1:])
    body = (total[end] - total[start]) * shingles._INV[start]
    found = [mix(body + (end - start).astype(np.uint64))]
    for k in STEMS:
        stem = np.minimum(start + k, end)
        found.append(mix((total[stem] - total[start]) * shingles._INV[start] + _U(1 << (40 + k))))
    return np.stack(found), start, end - start


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def features(texts, bits: int) -> Iterator[np.ndarray]:
    """Distinct feature numbers of each whole text; the first ``MEASURED`` numbers are bands of measures."""
    span = _U((1 << bits) - MEASURED)
    for run in _blocks(texts, 1 << 18):
        data = np.frombuffer(b"\n".join(run), dtype=np.uint8)
        hashes, start, length = _tokens(data) if len(data) else (np.empty((1 + len(STEMS), 0), np.uint64), np.empty(0, int), np.empty(0, int))
        hashes = (hashes % span).astype(np.int32) + np.int32(MEASURED)
        at, first = 0, 0
        for text in run:
            stop = np.searchsorted(start, at + len(text) + 1)
            own, chars = _distinct(hashes[:, first:stop].ravel()), np.bincount(data[at : at + len(text)], minlength=256)
            n, size = stop - first, max(1, len(text))
            upper, lower, digit = chars[65:91].sum() / size, chars[97:123].sum() / size, chars[48:58].sum() / size
            mark = chars[33:128].sum() / size - upper - lower - digit
            measures = (
                20 * np.sqrt(upper), 20 * np.sqrt(digit), 20 * np.sqrt(max(0.0, mark)), 40 * np.sqrt(chars[10] / size),
                8 * len(own) / max(1, n), 2 * (length[first:stop].mean() if n else 0), np.log2(n + 1),
            )
            bands = np.array([(k << 6) + min(63, int(m)) for k, m in enumerate(measures)], dtype=np.int32)
            yield np.concatenate((bands, own))
            at, first = at + len(text) + 1, stop


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _values(flat: np.ndarray, bands: int = MEASURED) -> np.ndarray:
    """What features count for; the first ``bands`` numbers are bands of measures."""
    return np.where(flat < bands, np.float32(BAND_VALUE), np.float32(1))


@dataclass
class Model:
    bits: int
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, docs: Iterable[np.ndarray]) -> np.ndarray:
        """The sum of a document's weights by value; no document is without features.  Holds those of ``SCORED`` documents."""
        docs, out = iter(docs), [np.empty(0)]
        while some := list(islice(docs, SCORED)):
            flat = np.concatenate(some)
            starts = np.concatenate(([0], np.cumsum([len(d) for d in some])[:-1]))
            out.append(np.add.reduceat(self.weights[flat] * _values(flat), starts))
        return np.concatenate(out)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold j."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def fit(docs: list[np.ndarray], grades: np.ndarray, n_grades: int, bits: int, rounds: int = 120, noise: float = 1.0, rate: float = 0.3, each: int = 512) -> Model:
    """Proximal AdaGrad on the cumulative-link likelihood of all documents at once.

    A feature that d of n documents have gets a weight only while its mean gradient exceeds ``noise * sqrt(d) / n``,
    which is what chance gives it, so rare tokens without a message stay at 0.  Thresholds stay ordered, as sums of
    positive steps.  The gradient is summed over blocks of ``each`` documents, so that only features (six bytes each)
    are held for all of them; ``docs`` is emptied as they are taken over.
    """
    n, size = len(docs), 1 << bits
    share = np.array([np.clip((grades <= j).mean() if n else 0.5, 0.01, 0.99) for j in range(n_grades - 1)])
    cuts = np.log(share / (1 - share))
    base, steps = cuts[0], np.log(np.maximum(np.diff(cuts), 0.05))
    weights = np.zeros(size)
    if len(np.unique(grades)) < 2:
        return Model(bits, weights, np.concatenate(([base], base + np.cumsum(np.exp(steps)))))
    held = np.zeros(size, dtype=np.int32)
    for d in docs:
        held[d] += 1  # a document's features are distinct
    known = np.flatnonzero(held >= 3)
    place = np.full(size, -1, dtype=np.int32)
    place[known] = np.arange(len(known), dtype=np.int32)
    blocks = []
    docs.reverse()
    while docs:
        part = [place[docs.pop()] for _ in range(min(each, len(docs)))]
        part = [p[p >= 0] for p in part]
        blocks.append((len(part), np.repeat(np.arange(len(part), dtype=np.int16), [len(p) for p in part]), np.concatenate(part)))
    del place
    w, g2, bands = np.zeros(len(known)), np.full(len(known), 1e-12), int(np.searchsorted(known, MEASURED))
    least, t2 = noise * np.sqrt(held[known]) / n, np.full(n_grades - 1, 1e-12)
    for _ in range(rounds):
        g, d_cut, at = np.zeros(len(w)), np.zeros(n_grades - 1), 0
        cut = np.concatenate(([base], base + np.cumsum(np.exp(steps))))
        for m, row, flat in blocks:
            value, y, i = _values(flat, bands), grades[at : at + m], np.arange(m)
            score = np.bincount(row, w[flat] * value, minlength=m)
            below = _sigmoid(cut[None, :] - score[:, None])
            edge = np.concatenate((np.zeros((m, 1)), below, np.ones((m, 1))), 1)
            slope = np.concatenate((np.zeros((m, 1)), below * (1 - below), np.zeros((m, 1))), 1)
            p = np.maximum(edge[i, y + 1] - edge[i, y], 1e-9)
            upper, lower = slope[i, y + 1] / p, slope[i, y] / p
            g += np.bincount(flat, (upper - lower)[row] * value, minlength=len(w))  # of minus the log-likelihood
            d_cut += [lower[y == j + 1].sum() - upper[y == j].sum() for j in range(n_grades - 1)]
            at += m
        g, d_cut = g / n, d_cut / n
        g2 += g**2
        step = rate / np.sqrt(g2)
        moved = w - step * g
        w = np.sign(moved) * np.maximum(np.abs(moved) - step * least, 0)
        d_par = np.concatenate(([d_cut.sum()], [np.exp(steps[j]) * d_cut[j + 1 :].sum() for j in range(len(steps))]))
        t2 += d_par**2
        move = 0.2 * d_par / np.sqrt(t2)
        base, steps = base - move[0], steps - move[1:]
    weights[known] = w
    return Model(bits, weights, np.concatenate(([base], base + np.cumsum(np.exp(steps)))))


def grade_of(quality: Column, toxic: Column) -> Column:
    """0: toxic; 1: harmless but of low quality; 2: good.  Null quality without toxicity: null."""
    return F.when(toxic > 0, 0).when(quality > 0, 2).when(quality.isNotNull(), 1)


def _featured(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns=["text"]).assign(f=[f.tobytes() for f in features(b["text"], bits)])

    return run


def _rated(docs: DataFrame, ratings: DataFrame, sample: int, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature lists and grades of at most ``sample`` rows: those of the smallest hashes of doc_id, ties by grade and text."""
    order = ["_h", "doc_id", "grade"]
    known = ratings.where(F.col("doc_id").isNotNull() & F.col("grade").isNotNull())
    chosen = known.select(F.xxhash64(F.lit(3), "doc_id").alias("_h"), "doc_id", "grade").orderBy(*order).limit(sample)
    rated = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    each = rated.select("_h", F.col("doc_id").cast("long").alias("doc_id"), "grade", text_key(F.col("text")).alias("_key"), "text")
    found = each.mapInPandas(lean(_featured(bits)), "_h long, doc_id long, grade int, _key long, f binary")
    # a rated doc_id may stand on any number of rows, so the bound comes after the join
    rows = found.orderBy(*order, "_key").limit(sample).select("grade", "f").toArrow()
    lists = [np.frombuffer(f.as_py(), dtype=np.int32) for f in rows.column("f")]
    grades = rows.column("grade").to_numpy().astype(np.int64)
    del rows
    pa.default_memory_pool().release_unused()  # the driver keeps the lists alone
    return lists, grades


def train(docs: DataFrame, ratings: DataFrame, sample: int = 8_000, bits: int = 20, n_grades: int = 3) -> Model:
    """``ratings``: doc_id, grade (0 .. n_grades - 1).  The driver holds at most ``sample`` feature lists."""
    lists, grades = _rated(docs, ratings, sample, bits)
    return fit(lists, grades, n_grades, bits)


def _scorer(model, column: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = model.value
            tails = m.tails(m.scores(features(b[column], m.bits)))
            yield b.drop(columns=[column]).assign(expected_grade=tails.sum(1), tail_probability=tails[:, -1])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, _key, expected_grade, tail_probability) of every row; ``_key`` tells texts of one doc_id apart."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("_key"), "text")
    return rows.mapInPandas(lean(_scorer(sent, "text")), "doc_id long, _key long, expected_grade double, tail_probability double")


def _tail_of(model):
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = model.value
        for text in texts:
            yield pd.Series(m.tails(m.scores(features(text, m.bits)))[:, -1], dtype="float64")

    @F.pandas_udf("double")
    def tail(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from lean(run)(texts)

    return tail


def select(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` whose probability of the highest grade is at least ``least``, with their own columns."""
    tail = _tail_of(docs.sparkSession.sparkContext.broadcast(model))
    return docs.where(tail(F.col("text")) >= least)
