"""Best-fit packing by length patterns and non-negative least squares.

Texts become token ids and an end id; longer ones than a sequence are cut into full pieces, with what is left over as
the first.  The plan is made from the histogram of piece lengths alone, which has at most ``capacity`` entries:
patterns of two and three lengths that fill a sequence exactly are enumerated, non-negative least squares fits how
often each is used to the histogram, repeats are rounded down, and the pieces that no pattern takes are packed best
fit, longest first, on the histogram.  A plan row says: of this length, pieces of ranks a .. a+n-1 stand at this
offset in sequences s .. s+n-1.

Pieces get their rank among equal lengths from block counts (a few hundred rows to a block), so a length that holds a
third of all pieces is spread, and look their place up in the plan, whose size depends on the capacity and not on the
corpus.  A piece's block comes from its document and from the number its row got when pieces were written, so rows that
are alike spread too.  Triples of lengths are enumerated around ``thirds`` quantiles of the lengths only, a bound on the
plan's work: pieces that no pattern takes are packed best fit, so every piece is placed.

Token ids come from ``tokenizers``.  A byte-level vocabulary splits a text into pieces by a fixed pattern and gives each
piece its ids on its own, so texts are split by that pattern here and the model of ``tokenizers`` is asked for each distinct
piece (a worker remembers half a million).
Texts that hold a special token's string, or a code point that the splitter's Unicode tables may class otherwise (one that
Python's tables don't know, or beyond the basic plane), go through ``tokenizers`` as a whole, as do all texts with a vocabulary of another kind.

Defined cases: a null or empty text is the end id alone; rows that repeat a doc_id are packed row by row; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, lean, text_key

PIECES = "doc_id long, _key long, _row long, piece int, start long, length long, ids_crc32 long"
# fixed value: how byte-level vocabularies of this kind split a text
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a worker remembers, and characters of the longest of them.
PIECES_HELD, PIECE_CHARS = 1 << 19, 64
_encoders: dict = {}


def splits_alike(file: dict) -> bool:
    """Whether a ``tokenizers`` file splits by SPLIT and encodes pieces on their own, by what it declares."""
    before = file.get("pre_tokenizer") or {}
    whole = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    return whole and not file.get("normalizer") and not file.get("post_processor") and not file["model"].get("dropout")


def unknown_code_points() -> str:
    """A character class of what Python's Unicode tables don't assign, and of everything beyond the basic plane."""
    edges, inside = [], False
    for c in range(0x110000):
        new = c > 0xFFFF or unicodedata.category(chr(c)) == "Cn"
        if new != inside:
            edges.append(c)
            inside = new
    edges += [0x110000] * (len(edges) % 2)
    return "[" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2])) + "]"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


class _Pieces(dict):
    """Ids of pieces as bytes; asks the vocabulary's model for new ones."""

    def __init__(self, model):
        self._model, self._letters = model, byte_letters()

    def __missing__(self, piece: str) -> bytes:
        letters = piece.encode("utf-8").decode("latin-1").translate(self._letters)
        ids = _packed([t.id for t in self._model.tokenize(letters)])
        if len(piece) <= PIECE_CHARS:
            if len(self) >= PIECES_HELD:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Ids of whole texts by a ``tokenizers`` file, as little-endian 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            text = f.read()
        self._of, file = Tokenizer.from_str(text), json.loads(text)
        self.by_pieces = splits_alike(file)
        self._pieces, self._split = _Pieces(self._of.model), regex.compile(SPLIT).findall
        special = [re.escape(t["content"]) for t in file.get("added_tokens", [])]
        self._hard = re.compile("|".join([*special, unknown_code_points()])).search
        self._special = re.compile("|".join(special) or r"(?!)").search

    def whole(self, text: str) -> bytes:
        return _packed(self._of.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: str) -> bytes:
        if not self.by_pieces or (self._special if text.isascii() else self._hard)(text):
            return self.whole(text)
        return b"".join(map(self._pieces.__getitem__, self._split(text)))


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_vocabulary() -> str:
    """Path of the vocabulary; a parameter everywhere below."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, what is left over first."""
    first = len(ids) % capacity or capacity
    starts = [0, *range(first, len(ids), capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], len(ids)])]


def _tokenise(vocabulary: str, capacity: int, end: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, row = encoder(vocabulary), TaskContext.get().partitionId() << 36
        for b in batches:
            out = []
            for doc, key, text in zip(b["doc_id"], b["_key"], b["text"]):
                ids, row = np.frombuffer((encode(text) if text else b"") + _packed([end]), dtype="<u4"), row + 1
                for k, (start, length) in enumerate(cut(ids, capacity)):
                    out.append((None if pd.isna(doc) else int(doc), key, row, k, start, length, zlib.crc32(ids[start : start + length])))
            yield pd.DataFrame(out, columns=["doc_id", "_key", "_row", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return run


def patterns(lengths: np.ndarray, counts: np.ndarray, capacity: int, thirds: int = 8) -> list[tuple[int, ...]]:
    """Pairs of present lengths that fill a sequence, and triples whose second length is one of ``thirds`` quantiles."""
    have = set(lengths.tolist())
    found = {(max(a, capacity - a), min(a, capacity - a)) for a in have if capacity - a in have}
    where = np.searchsorted(np.cumsum(counts), (np.arange(thirds) + 0.5) / thirds * counts.sum())
    for middle in {int(lengths[min(i, len(lengths) - 1)]) for i in where}:
        for a in have:
            if capacity - a - middle in have:
                found.add(tuple(sorted((a, middle, capacity - a - middle), reverse=True)))
    return sorted(found, reverse=True)


def fit_repeats(chosen: list[tuple[int, ...]], counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """min |A x - counts| with x >= 0 by cyclic coordinate descent; a column of A has at most three entries."""
    columns = []
    for p in chosen:
        rows, times = np.unique(p, return_counts=True)
        columns.append((rows.tolist(), times.tolist(), float((times**2).sum())))
    rest, x = counts.astype(float).tolist(), [0.0] * len(chosen)
    for _ in range(rounds):
        moved = 0.0
        for j, (rows, times, norm) in enumerate(columns):
            step = sum(rest[r] * t for r, t in zip(rows, times)) / norm
            new = max(0.0, x[j] + step)
            if (change := new - x[j]) != 0.0:
                x[j] = new
                for r, t in zip(rows, times):
                    rest[r] -= change * t
                moved = max(moved, abs(change))
        if moved < 0.5:
            break
    return np.array(x)


def make_plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, count, first sequence, offset) that place every piece of the histogram."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    used, rows, sequences = np.zeros(capacity + 1, dtype=np.int64), [], 0

    def place(length: int, n: int, sequence: int, offset: int) -> None:
        rows.append((length, int(used[length]), n, sequence, offset))
        used[length] += n
        left[length] -= n

    if n := int(left[capacity]):
        place(capacity, n, 0, 0)
        sequences = n
    present = np.flatnonzero(left)
    chosen = patterns(present, left[present], capacity) if len(present) else []
    if chosen:
        repeats = np.floor(fit_repeats(chosen, left) + 1e-9).astype(np.int64)
        for j in np.argsort(-repeats, kind="stable"):
            parts, times = np.unique(chosen[j], return_counts=True)
            n = int(min(repeats[j], (left[parts] // times).min()))
            if n <= 0:
                continue
            offset = 0
            for length in chosen[j]:
                place(length, n, sequences, offset)
                offset += length
            sequences += n
    # what is left: best fit, longest first; open[s] holds runs (first sequence, count) with s ids free
    open_: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        while left[length] > 0:
            free = next((s for s in range(length, capacity) if open_[s]), capacity)
            each = min(free // length, int(left[length]))
            n = int(left[length]) // each
            if free == capacity:
                first = sequences
                sequences += n
            else:
                first, there = open_[free].pop()
                n = min(n, there)
                if there > n:
                    open_[free].append((first + n, there - n))
            for k in range(each):
                place(length, n, first, capacity - free + k * length)
            open_[free - each * length].append((first, n))
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def _placer(plan):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, starts = plan.value
        for b in batches:
            key = b["length"].to_numpy(np.int64) * (1 << 44) + b["_rank"].to_numpy(np.int64)
            at = np.searchsorted(starts, key, side="right") - 1
            found = rows[at]
            if len(b) and not ((found[:, 0] == b["length"].to_numpy()) & (b["_rank"].to_numpy() < found[:, 1] + found[:, 2])).all():
                raise ValueError("a piece stands outside the plan")
            yield b.drop(columns=["_rank"]).assign(sequence_id=found[:, 3] + b["_rank"].to_numpy() - found[:, 1], offset=found[:, 4])

    return run


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, end: int = 0, rows_each: int = 256) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("_key"), "text")
    pieces = durable(texts.mapInPandas(lean(_tokenise(vocabulary or default_vocabulary(), capacity, end)), PIECES), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = make_plan(histogram, capacity)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    plan = spark.sparkContext.broadcast((rows, rows[:, 0] * (1 << 44) + rows[:, 1]))

    subs = F.lit([max(1, -(-histogram.get(n, 0) // rows_each)) for n in range(capacity + 1)])
    where = F.pmod(F.xxhash64("doc_id", "_key", "_row", "piece"), F.get(subs, F.col("length").cast("int")).cast("long"))
    blocked = pieces.withColumn("_sub", where)
    before = Window.partitionBy("length").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        blocked.groupBy("length", "_sub")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("length", "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    place = Window.partitionBy("length", "_sub").orderBy(F.col("doc_id").asc_nulls_last(), "_key", "_row", "piece")
    ranked = blocked.join(bases, ["length", "_sub"]).withColumn("_rank", F.col("_base") + F.row_number().over(place) - 1)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*names, "_rank").mapInPandas(
        _placer(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
