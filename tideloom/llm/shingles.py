"""Vectorised word and shingle hashing of UTF-8 texts (numpy, no per-word Python).

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z
lower-cased.  Its 64-bit hash is a polynomial over its bytes modulo 2**64,
mixed with its length; a shingle hash combines the hashes of consecutive words.
Every byte of a text is used: there is no prefix, cap or sample.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_CHUNK = 1 << 16
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit integers (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _inverse(x: int) -> np.uint64:
    return _U(pow(int(x), -1, 1 << 64))


_POW = _powers(_CHUNK, _BASE)
_INV = _powers(_CHUNK, _inverse(_BASE))


def _grow(n: int) -> None:
    global _POW, _INV
    if len(_POW) < n:
        size = 1 << (n - 1).bit_length()
        _POW, _INV = _powers(size, _BASE), _powers(size, _inverse(_BASE))


def _word_spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    return edge[::2], edge[1::2]


def word_hashes(data: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of ``data``, in order."""
    b = np.frombuffer(data, dtype=np.uint8)
    if not len(b):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    start, end = _word_spans(b)
    if lower:
        b = b + ((b >= 65) & (b <= 90)).view(np.uint8) * np.uint8(32)
    _grow(len(b) + 1)
    total = np.empty(len(b) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((b.astype(np.uint64) + _U(1)) * _POW[: len(b)], out=total[1:])
    body = (total[end] - total[start]) * _INV[start]
    return mix(body + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93)), start


def _fold(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for k in range(width):
        out = (out + words[k : k + len(out)]) * _U(0xC2B2AE3D27D4EB4F)
        out ^= out >> _U(29)
    return mix(out + _U(width))


def _blocks(texts, limit: int):
    """Runs of whole texts of about ``limit`` bytes together (a longer text is a run of its own)."""
    run, size = [], 0
    for text in texts:
        data = text.encode("utf-8", "surrogatepass") if text else b""
        if run and size + len(data) > limit:
            yield run
            run, size = [], 0
        run.append(data)
        size += len(data) + 1
    if run:
        yield run


def word_hash_lists(texts, lower: bool = True, limit: int = 1 << 18):
    """Yields the word hashes of each text, in order."""
    for run in _blocks(texts, limit):
        hashes, start = word_hashes(b"\n".join(run), lower)
        ends = np.cumsum([len(x) + 1 for x in run])
        cut = np.searchsorted(start, ends)
        at = 0
        for stop in cut:
            yield hashes[at:stop]
            at = stop


def shingle_sets(texts, width: int, limit: int = 1 << 18):
    """Yields the sorted distinct shingle hashes of each whole text; empty for null or blank texts.

    A text of fewer than ``width`` words has its whole word sequence as its one shingle.
    """
    for run in _blocks(texts, limit):
        hashes, start = word_hashes(b"\n".join(run))
        ends = np.cumsum([len(x) + 1 for x in run])
        cut = np.searchsorted(start, ends)
        folded = _fold(hashes, width) if len(hashes) >= width else hashes[:0]
        at = 0
        for stop in cut:
            n = stop - at
            if n >= width:
                own = np.sort(folded[at : stop - width + 1])
                keep = np.empty(len(own), dtype=bool)
                keep[0] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                yield own[keep]
            else:
                yield _fold(hashes[at:stop], n) if n else hashes[:0]
            at = stop


def set_digest(sorted_set: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit digests of a sorted set: equal sets only give equal pairs."""
    if not len(sorted_set):
        return 0, 0
    place = mix(np.arange(1, len(sorted_set) + 1, dtype=np.uint64))
    one = int(np.sum(mix(sorted_set ^ place), dtype=np.uint64))
    two = int(np.sum(mix(sorted_set + place * _U(3)) * _U(0x9FB21C651E98DF25), dtype=np.uint64))
    return tuple(x - (1 << 64) if x >> 63 else x for x in (one, two))
