"""Model parameters: linear (weights and intercept) and matrix (A and b), their algebra, flattening and slices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .linalg import add, scal, subtract


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def linear(w, b) -> Column:
    return F.struct(_c(w).alias("w"), _c(b).alias("b"))


def _both(p, q, vectors, numbers) -> Column:
    p, q = _c(p), _c(q)
    return linear(vectors(p["w"], q["w"]), numbers(p["b"], q["b"]))


def plus(p, q) -> Column:
    return _both(p, q, add, lambda x, y: x + y)


def minus(p, q) -> Column:
    return _both(p, q, subtract, lambda x, y: x - y)


def times(p, factor) -> Column:
    p = _c(p)
    factor = factor if isinstance(factor, Column) else F.lit(float(factor))
    return linear(scal(factor, p["w"]), p["b"] * factor)


def over(p, divisor) -> Column:
    """Division is multiplication by the reciprocal; a zero divisor gives null."""
    divisor = divisor if isinstance(divisor, Column) else F.lit(float(divisor))
    return times(p, F.try_divide(F.lit(1.0), divisor))


def flatten(p) -> Column:
    """Weights, then the intercept."""
    p = _c(p)
    return F.concat(p["w"], F.array(p["b"]))


def unflatten(v) -> Column:
    v = _c(v)
    return linear(F.slice(v, F.lit(1), F.size(v) - 1), F.element_at(v, -1))


def sizes(p) -> Column:
    return F.array(F.size(_c(p)["w"]), F.lit(1))


def n_bytes(p) -> Column:
    return 8 * (F.size(_c(p)["w"]) + 1)


def matrix(a, b) -> Column:
    """``a``: ARRAY<ARRAY<DOUBLE>> by rows; the shape stays with the parameters."""
    return F.struct(_c(a).alias("A"), _c(b).alias("b"))


def flatten_matrix(p) -> Column:
    p = _c(p)
    return F.concat(F.flatten(p["A"]), p["b"])


def unflatten_matrix(v, n) -> Column:
    """n x n rows, then n numbers."""
    v, n = _c(v), F.lit(n) if isinstance(n, int) else _c(n)
    rows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(v, i * n + 1, n))
    return matrix(rows, F.slice(v, n * n + 1, n))


def unwrap(v, parts: list[int]) -> Column:
    """A flat array cut into consecutive parts."""
    v, out, at = _c(v), [], 1
    for n in parts:
        out.append(F.slice(v, at, n))
        at += n
    return F.array(*out)


def bucket_slice(v, start, end) -> Column:
    """The inclusive range start..end (from 0); null unless 0 <= start <= end < size."""
    v, start, end = _c(v), *(x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    return F.when((start >= 0) & (start <= end) & (end < F.size(v)), F.slice(v, start.cast("int") + 1, (end - start + 1).cast("int")))


def descriptor(p, fitted) -> Column:
    """Sizes, flat parameters, the whole range as bucket, and how many points were fitted."""
    flat = flatten(p)
    bucket = F.struct(F.lit(0).cast("long").alias("start"), (F.size(flat) - 1).cast("long").alias("end"))
    return F.struct(sizes(p).alias("sizes"), flat.alias("params"), bucket.alias("bucket"), _c(fitted).cast("long").alias("fitted"))
