"""Vectors and matrices as columns: dense arrays, sparse structs, and the level-1/2 operations on them.

A dense vector is ARRAY<DOUBLE>; a sparse one STRUCT<size INT, indices ARRAY<INT>, values ARRAY<DOUBLE>> with rising
indices; a dense matrix ARRAY<ARRAY<DOUBLE>> by rows; a sparse matrix rows of (i, j, v), or in one column
STRUCT<rows INT, cols INT, entries ARRAY<STRUCT<j INT, i INT, v DOUBLE>>> by columns.  All are built-in expressions,
evaluated in the JVM.  Operations on vectors of unequal sizes give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_doubles(v) -> Column:
    return _c(v).cast("array<double>")


def _same(a: Column, b: Column, out: Column) -> Column:
    return F.when(F.size(a) == F.size(b), out)


def total(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    a, b = _c(a), _c(b)
    return _same(a, b, total(F.zip_with(a, b, lambda x, y: x * y)))


def norm2(a) -> Column:
    """Squared length."""
    return F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x * x)


def magnitude(a) -> Column:
    return F.sqrt(norm2(a))


def add(a, b) -> Column:
    a, b = _c(a), _c(b)
    return _same(a, b, F.zip_with(a, b, lambda x, y: x + y))


def subtract(a, b) -> Column:
    a, b = _c(a), _c(b)
    return _same(a, b, F.zip_with(a, b, lambda x, y: x - y))


def scal(factor, a) -> Column:
    factor = _c(factor) if isinstance(factor, (str, Column)) else F.lit(float(factor))
    return F.transform(_c(a), lambda x: x * factor)


def axpy(factor, x, y) -> Column:
    """y + factor * x."""
    factor = _c(factor) if isinstance(factor, (str, Column)) else F.lit(float(factor))
    x, y = _c(x), _c(y)
    return _same(x, y, F.zip_with(y, x, lambda v, u: v + factor * u))


def outer(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.transform(a, lambda x: F.transform(b, lambda y: x * y))


def syr(factor, x, matrix) -> Column:
    """matrix + factor * x xT."""
    factor, x = F.lit(float(factor)) if not isinstance(factor, (str, Column)) else _c(factor), _c(x)
    return F.zip_with(_c(matrix), x, lambda row, u: F.zip_with(row, x, lambda m, v: m + factor * u * v))


def matrix_vector(matrix, x) -> Column:
    x = _c(x)
    return F.transform(_c(matrix), lambda row: F.aggregate(F.zip_with(row, x, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v))


def transpose(matrix) -> Column:
    m = _c(matrix)
    return F.transform(F.sequence(F.lit(0), F.size(F.get(m, F.lit(0))) - 1), lambda j: F.transform(m, lambda row: F.get(row, j)))


def dense(*values) -> Column:
    """A vector of numbers or columns, of whatever numeric type."""
    return F.array(*[_c(v).cast("double") if isinstance(v, (str, Column)) else F.lit(float(v)) for v in values])


def filled(n, value) -> Column:
    return F.array_repeat(F.lit(float(value)) if not isinstance(value, (str, Column)) else _c(value).cast("double"), n)


def zeros(n) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def ones(n) -> Column:
    return F.array_repeat(F.lit(1.0), n)


def identity(n: int) -> Column:
    return F.array(*[F.array(*[F.lit(float(i == j)) for j in range(n)]) for i in range(n)])


def at(v, i) -> Column:
    """Component i from 0; null outside."""
    return F.get(_c(v), F.lit(i) if isinstance(i, int) else _c(i))


def updated(v, i, value) -> Column:
    i, value = (F.lit(x) if not isinstance(x, Column) else x for x in (i, value))
    return F.transform(_c(v), lambda x, k: F.when(k == i, value).otherwise(x))


def equal(a, b, tolerance: float = 0.0) -> Column:
    a, b = _c(a), _c(b)
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tolerance), lambda ok: ok)


def equal_matrix(a, b, tolerance: float = 0.0) -> Column:
    a, b = _c(a), _c(b)
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda p, q: equal(p, q, tolerance)), lambda ok: ok)


def matrix_at(matrix, i, j) -> Column:
    """Null outside."""
    i, j = (F.lit(x) if isinstance(x, int) else _c(x) for x in (i, j))
    return F.get(F.get(_c(matrix), i), j)


def matrix_updated(matrix, i, j, value) -> Column:
    i, j, value = (F.lit(x) if not isinstance(x, Column) else x for x in (i, j, value))
    return F.transform(_c(matrix), lambda row, r: F.when(r == i, updated(row, j, value)).otherwise(row))


def matrix_filled(rows: int, cols: int, value: float = 0.0) -> Column:
    return F.array_repeat(F.array_repeat(F.lit(float(value)), cols), rows)


def to_ml(v) -> Column:
    """As a vector of Spark's machine-learning library."""
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(_c(v))


def from_ml(v) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(_c(v))


def sparse(size, entries) -> Column:
    """From an array of structs (i, x) in any order: entries of a place add up, zeros are dropped; a place outside is an error."""
    entries, size = _c(entries), F.lit(size) if isinstance(size, int) else _c(size)
    inside = F.forall(entries, lambda e: (e["i"] >= 0) & (e["i"] < size))
    places = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["i"].cast("int"))))
    summed = F.transform(places, lambda k: F.struct(k.alias("i"), total(F.transform(F.filter(entries, lambda e: e["i"] == k), lambda e: e["x"].cast("double"))).alias("x")))
    kept = F.filter(summed, lambda p: p["x"] != 0)
    out = F.struct(size.alias("size"), kept["i"].alias("indices"), kept["x"].alias("values"))
    return F.when(inside, out).otherwise(F.raise_error(F.lit("index outside vector")).cast("struct<size int, indices array<int>, values array<double>>"))


def sparse_updated(s, i, value) -> Column:
    """Sets a place, whether it was stored or not; outside the size nothing changes."""
    s, i, value = _c(s), *(F.lit(x) if not isinstance(x, Column) else x for x in (i, value))
    others = F.filter(F.arrays_zip(s["indices"].alias("i"), s["values"].alias("x")), lambda p: p["i"] != i)
    placed = F.array_sort(F.concat(others, F.filter(F.array(F.struct(i.cast("int").alias("i"), value.cast("double").alias("x"))), lambda p: (p["x"] != 0) & (i >= 0) & (i < s["size"]))))
    return F.struct(s["size"].alias("size"), placed["i"].alias("indices"), placed["x"].alias("values"))


def sparse_equal(a, b) -> Column:
    a, b = _c(a), _c(b)
    return (a["size"] == b["size"]) & (a["indices"] == b["indices"]) & (a["values"] == b["values"])


def matrix_to_sparse(matrix) -> Column:
    """By columns, without zeros."""
    m = _c(matrix)
    cells = F.flatten(F.transform(m, lambda row, i: F.transform(row, lambda v, j: F.struct(j.alias("j"), i.alias("i"), v.alias("v")))))
    entries = F.array_sort(F.filter(cells, lambda e: e["v"] != 0))
    return F.struct(F.size(m).alias("rows"), F.coalesce(F.size(F.get(m, F.lit(0))), F.lit(0)).alias("cols"), entries.alias("entries"))


def matrix_to_dense(s) -> Column:
    s = _c(s)
    held = F.map_from_entries(F.transform(s["entries"], lambda e: F.struct((e["i"].cast("long") * s["cols"] + e["j"]).alias("k"), e["v"].alias("v"))))
    number = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda i, j: F.coalesce(F.try_element_at(held, i.cast("long") * s["cols"] + j), F.lit(0.0))
    rows = F.transform(number(s["rows"]), lambda i: F.transform(number(s["cols"]), lambda j: cell(i, j)))
    return F.when((s["rows"] > 0) & (s["cols"] > 0), rows).otherwise(F.array().cast("array<array<double>>"))


def sparse_matrix_at(s, i, j) -> Column:
    """0 where nothing is stored; null outside."""
    s, i, j = _c(s), *(F.lit(x) if isinstance(x, int) else _c(x) for x in (i, j))
    found = F.get(F.filter(s["entries"], lambda e: (e["i"] == i) & (e["j"] == j)), F.lit(0))["v"]
    return F.when((i >= 0) & (i < s["rows"]) & (j >= 0) & (j < s["cols"]), F.coalesce(found, F.lit(0.0)))


def sparse_matrix_updated(s, i, j, value) -> Column:
    s, i, j, value = _c(s), *(F.lit(x) if not isinstance(x, Column) else x for x in (i, j, value))
    others = F.filter(s["entries"], lambda e: (e["i"] != i) | (e["j"] != j))
    inside = (i >= 0) & (i < s["rows"]) & (j >= 0) & (j < s["cols"])
    new = F.filter(F.array(F.struct(j.cast("int").alias("j"), i.cast("int").alias("i"), value.cast("double").alias("v"))), lambda e: (e["v"] != 0) & inside)
    kept = F.when(inside, others).otherwise(s["entries"])
    return F.struct(s["rows"].alias("rows"), s["cols"].alias("cols"), F.array_sort(F.concat(kept, new)).alias("entries"))


def sparse_matrix_equal(a, b) -> Column:
    a, b = _c(a), _c(b)
    return (a["rows"] == b["rows"]) & (a["cols"] == b["cols"]) & (a["entries"] == b["entries"])


def to_sparse(v) -> Column:
    v = _c(v)
    places = F.filter(F.transform(v, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["x"] != 0)
    return F.struct(F.size(v).alias("size"), places["i"].alias("indices"), places["x"].alias("values"))


def sparse_at(s, i) -> Column:
    s = _c(s)
    place = F.array_position(s["indices"], i)
    return F.when((i >= 0) & (i < s["size"]), F.when(place > 0, F.get(s["values"], (place - 1).cast("int"))).otherwise(0.0))


def to_dense(s) -> Column:
    """Linear in the size: a map from index to value is looked up for each place."""
    s = _c(s)
    values = F.map_from_arrays(s["indices"], s["values"])
    filled = F.transform(F.sequence(F.lit(0), s["size"] - 1), lambda i: F.coalesce(F.try_element_at(values, i), F.lit(0.0)))
    return F.when(s["size"] > 0, filled).otherwise(F.array().cast("array<double>"))


def sparse_dot_dense(s, d) -> Column:
    s, d = _c(s), _c(d)
    return F.when(
        s["size"] == F.size(d), total(F.zip_with(s["indices"], s["values"], lambda i, x: x * F.coalesce(F.get(d, i), F.lit(0.0))))
    )


def sparse_dot(a, b) -> Column:
    a, b = _c(a), _c(b)
    other = F.map_from_arrays(b["indices"], b["values"])
    products = F.zip_with(a["indices"], a["values"], lambda i, x: x * F.coalesce(F.try_element_at(other, i), F.lit(0.0)))
    return F.when(a["size"] == b["size"], total(products))


def sparse_axpy(factor: float, s, y) -> Column:
    return axpy(factor, to_dense(s), y)


def sparse_outer(a, b) -> Column:
    """ARRAY<STRUCT<i, j, v>> of the products that are not zero."""
    a, b = _c(a), _c(b)
    rows = F.zip_with(
        a["indices"],
        a["values"],
        lambda i, x: F.zip_with(b["indices"], b["values"], lambda j, y: F.struct(i.alias("i"), j.alias("j"), (x * y).alias("v"))),
    )
    return F.filter(F.flatten(rows), lambda p: p["v"] != 0)


def from_coo(entries: DataFrame, keys: list[str], size: int, index: str = "i", value: str = "v") -> DataFrame:
    """Sparse vectors from (keys, index, value) rows: entries of one place add up.  Places outside the size are an error."""
    checked = entries.withColumn(index, F.when(F.col(index).between(0, size - 1), F.col(index)).otherwise(F.raise_error(F.lit("index outside vector")).cast("int")))
    summed = checked.groupBy(*keys, index).agg(F.sum(value).alias(value))
    per = summed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).alias("x")))).alias("_e"))
    return per.select(*keys, F.struct(F.lit(size).alias("size"), F.col("_e")["i"].alias("indices"), F.col("_e")["x"].alias("values")).alias("vector"))


def matrix_from_coo(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Sparse matrices as (keys, i, j, v) rows: repeated places add up."""
    return entries.groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))


def vector_sum(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Element-wise sum per key as rows (keys, pos, total): partial sums per place, no list per key."""
    return df.select(*keys, F.posexplode(_c(vector)).alias("pos", "x")).groupBy(*keys, "pos").agg(F.sum("x").alias("total"))


def gathered(rows: DataFrame, keys: list[str], place: str = "pos", value: str = "total", out: str = "vector") -> DataFrame:
    """Rows (keys, place, value) to one array per key; a key has as many rows as the vector is long."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(value).alias("x"))))
    return rows.groupBy(*keys).agg(ordered.alias("_o")).select(*keys, F.col("_o")["x"].alias(out))
