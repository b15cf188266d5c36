"""Shared parts of the training-data operators: durable scratch tables, task counts, text expressions."""

from __future__ import annotations

import atexit
import ctypes
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from functools import wraps

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideloom.sources.storage import fresh, remove

#: The six code points that count as white space in all operators here.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"

_made: set[str] = set()
#: Scratch folders of the step that ``settle`` runs in this context.
_step: ContextVar[set[str] | None] = ContextVar("_step", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = fresh(spark, name)
    if not _made:
        atexit.register(_drop_all)
    _made.add(path)
    if (step := _step.get()) is not None:
        step.add(path)
    return path


def durable(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: lineage ends there, and no executor's loss matters."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*dfs: DataFrame | None) -> None:
    """Removes the folders of durable tables that nothing reads any more."""
    for df in dfs:
        if df is not None and (path := getattr(df, "_scratch", None)) in _made:
            drop_scratch(df.sparkSession, path)


def settle(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The durable result of a step; whatever else the step wrote as scratch is removed."""
    token = _step.set(set())
    try:
        out = durable(make(), name)
        drop_scratch(out.sparkSession, *((_step.get() & _made) - {out._scratch}))
    finally:
        _step.reset(token)
    return out


def drop_scratch(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        remove(spark, path)
        _made.discard(path)


def _drop_all() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            drop_scratch(spark, *list(_made))
        except Exception:  # noqa: BLE001  the session may be gone; the folder's owner clears it
            return


def partitions_for(spark: SparkSession, rows: int, rows_each: int = 200_000) -> int:
    """As many partitions as the session shuffles into, or more where they would hold over ``rows_each`` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each), 1)


def settled(df: DataFrame, rows: int, rows_each: int = 50_000) -> DataFrame:
    """Fewer tasks where a known number of rows needs fewer than the session's shuffle partitions; else unchanged."""
    tasks = max(1, -(-rows // rows_each))
    return df.coalesce(tasks) if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def sized_join(left: DataFrame, right: DataFrame, key: str, rows: int, rows_each: int) -> DataFrame:
    """An inner join dealt by the number of rows of ``left``: into fewer tasks than the session's partitions, or into more."""
    tasks = -(-rows // rows_each)
    if tasks > int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return left.repartition(tasks, key).join(right.repartition(tasks, key), key)
    return settled(left.join(right, key), rows, rows_each)


def give_back() -> None:
    """Returns memory that Arrow's pool and the allocator hold free: a worker outlives its task, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, with its free memory given back at the end."""

    @wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; ASCII-only texts take the fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """64-bit digest that tells rows of one doc_id apart; null and empty texts are alike."""
    return F.xxhash64(F.coalesce(text, F.lit("")))
