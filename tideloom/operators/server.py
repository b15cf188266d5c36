"""Parameter server: deltas of a round, averaging into global models, and training over rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideloom.functions.linalg import gathered
from tideloom.functions.params import flatten, linear, unflatten

from .learners import C, EPSILON, fold_batch, fold_rows, label


def batches(points: DataFrame, keys: list[str], order: str, kind: str = "PA") -> DataFrame:
    """Per (keys, worker, round) the ordered mini-batch as an array: rounds bound its length."""
    y = label(F.col("y")) if kind == "PA" else F.col("y")
    rows = points.withColumn("y", y.cast("double")).where(F.col("y").isNotNull())
    return rows.groupBy(*keys, "worker", "round").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("ord"), "x", "y"))).alias("rows"))


def deltas(mini: DataFrame, models: DataFrame | None, keys: list[str], width: int, kind: str = "PA", c: float = C, epsilon: float = EPSILON) -> DataFrame:
    """Local minus global parameters, flat, of every worker's mini-batch; the global model is zero before the first."""
    zero = F.array_repeat(F.lit(0.0), width + 1)
    joined = mini.join(models.select(*keys, "v"), keys, "left") if models is not None else mini.withColumn("v", F.lit(None).cast("array<double>"))
    start = joined.withColumn("v", F.coalesce("v", zero))
    local = fold_batch(F.col("rows"), unflatten(F.col("v")), kind, c, epsilon)
    return start.withColumn("_local", local).select(
        *keys, "worker", "round", F.zip_with(flatten(F.col("_local")), F.col("v"), lambda p, q: p - q).alias("delta"), F.size("rows").cast("long").alias("fitted")
    )


def averaged(delta: DataFrame, models: DataFrame | None, keys: list[str], workers: int) -> DataFrame:
    """Global models (keys, v, fitted) after adding every delta over the number of workers."""
    spread = delta.select(*keys, F.posexplode("delta").alias("pos", "x")).groupBy(*keys, "pos").agg((F.sum("x") / F.lit(float(workers))).alias("total"))
    moved = gathered(spread, keys, out="step").join(delta.groupBy(*keys).agg(F.sum("fitted").alias("fitted")), keys)
    if models is None:
        return moved.select(*keys, F.col("step").alias("v"), "fitted")
    old = models.select(*keys, F.col("v").alias("_v"), F.col("fitted").alias("_fitted"))
    joined = old.join(moved, keys, "full")
    return joined.select(
        *keys,
        F.coalesce(F.zip_with("_v", "step", lambda p, q: p + q), "_v", "step").alias("v"),
        (F.coalesce("_fitted", F.lit(0)) + F.coalesce("fitted", F.lit(0))).alias("fitted"),
    )


def _in_rounds(points: DataFrame, keys: list[str], order: str, width: int, kind: str) -> DataFrame:
    """Usable points of a key in one task, by round, worker and order; points without a label or of another width are left out."""
    y = label(F.col("y")) if kind == "PA" else F.col("y")
    rows = points.select(*keys, "round", "worker", order, "x", y.cast("double").alias("y"))
    fit = rows.where(F.col("y").isNotNull() & (F.size("x") == width) & ~F.exists("x", lambda v: v.isNull()))
    return fit.repartition(*keys).sortWithinPartitions(*keys, "round", "worker", order).drop(order)


def _rounds_folder(keys: list[str], width: int, workers: int, kind: str, c: float, epsilon: float, every: bool):
    """Folds ``_in_rounds`` batch by batch: holds a key's global model, the round's step and one worker's weights.

    Gives every worker's delta of every round, or only each key's model after its last round.
    """
    names = [*keys, "round", "worker", "delta", "fitted"] if every else [*keys, "v", "fitted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = number = worker = v = w = step = None
        fitted, taken, out, types = 0, 0, [], None

        def told() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(values, t) for values, t in zip(zip(*out), types)], names=names)
            out.clear()
            return made

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if types is None:
                types = [*[batch.schema.field(k).type for k in names if k in (*keys, "round", "worker")], pa.list_(pa.float64()), pa.int64()]
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, width)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            edge = _edges([batch.column(k) for k in (*keys, "round", "worker")])
            for lo, hi in zip(edge, [*edge[1:], n]):
                *k, r, who = (batch.column(name)[lo].as_py() for name in (*keys, "round", "worker"))
                if (k, r, who) != (key, number, worker):
                    if key is not None:  # the worker's mini-batch ends
                        step = step + (w - v) / workers
                        if every:
                            out.append((*key, number, worker, (w - v).tolist(), fitted))
                    if k != key:
                        if key is not None and not every:
                            out.append((*key, (v + step).tolist(), taken))
                        v, step, taken = np.zeros(width + 1), np.zeros(width + 1), 0
                    elif r != number:
                        v, step = v + step, np.zeros(width + 1)
                    key, number, worker, w, fitted = k, r, who, v, 0
                w, fitted, taken = fold_rows(kind, x[lo:hi], y[lo:hi], w, c, epsilon), fitted + hi - lo, taken + hi - lo
            if out:
                yield told()
        if key is not None:
            out.append((*key, number, worker, (w - v).tolist(), fitted) if every else (*key, (v + step + (w - v) / workers).tolist(), taken))
            yield told()

    return run


def _edges(columns: list[pa.Array]) -> list[int]:
    """Where runs of equal rows begin; nulls are alike."""
    codes = np.stack([c.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False) for c in columns])
    return [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(0)) + 1).tolist()]


def train_rounds(points: DataFrame, keys: list[str], order: str, width: int, workers: int, n_rounds: int | None = None, kind: str = "PA", c: float = C, epsilon: float = EPSILON) -> DataFrame:
    """Synchronous training: every round all workers start from the same global models.

    Global models (keys, v, fitted) after all rounds, or after the first ``n_rounds``.  A round needs the model of the one
    before, so a key's rounds are streamed in order through one task: the number of jobs doesn't grow with the rounds.
    """
    some = points if n_rounds is None else points.where(F.col("round") < n_rounds)
    rows = _in_rounds(some, keys, order, width, kind)
    schema = T.StructType([rows.schema[k] for k in keys]).add("v", T.ArrayType(T.DoubleType())).add("fitted", T.LongType())
    return rows.mapInArrow(_rounds_folder(keys, width, workers, kind, c, epsilon, False), schema)


def round_deltas(points: DataFrame, keys: list[str], order: str, width: int, workers: int, kind: str = "PA", c: float = C, epsilon: float = EPSILON) -> DataFrame:
    """The deltas (keys, round, worker, delta, fitted) of every round of synchronous training, as ``train_rounds`` takes them.

    The global model after all rounds is the sum of the deltas over the number of workers.
    """
    rows = _in_rounds(points, keys, order, width, kind)
    schema = T.StructType([rows.schema[k] for k in (*keys, "round", "worker")])
    schema = schema.add("delta", T.ArrayType(T.DoubleType())).add("fitted", T.LongType())
    return rows.mapInArrow(_rounds_folder(keys, width, workers, kind, c, epsilon, True), schema)


def as_model(models: DataFrame) -> DataFrame:
    """Flat global models as STRUCT<w, b>."""
    return models.withColumn("model", unflatten(F.col("v")))


__all__ = ["as_model", "averaged", "batches", "deltas", "linear", "round_deltas", "train_rounds"]
