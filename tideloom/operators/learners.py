"""Online learners: passive-aggressive classification and regression, and ridge regression.

Passive-aggressive fitting depends on the order of points, so it is a fold.  ``fit_in_order`` streams each key's rows
in order through a task in Arrow batches and holds one model, not the rows.  ``fold_batch`` folds a bounded mini-batch
as a built-in expression.  Ridge regression is sums, in any order: partial aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import mul

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideloom.functions.linalg import dot, total

C, EPSILON = 0.01, 0.0
#: Rows up to this width are folded as plain floats.
NARROW = 32


def label(y: Column) -> Column:
    """-1 or 1; 0 counts as -1; any other label is null and not learned from."""
    return F.when(y == 0, -1.0).when((y == 1) | (y == -1), y)


def margin(x: Column, w: Column, b: Column) -> Column:
    """Null without a model or on unequal widths."""
    return dot(w, x) + b


def classify(m: Column) -> Column:
    return F.when(m >= 0, 1.0).when(m < 0, 0.0)


def accuracy(y: Column, m: Column) -> Column:
    """Aggregate: share of labels met; labels are brought to 0 and 1 first."""
    return F.avg(F.when(F.when(label(y) > 0, 1.0).otherwise(0.0) == classify(m), 1.0).otherwise(0.0))


def rmse(y: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg((y - predicted) * (y - predicted)))


def _step(kind: str, x: np.ndarray, y: float, w: np.ndarray, b: float, c: float, epsilon: float):
    m = float(x @ w) + b
    if kind == "PA":
        sign, loss = y, 1.0 - y * m
    else:
        sign, loss = (1.0 if y - m >= 0 else -1.0), abs(y - m) - epsilon
    if loss > 0:
        tau = loss / (float(x @ x) + 1.0 + 1.0 / (2.0 * c)) * sign
        return w + tau * x, b + tau
    return w, b


def _normal(kind: str, y) -> float | None:
    if y is None or y != y:
        return None
    if kind == "PA":
        return {0.0: -1.0, 1.0: 1.0, -1.0: -1.0}.get(float(y))
    return float(y)


def _normals(kind: str, y: np.ndarray) -> np.ndarray:
    """Targets as they are learned from; NaN ones are left out."""
    y = y.astype(float)
    if kind != "PA":
        return y
    return np.where(y == 0, -1.0, np.where(np.abs(y) == 1, y, np.nan))


def fold_segments(kind: str, x: np.ndarray, y: np.ndarray, starts: np.ndarray, w: np.ndarray, c: float, epsilon: float) -> np.ndarray:
    """Weights (intercept last, a row a segment) after each segment's rows in order, a step of all segments at a time."""
    lengths, w = np.diff(np.append(starts, len(x))), w.copy()
    order = np.argsort(-lengths, kind="stable")
    left = -lengths[order]
    size = (x * x).sum(1) + 1.0 + 1.0 / (2.0 * c)
    for r in range(int(lengths.max(initial=0))):
        live = order[: np.searchsorted(left, -r)]
        i = starts[live] + r
        xi, yi, wi = x[i], y[i], w[live]
        m = (wi[:, :-1] * xi).sum(1) + wi[:, -1]
        if kind == "PA":
            sign, loss = yi, 1.0 - yi * m
        else:
            sign, loss = np.where(yi - m >= 0, 1.0, -1.0), np.abs(yi - m) - epsilon
        tau = np.maximum(loss, 0.0) / size[i] * sign
        w[live, :-1] = wi[:, :-1] + tau[:, None] * xi
        w[live, -1] = wi[:, -1] + tau
    return w


def fold_rows(kind: str, x: np.ndarray, y: np.ndarray, w: np.ndarray, c: float, epsilon: float) -> np.ndarray:
    """Weights (intercept last) after the rows in order; narrow rows go as plain floats, which are faster there than array calls."""
    if x.shape[1] > NARROW:
        v, b = w[:-1], float(w[-1])
        for xi, yi in zip(x, y.tolist()):
            v, b = _step(kind, xi, yi, v, b, c, epsilon)
        return np.append(v, b)
    size = ((x * x).sum(1) + 1.0 + 1.0 / (2.0 * c)).tolist()
    now = w.tolist()
    for xi, yi, s in zip(np.column_stack((x, np.ones(len(x)))).tolist(), y.tolist(), size):
        m = sum(map(mul, now, xi))
        if kind == "PA":
            sign, loss = yi, 1.0 - yi * m
        else:
            sign, loss = (1.0 if yi - m >= 0 else -1.0), abs(yi - m) - epsilon
        if loss > 0:
            tau = loss / s * sign
            now = [p + tau * q for p, q in zip(now, xi)]
    return np.array(now)


def _folder(kind: str, keys: list[str], c: float, epsilon: float, start: np.ndarray | None = None):
    """Segments of equal keys follow each other; the last one of a batch may go on in the next."""

    def first(width: int) -> np.ndarray:
        return np.zeros(width + 1) if start is None else start.copy()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, w, n = None, None, 0  # the key that is open, its weights, its points

        def closed(key, w, n):
            return (*key, [] if w is None else w[:-1].tolist(), 0.0 if w is None else float(w[-1]), n)

        for batch in batches:
            if not len(batch):
                continue
            rows = list(batch[keys].itertuples(index=False, name=None))
            target = _normals(kind, batch["y"].to_numpy())
            widths = np.array([-1 if v is None else len(v) for v in batch["x"]])
            edge = np.array([0, *[i for i in range(1, len(rows)) if rows[i] != rows[i - 1]]])
            done, fit = [], (widths >= 0) & ~np.isnan(target)
            carried = w if rows[0] == now else None
            if now is not None and rows[0] != now:
                done.append(closed(now, w, n))
            counts, ends = [], np.append(edge[1:], len(rows))
            state: list[np.ndarray | None] = [carried if s == 0 else None for s in range(len(edge))]
            for s, (lo, hi) in enumerate(zip(edge, ends)):  # a key's first usable point fixes its width
                own = np.flatnonzero(fit[lo:hi]) + lo
                if len(own) and state[s] is None:
                    state[s] = first(widths[own[0]])
                if state[s] is not None:
                    fit[lo:hi] &= widths[lo:hi] == len(state[s]) - 1
                counts.append(int(fit[lo:hi].sum()))
            for width in {len(v) - 1 for v in state if v is not None}:
                some = [s for s in range(len(edge)) if counts[s] and state[s] is not None and len(state[s]) == width + 1]
                if not some:
                    continue
                taken = np.concatenate([np.flatnonzero(fit[edge[s] : ends[s]]) + edge[s] for s in some])
                x = np.concatenate([np.asarray(batch["x"].iloc[i], dtype=float) for i in taken]).reshape(len(taken), width)
                starts = np.concatenate(([0], np.cumsum([counts[s] for s in some])[:-1]))
                moved = fold_segments(kind, x, target[taken], starts, np.stack([state[s] for s in some]), c, epsilon)
                for s, v in zip(some, moved):
                    state[s] = v
            for s, lo in enumerate(edge):
                before = n if s == 0 and rows[0] == now else 0
                if s < len(edge) - 1:
                    done.append(closed(rows[lo], state[s], before + counts[s]))
                else:
                    last = rows[lo], state[s], before + counts[s]
            now, w, n = last
            if done:
                yield pd.DataFrame(done, columns=[*keys, "w", "b", "fitted"])
        if now is not None:
            yield pd.DataFrame([closed(now, w, n)], columns=[*keys, "w", "b", "fitted"])

    return run


def fit_in_order(
    points: DataFrame, keys: list[str], order: str, kind: str = "PA", c: float = C, epsilon: float = EPSILON, start: np.ndarray | None = None
) -> DataFrame:
    """One model (keys, w, b, fitted) per key from its points (keys, order, x, y), taken in order from zero, or from ``start``.

    kind: PA or regressorPA.  Unlabelled points, other labels and points of another width are left out.
    """
    rows = points.select(*keys, order, "x", F.col("y").cast("double").alias("y"))
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, order).drop(order)
    schema = T.StructType([rows.schema[k] for k in keys])
    for name, kind_of in (("w", T.ArrayType(T.DoubleType())), ("b", T.DoubleType()), ("fitted", T.LongType())):
        schema = schema.add(name, kind_of)
    return dealt.mapInPandas(_folder(kind, keys, c, epsilon, start), schema)


def _next(kind: str, s: Column, r: Column, c: float, epsilon: float) -> Column:
    """The state after one point; loss and step size are bound once through a one-element array."""
    x, y = r["x"], r["y"]
    facts = F.struct((total(F.zip_with(s["w"], x, lambda p, q: p * q)) + s["b"]).alias("m"), total(F.transform(x, lambda v: v * v)).alias("n"))

    def moved(f: Column) -> Column:
        if kind == "PA":
            sign, loss = y, 1.0 - y * f["m"]
        else:
            sign, loss = F.when(y - f["m"] >= 0, 1.0).otherwise(-1.0), F.abs(y - f["m"]) - epsilon
        return F.greatest(loss, F.lit(0.0)) / (f["n"] + (1.0 + 1.0 / (2.0 * c))) * sign

    tau = F.transform(F.array(facts), moved)
    return F.get(F.transform(tau, lambda t: F.struct(F.zip_with(s["w"], x, lambda p, q: p + t * q).alias("w"), (s["b"] + t).alias("b"))), F.lit(0))


def fold_batch(rows: Column, start: Column, kind: str = "PA", c: float = C, epsilon: float = EPSILON) -> Column:
    """STRUCT<w, b> after an ordered ARRAY<STRUCT<.., x, y>> of a mini-batch, from the state ``start``.

    Labels have to be normal already (see ``label``); meant for batches of bounded size.
    """
    return F.aggregate(rows, start, lambda s, r: _next(kind, s, r, c, epsilon))


def ridge_sums(points: DataFrame, keys: list[str], features: list[str], target: str) -> DataFrame:
    """Per key the sums of x x^T and y x, x with a last 1: columns a_i_j (i <= j) and b_i, and n."""
    wide = [*[F.col(f).cast("double") for f in features], F.lit(1.0)]
    y = F.col(target).cast("double")
    labelled = points.where(F.col(target).isNotNull())
    sums = [F.sum(wide[i] * wide[j]).alias(f"a_{i}_{j}") for i in range(len(wide)) for j in range(i, len(wide))]
    sums += [F.sum(y * x).alias(f"b_{i}") for i, x in enumerate(wide)]
    return labelled.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)


def ridge_state(sums: DataFrame, n_features: int) -> DataFrame:
    """The sums as arrays: ``A`` by rows and ``b``."""
    n = n_features + 1
    rows = F.array(*[F.array(*[F.col(f"a_{min(i, j)}_{max(i, j)}") for j in range(n)]) for i in range(n)])
    return sums.withColumns({"A": rows, "b": F.array(*[F.col(f"b_{i}") for i in range(n)])})


def ridge_solution(ridge: float = 0.0):
    """Pandas UDF (A, b) -> weights with the intercept last: pseudo-inverse of A + ridge I, one small system a row."""

    @F.pandas_udf("array<double>")
    def solve(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for m, v in zip(a, b):
            m = np.stack([np.asarray(r, dtype=np.float64) for r in m])
            out.append((np.linalg.pinv(m + ridge * np.eye(len(m)), hermitian=True) @ np.asarray(v, dtype=np.float64)).tolist())
        return pd.Series(out, dtype=object)

    return solve


def ridge_predict(x: Column, weights: Column) -> Column:
    return dot(F.concat(x, F.array(F.lit(1.0))), weights)
