"""A pipeline's whole training as a fold over its points in order of arrival, and predictions by standing pipelines.

A ``Standing`` pipeline holds the global model, each logical worker's local one, the scalers' moments and the test
reservoir: its size depends on the model's width, not on the points.  Points of any number of pipelines stream through
tasks keyed by pipeline, sorted by arrival behind the row that holds the state, so nothing is collected and the result
doesn't depend on how the stream is cut into batches.

Workers (arrival order, worker = order modulo their number):

* of worker 0's every ten points the last two are held out.  The reservoir keeps the ``RESERVOIR`` points with the
  smallest hashes; the one that has to leave is trained on;
* Asynchronous: a worker that has taken a mini-batch adds its delta over the number of workers to the global model and
  goes on from it at once.  DynamicAveraging and FGM are accepted as names of the same scheme;
* Synchronous: all workers push together, whenever they have taken a mini-batch each on average;
* predictors get the model of every sixth push of worker 0.

Scalers learn from a training point before they scale it; predictors scale by the moments that came with their model.
Unlabelled points, other labels and points of another width than the first are taken without an effect on the learner.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideloom.plans import pipeline as pl

from .learners import _normal, _step
from .workers import HOLDOUT, RESERVOIR

#: Pushes of worker 0 between two models that predictors get.
REFRESH = 6
#: Bytes of models that may be broadcast.
BROADCAST = 64 << 20

_MOMENTS = "array<struct<n long, mean array<double>, squares array<double>>>"
STATE = (
    "pipeline int, created string, spec string, width int, seen array<long>, taken array<long>, learned array<long>, started array<long>, "
    f"base array<array<double>>, local array<array<double>>, model array<double>, fitted long, pushes array<long>, scalers {_MOMENTS}, "
    f"served array<double>, served_scalers {_MOMENTS}, tests array<struct<h long, ord long, x array<double>, y double>>"
)
MESSAGE = "worker int, op int, number long, fitted long, params array<double>"


def mixed(key: int, seed: int = 0) -> int:
    """The hash of ``workers.mixed`` for one key."""
    return ((key % (1 << 31) + seed) * 1103515245 + 12345) % (1 << 31)


@dataclass
class Scaler:
    """Moments of a StandardScaler: ``squares`` is the sum of squared deviations."""

    learn: bool = True
    n: int = 0
    mean: np.ndarray | None = None
    squares: np.ndarray | None = None

    def fit(self, x: np.ndarray) -> None:
        if self.n == 0 or self.mean is None or len(self.mean) != len(x):
            self.n, self.mean, self.squares = 1, x.copy(), np.zeros(len(x))
            return
        self.n += 1
        off = x - self.mean
        self.mean = self.mean + off / self.n
        self.squares = self.squares + off * (x - self.mean)

    def scale(self, x: np.ndarray) -> np.ndarray:
        """Rows or one row; as they are before a second point, 0 where nothing varies."""
        if self.n < 2 or self.mean is None or x.shape[-1] != len(self.mean):
            return x
        sigma = np.sqrt(self.squares / self.n)
        return np.divide(x - self.mean, sigma, out=np.zeros(np.broadcast(x, sigma).shape), where=sigma > 0)

    def copy(self) -> Scaler:
        return Scaler(self.learn, self.n, self.mean, self.squares)

    def row(self) -> dict:
        none = self.mean is None
        return {"n": self.n, "mean": None if none else self.mean.tolist(), "squares": None if none else self.squares.tolist()}


def _polynomial(x: np.ndarray, degree: int) -> np.ndarray:
    held = x
    for _ in range(degree - 1):
        held = np.concatenate((held, (held[..., :, None] * x[..., None, :]).reshape(*x.shape[:-1], -1)), axis=-1)
    return held


def _array(values) -> np.ndarray | None:
    return None if values is None or len(values) == 0 else np.asarray(values, dtype=float)


@dataclass
class Standing:
    """One pipeline between two points; see STATE for its row."""

    pipeline: int
    created: str
    spec: str
    workers: int
    width: int = 0
    seen: list[int] = field(default_factory=list)
    taken: list[int] = field(default_factory=list)
    learned: list[int] = field(default_factory=list)
    started: list[int] = field(default_factory=list)
    base: list[np.ndarray | None] = field(default_factory=list)
    local: list[np.ndarray | None] = field(default_factory=list)
    model: np.ndarray | None = None
    fitted: int = 0
    pushes: list[int] = field(default_factory=list)
    scalers: list[Scaler] = field(default_factory=list)
    served: np.ndarray | None = None
    served_scalers: list[Scaler] = field(default_factory=list)
    tests: list[tuple] = field(default_factory=list)
    refresh: int = REFRESH
    capacity: int = RESERVOIR
    drop_first: bool = False

    def __post_init__(self):
        self.made = pl.Pipeline.from_request(json.loads(self.spec))
        self.kind, self.learner = self.made.learner.name, self.made.learner
        self.messages: list[tuple] = []
        for name in ("seen", "taken", "learned", "started", "pushes"):
            if not getattr(self, name):
                setattr(self, name, [0] * self.workers)
        for name in ("base", "local"):
            if not getattr(self, name):
                setattr(self, name, [None] * self.workers)
        if not self.scalers:
            self.scalers = [self._scaler(p) for p in self.made.preprocessors if isinstance(p, pl.StandardScaler)]

    @staticmethod
    def _scaler(part: pl.StandardScaler) -> Scaler:
        s = part.start
        if not s:
            return Scaler(part.learn)
        return Scaler(part.learn, s["n"], np.asarray(s["mean"], dtype=float), np.asarray(s["variance"], dtype=float) * s["n"])

    # --- rows ---

    @classmethod
    def of(cls, row: dict, workers: int, **options) -> Standing:
        """From a STATE row; one that has only pipeline, created and spec is new."""
        own = {k: row.get(k) for k in ("pipeline", "created", "spec")} | {"workers": workers} | options
        if row.get("seen") is not None and len(row["seen"]):
            vectors = lambda vs: [_array(v) for v in vs]
            learn = [p.learn for p in pl.Pipeline.from_request(json.loads(row["spec"])).preprocessors if isinstance(p, pl.StandardScaler)]
            moments = lambda rows: [Scaler(k, int(r["n"]), _array(r["mean"]), _array(r["squares"])) for k, r in zip(learn, rows)]
            counts = {k: [int(x) for x in row[k]] for k in ("seen", "taken", "learned", "started", "pushes")}
            own |= counts | {"width": int(row["width"]), "fitted": int(row["fitted"]), "base": vectors(row["base"]), "local": vectors(row["local"])}
            own |= {"model": _array(row["model"]), "served": _array(row["served"]), "scalers": moments(row["scalers"]), "served_scalers": moments(row["served_scalers"])}
            own["tests"] = [(int(t["h"]), int(t["ord"]), np.asarray(t["x"], dtype=float), np.nan if t["y"] is None else float(t["y"])) for t in row["tests"]]
        return cls(**own)

    def row(self) -> dict:
        plain = lambda v: None if v is None else v.tolist()
        out = {k: getattr(self, k) for k in ("pipeline", "created", "spec", "width", "seen", "taken", "learned", "started", "fitted", "pushes")}
        out |= {"base": [plain(v) for v in self.base], "local": [plain(v) for v in self.local], "model": plain(self.model), "served": plain(self.served)}
        out |= {"scalers": [s.row() for s in self.scalers], "served_scalers": [s.row() for s in self.served_scalers]}
        return out | {"tests": [{"h": h, "ord": o, "x": x.tolist(), "y": y} for h, o, x, y in self.tests]}

    # --- points ---

    def learn(self, order: int, x, y: float | None) -> None:
        """One point of the stream, in order of arrival."""
        if x is None:
            return
        x, y = np.asarray(x, dtype=float), None if y is None or y != y else float(y)
        worker = order % self.workers
        place = self.seen[worker]
        self.seen[worker] += 1
        if self.drop_first and place == 0:
            return
        if worker == 0 and place % 10 in HOLDOUT:
            out = self._hold(order, x, y)
            if out is None:
                return
            _, _, x, y = out
        self._train(worker, x, y)

    def _hold(self, order: int, x: np.ndarray, y: float | None) -> tuple | None:
        """Into the test reservoir; gives the point that has to leave it."""
        self.tests.append((mixed(order), order, x, np.nan if y is None else y))
        if len(self.tests) <= self.capacity:
            return None
        return self.tests.pop(max(range(len(self.tests)), key=lambda i: self.tests[i][:2]))

    def piped(self, x: np.ndarray, scalers: list[Scaler], learn: bool = False) -> np.ndarray:
        """One point, or rows of points, through the preprocessors."""
        at = 0
        for part in self.made.preprocessors:
            if isinstance(part, pl.PolynomialFeatures):
                x = _polynomial(x, part.degree)
            else:
                if learn and scalers[at].learn:
                    scalers[at].fit(x)
                x, at = scalers[at].scale(x), at + 1
        return x

    def _train(self, worker: int, x: np.ndarray, y: float | None) -> None:
        if self.width and len(x) != self.width:
            return
        self.width = len(x)
        x = self.piped(x, self.scalers, learn=True)
        if self.local[worker] is None:  # the worker pulls the global model, or starts it
            self.base[worker] = self.learner.start_vector(len(x)) if self.model is None else self.model
            self.local[worker], self.started[worker] = self.base[worker], self.fitted
        self.taken[worker] += 1
        target = None if y is None else _normal(self.kind, y)
        if target is not None:
            self.local[worker] = self._moved(self.local[worker], x, target)
            self.learned[worker] += 1
        self._synchronise(worker)

    def _moved(self, v: np.ndarray, x: np.ndarray, y: float) -> np.ndarray:
        if self.kind == "ORR":
            wide = np.append(x, 1.0)
            return v + np.concatenate((np.outer(wide, wide).ravel(), y * wide))
        w, b = _step(self.kind, x, y, v[:-1], v[-1], self.learner.C, self.learner.epsilon)
        return np.append(w, b)

    def _synchronise(self, worker: int) -> None:
        batch = self.made.config.batch
        if self.made.config.protocol == "Synchronous":
            if sum(self.taken) >= batch * self.workers:
                start = self.model
                for k in range(self.workers):
                    if self.local[k] is not None:
                        self._push(k)
                if start is not self.model:
                    for k in range(self.workers):
                        self._pull(k)
        elif self.taken[worker] >= batch:
            self._push(worker)
            self._pull(worker)

    def _push(self, worker: int) -> None:
        delta = (self.local[worker] - self.base[worker]) / self.workers
        self.model = (self.base[worker] if self.model is None else self.model) + delta
        self.fitted += self.learned[worker]
        self.taken[worker], self.learned[worker] = 0, 0
        self.pushes[worker] += 1
        self.messages.append((worker, 1, sum(self.pushes), self.fitted, self.model.tolist()))
        if worker == 0 and self.pushes[0] % self.refresh == 0:
            self.served, self.served_scalers = self.model, [s.copy() for s in self.scalers]

    def _pull(self, worker: int) -> None:
        self.base[worker] = self.local[worker] = self.model
        self.started[worker] = self.fitted

    # --- answers ---

    def weights(self, v: np.ndarray | None) -> np.ndarray | None:
        """Weights with the intercept last; ridge solves for them (its global sums are averages over the workers)."""
        if v is None or self.kind != "ORR":
            return v
        n = int((np.sqrt(1 + 4 * len(v)) - 1) / 2)
        a, b = v[: n * n].reshape(n, n) * self.workers, v[n * n :] * self.workers
        return np.linalg.pinv(a + self.learner.ridge_of(n), hermitian=True) @ b

    def margins(self, x: np.ndarray, w: np.ndarray | None, scalers: list[Scaler]) -> np.ndarray:
        """Of rows of raw features; NaN without a model or on another width."""
        if w is None or x.shape[1] != self.width:
            return np.full(len(x), np.nan)
        wide = self.piped(x, scalers)
        return wide @ w[:-1] + w[-1] if wide.shape[1] == len(w) - 1 else np.full(len(x), np.nan)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """By the model that predictors have."""
        m = self.margins(x, self.weights(self.served), self.served_scalers)
        return np.where(np.isnan(m), np.nan, (m >= 0).astype(float)) if self.learner.classifies else m

    def score(self) -> float | None:
        """Worker 0's model on the labelled held-out points: accuracy, or root of the mean squared error."""
        right = [t for t in self.tests if t[3] == t[3] and len(t[2]) == self.width]
        own = self.local[0] if self.local[0] is not None else self.model
        if not right or own is None:
            return None
        x, y = np.stack([t[2] for t in right]), np.array([t[3] for t in right])
        m = self.margins(x, self.weights(own), self.scalers)
        if self.kind == "PA":
            return float(np.mean((m >= 0) == (y > 0)))
        return float(np.sqrt(np.mean((y - m) ** 2)))

    def describe(self) -> dict:
        """Preprocessors with what they learned, the learner with its parameters, protocol, points fitted and score."""
        own = self.local[0] if self.local[0] is not None else self.model
        parts, at = [], 0
        for part in self.made.preprocessors:
            if isinstance(part, pl.StandardScaler):
                s, at = self.scalers[at], at + 1
                part.state = None if s.mean is None else {"n": s.n, "mean": s.mean.tolist(), "variance": (s.squares / max(1, s.n)).tolist()}
            parts.append(part.describe())
        learner = self.learner.describe()
        learner["parameters"] = self.learner.parameters_of(own, self.workers)
        return {
            "preprocessors": parts,
            "learner": learner,
            "protocol": self.made.config.protocol,
            "dataFitted": self.started[0] + self.learned[0],
            "score": self.score(),
        }

    # --- handing over ---

    def clear(self) -> Standing:
        """A new pipeline of the same request."""
        return Standing(self.pipeline, self.created, self.spec, self.workers, refresh=self.refresh, capacity=self.capacity, drop_first=self.drop_first)

    def merge(self, other: Standing) -> Standing:
        """After a restart with other workers: the other's request, scalers and model, both counts; workers pull anew."""
        out = other.clear()
        out.width, out.model, out.fitted = other.width, other.model, self.fitted + other.fitted
        out.scalers, out.served, out.served_scalers = [s.copy() for s in other.scalers], other.served, other.served_scalers
        out.tests = sorted([*self.tests, *other.tests], key=lambda t: t[:2])[: out.capacity]
        return out


# --- tasks --------------------------------------------------------------------------------------------------------


def _plain(value):
    """A pandas cell of nested Arrow data as Python data."""
    if isinstance(value, np.ndarray):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return value.item() if isinstance(value, np.generic) else value


def _folder(workers: int, options: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Standing | None = None
        names = ["pipeline", "state", "message"]

        def told() -> list[tuple]:
            out = [(now.pipeline, None, dict(zip(("worker", "op", "number", "fitted", "params"), m))) for m in now.messages]
            now.messages.clear()
            return out

        for batch in batches:
            done = []
            for pipeline, state, order, x, y in zip(batch["pipeline"], batch["state"], batch["ord"], batch["x"], batch["y"]):
                if state is not None:
                    if now is not None:
                        done += [*told(), (now.pipeline, now.row(), None)]
                    now = Standing.of(_plain(state), workers, **options)
                elif now is not None and now.pipeline == pipeline:
                    now.learn(int(order), x, y)
            if now is not None:
                done += told()
            if done:
                yield pd.DataFrame(done, columns=names)
        if now is not None:
            yield pd.DataFrame([*told(), (now.pipeline, now.row(), None)], columns=names)

    return run


FOLDED = f"pipeline int, state struct<{STATE}>, message struct<{MESSAGE}>"


def fold(states: DataFrame, points: DataFrame, workers: int, tasks: int, **options) -> DataFrame:
    """FOLDED rows after the points (pipeline, ord, x, y): a state row a pipeline, and a message row a push.

    ``states``: STATE rows, every pipeline once.  A pipeline's points stream in order through one task.
    """
    state_of = F.struct(*[F.col(c) for c in T.StructType.fromDDL(STATE).names])
    left = states.select("pipeline", F.lit(0).cast("long").alias("ord"), F.lit(None).cast("array<double>").alias("x"), F.lit(None).cast("double").alias("y"), state_of.alias("state"))
    none = F.lit(None).cast(left.schema["state"].dataType)
    right = points.select("pipeline", F.col("ord").cast("long").alias("ord"), "x", F.col("y").cast("double").alias("y"), none.alias("state"))
    # equal orders are told apart by content, so that a repeated batch gives the same result
    rows = left.unionByName(right).withColumn("_t", F.xxhash64("x", "y"))
    dealt = rows.repartition(tasks, "pipeline").sortWithinPartitions("pipeline", F.col("state").isNull(), "ord", "_t").drop("_t")
    return dealt.mapInPandas(_folder(workers, options), FOLDED)


def new_states(registry: DataFrame) -> DataFrame:
    """STATE rows of pipelines (id, created, spec) without any point."""
    own = {"pipeline": F.col("id").cast("int"), "created": F.col("created"), "spec": F.col("spec")}
    return registry.select(*[own.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in T.StructType.fromDDL(STATE)])


def _predictor(held):
    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        rows = [None if v is None else np.asarray(v, dtype=float) for v in x]
        out = np.stack([_predicted(Standing.of(s, len(s["seen"])), rows) for s in held.value], axis=1)
        return pd.Series(list(out), dtype=object)

    return run


def _predicted(s: Standing, x: list[np.ndarray | None]) -> np.ndarray:
    """Rows of the pipeline's width together; null elsewhere."""
    out = np.full(len(x), np.nan)
    right = [i for i, v in enumerate(x) if v is not None and len(v) == s.width]
    if right:
        out[right] = s.predict(np.stack([x[i] for i in right]))
    return out


def _keyed_predictor(column: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for b in batches:
            state, parts, at = b["_state"], [], 0
            edges = [*np.flatnonzero(state.notna().to_numpy()).tolist(), len(b)]
            for edge in edges:
                part = b.iloc[at:edge]
                if now is not None and len(part):
                    x = [None if v is None else np.asarray(v, dtype=float) for v in part[column]]
                    parts.append(part.drop(columns=["_state", "_salt"]).assign(prediction=_predicted(now, x)))
                if edge < len(b):
                    row = _plain(state.iloc[edge])
                    now = Standing.of(row, len(row["seen"]))
                at = edge + 1
            yield from parts

    return run


def serving(states: DataFrame) -> dict[int, int]:
    """Pipelines that serve a model, with about how many bytes it takes: a row a pipeline reaches the driver."""
    each = 8 * (F.size("served") + 2 * F.coalesce(F.aggregate("served_scalers", F.lit(0), lambda s, m: s + F.size(m["mean"])), F.lit(0))) + F.length("spec")
    return {r["pipeline"]: r["bytes"] for r in states.where("served IS NOT NULL").select("pipeline", each.cast("long").alias("bytes")).collect()}


def predict(data: DataFrame, states: DataFrame, column: str = "x", largest: int = BROADCAST, rows_each: int = 200_000, sizes: dict[int, int] | None = None) -> DataFrame:
    """``data`` by every pipeline of ``states`` that serves a model: adds pipeline and prediction (null without a result).

    Models go to the records where they are ``largest`` bytes together at most (only ``column`` leaves the JVM then), and
    records to the models beyond that: by pipeline and salt, behind the row that holds the model.
    """
    spark, kept = data.sparkSession, ["pipeline", "created", "spec", "width", "seen", "served", "served_scalers"]
    sizes = serving(states) if sizes is None else sizes
    held = states.where("served IS NOT NULL").select(*[c if c in kept else F.lit(None).cast(states.schema[c].dataType).alias(c) for c in states.columns])
    schema = T.StructType([*data.schema.fields, T.StructField("pipeline", T.IntegerType()), T.StructField("prediction", T.DoubleType())])
    if not sizes:
        return spark.createDataFrame([], schema)
    if sum(sizes.values()) <= largest:
        rows = [_serving_row(r) for r in held.collect()]
        ids = F.lit([r["pipeline"] for r in rows]).cast("array<int>")
        both = F.arrays_zip(ids.alias("pipeline"), _predictor(spark.sparkContext.broadcast(rows))(F.col(column)).alias("prediction"))
        out = data.withColumn("_both", F.explode(both)).select(*data.columns, "_both.pipeline", "_both.prediction")
    else:
        out = _predict_keyed(data, held, sorted(sizes), column, max(1, -(-data.count() // rows_each)), schema)
    return out.withColumn("prediction", F.when(~F.isnan("prediction"), F.col("prediction")))


def _serving_row(row) -> dict:
    return row.asDict(recursive=True) | {"taken": [0] * len(row["seen"]), "learned": [0] * len(row["seen"]), "started": [0] * len(row["seen"]),
                                         "pushes": [0] * len(row["seen"]), "base": [None] * len(row["seen"]), "local": [None] * len(row["seen"]),
                                         "fitted": 0, "scalers": row["served_scalers"], "tests": []}


def _predict_keyed(data: DataFrame, held: DataFrame, ids: list[int], column: str, salts: int, schema: T.StructType) -> DataFrame:
    names = held.columns
    empty = {"taken": "seen", "learned": "seen", "started": "seen", "pushes": "seen"}
    full = held.select(*[F.transform(empty[c], lambda x: F.lit(0).cast("long")).alias(c) if c in empty else c for c in names])
    full = full.withColumns({
        "base": F.transform("seen", lambda x: F.lit(None).cast("array<double>")), "local": F.transform("seen", lambda x: F.lit(None).cast("array<double>")),
        "fitted": F.lit(0).cast("long"), "scalers": F.col("served_scalers"), "tests": F.array().cast(held.schema["tests"].dataType),
    })
    state = F.struct(*names)
    left = full.select("pipeline", state.alias("_state"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    salt = F.pmod(F.xxhash64(*[F.to_json(F.struct(column))]), F.lit(salts)).cast("int") if salts > 1 else F.lit(0)
    right = data.withColumn("_salt", salt).withColumn("pipeline", F.explode(F.lit(ids).cast("array<int>")))
    rows = left.unionByName(right, allowMissingColumns=True)
    dealt = rows.repartition("pipeline", "_salt").sortWithinPartitions("pipeline", "_salt", F.col("_state").isNull())
    ordered = dealt.select(*[f.name for f in data.schema.fields], "pipeline", "_state", "_salt")
    return ordered.mapInPandas(_keyed_predictor(column), schema)


def describe(states: DataFrame, asked: DataFrame) -> DataFrame:
    """Answers (responseId, id, value, score, dataFitted) to ``asked`` (requestId, pipeline, created, spec)."""
    named = states.select(F.col("pipeline").alias("_p"), F.col("created").alias("_c"), F.struct(*states.columns).alias("_state"))
    joined = asked.join(named, (F.col("pipeline") == F.col("_p")) & (F.col("created") == F.col("_c")), "left")
    schema = "responseId long, id int, protocol string, dataFitted long, score double, value string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for number, pipeline, created, spec, state in zip(b["requestId"], b["pipeline"], b["created"], b["spec"], b["_state"]):
                row = {"pipeline": pipeline, "created": created, "spec": spec} if state is None else _plain(state)
                s = Standing.of(row, len(row["seen"]) if row.get("seen") else 1)
                told = {"responseId": int(number), "id": int(pipeline)} | s.describe()
                out.append((told["responseId"], told["id"], told["protocol"], told["dataFitted"], told["score"], json.dumps(told)))
            yield pd.DataFrame(out, columns=["responseId", "id", "protocol", "dataFitted", "score", "value"])

    return joined.select("requestId", "pipeline", "created", "spec", "_state").mapInPandas(run, schema)


__all__ = ["FOLDED", "STATE", "Scaler", "Standing", "describe", "fold", "mixed", "new_states", "predict", "serving"]
