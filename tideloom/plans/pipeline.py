"""Pipelines: ordered preprocessors and one learner, built from a request; the registries of names."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideloom.operators import learners, preprocess

PROTOCOLS = ("Asynchronous", "Synchronous", "DynamicAveraging", "FGM")


class ConfigError(ValueError):
    """A request that names something unknown or gives a value of the wrong kind."""


def _number(value: Any, name: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ConfigError(f"{name} is a number, not {value!r}")
    return float(value)


def _integer(value: Any, name: str, least: int = 1) -> int:
    number = _number(value, name)
    if number != int(number) or number < least:
        raise ConfigError(f"{name} is an integer of at least {least}, not {value!r}")
    return int(number)


def _known(given: dict | None, names: tuple[str, ...], what: str) -> dict:
    given = {k: v for k, v in (given or {}).items() if v is not None}
    if unknown := sorted(set(given) - set(names)):
        raise ConfigError(f"{what} has no {', '.join(unknown)}")
    return given


def _vector(value: Any, name: str) -> np.ndarray:
    try:
        out = np.asarray(value, dtype=float)
    except (TypeError, ValueError) as e:
        raise ConfigError(f"{name} is a list of numbers") from e
    if not np.isfinite(out).all():
        raise ConfigError(f"{name} is finite")
    return out


@dataclass
class TrainingConfig:
    """mini_batch_size x mini_batches points per synchronisation, and the protocol."""

    mini_batch_size: int = 64
    mini_batches: int = 4
    protocol: str = "Asynchronous"

    @classmethod
    def of(cls, raw: dict | None) -> TrainingConfig:
        raw = raw or {}
        out = cls(
            _integer(raw.get("mini_batch_size", 64), "mini_batch_size"),
            _integer(raw.get("mini_batches", 4), "mini_batches"),
            raw.get("protocol", "Asynchronous"),
        )
        if out.protocol not in PROTOCOLS:
            raise ConfigError(f"unknown protocol {out.protocol!r}")
        return out

    @property
    def batch(self) -> int:
        return self.mini_batch_size * self.mini_batches


class Preprocessor(ABC):
    """A step in front of the learner; hyperparameters are set from a map, all names known."""

    hyper: tuple[str, ...] = ()
    params: tuple[str, ...] = ()

    @classmethod
    @abstractmethod
    def of(cls, hyper: dict | None, params: dict | None) -> Preprocessor: ...

    @abstractmethod
    def transform(self, df: DataFrame, training: DataFrame | None = None) -> DataFrame:
        """``df`` with its ``x`` changed; what is learned comes from ``training`` (default: ``df``)."""

    @abstractmethod
    def describe(self) -> dict: ...

    def clear(self) -> None:
        """Forgets what was learned."""


class LearningPreprocessor(Preprocessor):
    """One that learns from points while ``learn`` is set."""

    learn: bool

    def freeze(self) -> None:
        self.learn = False

    def enable(self) -> None:
        self.learn = True


@dataclass
class PolynomialFeatures(Preprocessor):
    degree: int = 2
    hyper = ("degree",)

    @classmethod
    def of(cls, hyper: dict | None, params: dict | None) -> PolynomialFeatures:
        _known(params, (), "PolynomialFeatures")
        return cls(_integer(_known(hyper, cls.hyper, "PolynomialFeatures").get("degree", 2), "degree"))

    def transform(self, df: DataFrame, training: DataFrame | None = None) -> DataFrame:
        return df.withColumn("x", preprocess.polynomial(F.col("x"), self.degree))

    def describe(self) -> dict:
        return {"name": "PolynomialFeatures", "hyperparameters": {"degree": self.degree}, "parameters": None}


@dataclass
class StandardScaler(LearningPreprocessor):
    """Fitted on the training points of a batch; ``start`` (n, mean, variance lists) carries on from earlier ones.

    Without ``learn`` it scales by ``start`` alone, and leaves points as they are where there is none.
    """

    learn: bool = True
    start: dict | None = None
    state: dict | None = None
    hyper = ("learn",)
    params = ("mean", "variance", "count")

    @classmethod
    def of(cls, hyper: dict | None, params: dict | None) -> StandardScaler:
        learn = _known(hyper, cls.hyper, "StandardScaler").get("learn", True)
        if not isinstance(learn, bool):
            raise ConfigError("learn is true or false")
        given = _known(params, cls.params, "StandardScaler")
        if not given:
            return cls(learn)
        if len(given) < 3:
            raise ConfigError("mean, variance and count come together")
        mean, variance = _vector(given["mean"], "mean"), _vector(given["variance"], "variance")
        if mean.shape != variance.shape or mean.ndim != 1 or (variance < 0).any():
            raise ConfigError("mean and variance are lists of one length, no variance below 0")
        return cls(learn, {"n": _integer(given["count"], "count", 0), "mean": mean.tolist(), "variance": variance.tolist()})

    def fit(self, df: DataFrame) -> dict:
        """One aggregate over all points: a row per feature reaches the driver."""
        each = df.select(F.posexplode("x").alias("pos", "v")).groupBy("pos")
        rows = each.agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s")).orderBy("pos").collect()
        new = {"n": rows[0]["n"] if rows else 0, "mean": [r["m"] for r in rows], "variance": [r["s"] for r in rows]}
        return _carried(self.start, new) if self.start else new

    def transform(self, df: DataFrame, training: DataFrame | None = None) -> DataFrame:
        self.state = self.fit(training if training is not None else df) if self.learn else self.start
        s = self.state
        if s is None or s["n"] < 2:
            return df
        mean, sigma = (F.array(*[F.lit(float(v)) for v in vs]) for vs in (s["mean"], [v**0.5 for v in s["variance"]]))
        z = F.zip_with(F.zip_with("x", mean, lambda x, m: x - m), sigma, lambda d, v: F.when(v > 0, d / v).otherwise(0.0))
        return df.withColumn("x", z)

    def describe(self) -> dict:
        s = self.state or self.start
        params = {"mean": s["mean"], "variance": s["variance"], "count": s["n"]} if s else None
        return {"name": "StandardScaler", "hyperparameters": {"learn": self.learn}, "parameters": params}

    def clear(self) -> None:
        self.state = None


def _carried(a: dict, b: dict) -> dict:
    n = a["n"] + b["n"]
    if not b["n"]:
        return a
    out = {"n": n, "mean": [], "variance": []}
    for ma, va, mb, vb in zip(a["mean"], a["variance"], b["mean"], b["variance"], strict=True):
        d = mb - ma
        out["mean"].append(ma + d * b["n"] / n)
        out["variance"].append((va * a["n"] + vb * b["n"] + d * d * a["n"] * b["n"] / n) / n)
    return out


@dataclass
class Learner:
    """PA, regressorPA or ORR, with its hyperparameters; ``fit`` gives (keys, w, b, fitted).

    ``start`` are parameters to go on from: weights ``a`` and intercept ``b``, or for ORR the sums ``a`` (or ``A``) by rows
    and ``b``.  ``legacy``: a regressor answers 0 or 1 and a ridge's lambda has no effect, for consumers used to that.
    """

    name: str
    C: float = learners.C
    epsilon: float = learners.EPSILON
    ridge: float = 0.0
    start: tuple[np.ndarray, np.ndarray] | None = None
    legacy: bool = False

    @classmethod
    def of(cls, name: str, hyper: dict | None, params: dict | None) -> Learner:
        out = cls(name)
        attributes = {"C": "C", "epsilon": "epsilon", "lambda": "ridge"}
        for key, value in _known(hyper, HYPERPARAMETERS[name], name).items():
            setattr(out, attributes[key], _number(value, key))
        if out.C <= 0 or out.epsilon < 0 or out.ridge < 0:
            raise ConfigError("C is positive, epsilon and lambda are not negative")
        given = _known(params, ("a", "A", "b") if name == "ORR" else ("a", "b"), name)
        if given:
            if "b" not in given or len(given) != 2:
                raise ConfigError("parameters a and b come together")
            a, b = _vector(given.get("a", given.get("A")), "a"), np.atleast_1d(_vector(given["b"], "b"))
            if name == "ORR" and a.size != b.size**2 or name != "ORR" and (a.ndim != 1 or b.size != 1):
                raise ConfigError("parameters a and b don't fit each other")
            out.start = (a.ravel(), b)
        return out

    @property
    def classifies(self) -> bool:
        return self.name == "PA" or (self.legacy and self.name == "regressorPA")

    def start_vector(self, width: int) -> np.ndarray:
        """Flat parameters before the first point; a start of another width is an error."""
        size = (width + 1) * (width + 2) if self.name == "ORR" else width + 1
        if self.start is None:
            return np.zeros(size)
        out = np.concatenate(self.start)
        if len(out) != size:
            raise ConfigError(f"parameters for {size} numbers are needed, not {len(out)}")
        return out

    def ridge_of(self, n: int) -> np.ndarray:
        return np.zeros((n, n)) if self.legacy else self.ridge * np.eye(n)

    def parameters_of(self, v: np.ndarray | None, scale: float = 1.0) -> dict | None:
        """Flat parameters as a response names them; ``scale`` brings averages of sums back to sums."""
        if v is None:
            return None
        if self.name != "ORR":
            return {"a": v[:-1].tolist(), "b": float(v[-1])}
        n = int((np.sqrt(1 + 4 * len(v)) - 1) / 2)
        return {"a": (v[: n * n].reshape(n, n) * scale).tolist(), "b": (v[n * n :] * scale).tolist()}

    def fit(self, points: DataFrame, keys: list[str], order: str, width: int) -> DataFrame:
        if self.name != "ORR":
            start = None if self.start is None else self.start_vector(width)
            return learners.fit_in_order(points, keys, order, self.name, self.C, self.epsilon, start)
        named = [f"f{i}" for i in range(width)]
        flat = points.select(*keys, "y", *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(named)])
        state = learners.ridge_state(learners.ridge_sums(flat, keys, named, "y"), width)
        if self.start is not None:
            a, b = self.start_vector(width)[: -(width + 1)].reshape(width + 1, -1), self.start[1]
            held = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in a]), F.array(*[F.lit(float(v)) for v in b])
            added = F.zip_with("A", held[0], lambda p, q: F.zip_with(p, q, lambda u, v: u + v))
            state = state.withColumns({"A": added, "b": F.zip_with("b", held[1], lambda u, v: u + v)})
        solved = state.withColumn("_v", learners.ridge_solution(0.0 if self.legacy else self.ridge)(F.col("A"), F.col("b")))
        return solved.select(*keys, F.slice("_v", 1, width).alias("w"), F.element_at("_v", -1).alias("b"), F.col("n").alias("fitted"))

    def predict(self, x, w, b):
        m = learners.margin(x, w, b)
        return learners.classify(m) if self.classifies else m

    def score(self, y, x, w, b):
        m = learners.margin(x, w, b)
        return learners.accuracy(y, m) if self.name == "PA" else learners.rmse(y, m)

    def describe(self, model: dict | None = None) -> dict:
        hyper = {"PA": {"C": self.C}, "regressorPA": {"C": self.C, "epsilon": self.epsilon}, "ORR": {"lambda": self.ridge}}[self.name]
        return {"name": self.name, "hyperparameters": hyper, "parameters": {"a": model["w"], "b": model["b"]} if model else None}


HYPERPARAMETERS = {"PA": ("C",), "regressorPA": ("C", "epsilon"), "ORR": ("lambda",)}
PREPROCESSORS: dict[str, Callable] = {"PolynomialFeatures": PolynomialFeatures.of, "StandardScaler": StandardScaler.of}
LEARNERS: dict[str, Callable] = {n: (lambda n: lambda h, p: Learner.of(n, h, p))(n) for n in ("PA", "regressorPA", "ORR")}


@dataclass
class Pipeline:
    """Preprocessors in order, then a learner.  Batch form: each stage transforms all points."""

    learner: Learner | None = None
    preprocessors: list = field(default_factory=list)
    config: TrainingConfig = field(default_factory=TrainingConfig)
    fitted: int = 0

    @classmethod
    def from_request(cls, request: dict) -> Pipeline:
        parts = []
        for p in request.get("preprocessors") or []:
            if p["name"] not in PREPROCESSORS:
                raise ConfigError(f"unknown preprocessor {p['name']!r}")
            parts.append(PREPROCESSORS[p["name"]](p.get("hyperparameters") or {}, p.get("parameters") or {}))
        own = request["learner"]
        if own["name"] not in LEARNERS:
            raise ConfigError(f"unknown learner {own['name']!r}")
        learner = LEARNERS[own["name"]](own.get("hyperparameters") or {}, own.get("parameters") or {})
        config = dict(request.get("training_configuration") or {})
        if "protocol" in request:
            config.setdefault("protocol", request["protocol"])
        return cls(learner, parts, TrainingConfig.of(config))

    def add_preprocessor(self, part, at: int | None = None) -> Pipeline:
        self.preprocessors.insert(len(self.preprocessors) if at is None else at, part)
        return self

    def remove_preprocessor(self, at: int) -> Pipeline:
        del self.preprocessors[at]
        return self

    def add_learner(self, learner: Learner) -> Pipeline:
        self.learner = learner
        return self

    def remove_learner(self) -> Pipeline:
        self.learner = None
        return self

    def clear(self) -> Pipeline:
        """Forgets what preprocessors learned and the count of points; models belong to the tables that ``fit`` gave."""
        self.fitted = 0
        for p in self.preprocessors:
            p.clear()
        return self

    def merge(self, other: Pipeline) -> Pipeline:
        """Both counts, and the other's preprocessors and learner."""
        self.fitted, self.preprocessors, self.learner = self.fitted + other.fitted, list(other.preprocessors), other.learner
        return self

    def width(self, n: int) -> int:
        for p in self.preprocessors:
            n = preprocess.polynomial_width(n, p.degree) if isinstance(p, PolynomialFeatures) else n
        return n

    def transform(self, df: DataFrame, training: DataFrame | None = None) -> DataFrame:
        """``df`` through the preprocessors; what they learn comes from ``training`` (default: ``df``)."""
        for p in self.preprocessors:
            known = training if training is not None else df
            df, training = p.transform(df, known), (p.transform(known, known) if training is not None else None)
        return df

    def fit(self, points: DataFrame, keys: list[str], order: str, n_features: int) -> DataFrame:
        return self.learner.fit(self.transform(points), keys, order, self.width(n_features))

    def describe(self, model: dict | None = None, score: float | None = None) -> dict:
        return {
            "preprocessors": [p.describe() for p in self.preprocessors],
            "learner": self.learner.describe(model),
            "protocol": self.config.protocol,
            "dataFitted": model["fitted"] if model else 0,
            "score": score,
        }
