"""Preprocessors: polynomial features and standard scaling (batch, running, and with a state that carries on)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideloom.functions.ordered import running


def polynomial(x: Column, degree: int = 2) -> Column:
    """All products of up to ``degree`` features in order of making, repeats included: n + n*n wide for degree 2.

    For a higher degree the products of all so far with each feature are appended again, so lower terms recur.
    """
    if degree < 1:
        raise ValueError("degree is at least 1")
    out = x
    for _ in range(degree - 1):
        held = out
        out = F.concat(held, F.flatten(F.transform(held, lambda a: F.transform(x, lambda b: a * b))))
    return out


def polynomial_width(n: int, degree: int) -> int:
    width = n
    for _ in range(degree - 1):
        width += width * n
    return width


def moments(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Scaler state per key: n, and mean and variance (of the population) of each feature."""
    sums = [a for f in features for a in (F.avg(f).alias(f"mean_{f}"), F.var_pop(f).alias(f"var_{f}"))]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)


def merged(features: list[str], a: str = "a", b: str = "b") -> list[Column]:
    """Two states ``a`` and ``b`` (structs) as one, in any grouping: the variances' sums of squares add with a shift."""
    p, q = F.col(a), F.col(b)
    n = p["n"] + q["n"]
    out = [n.alias("n")]
    for f in features:
        shift = q[f"mean_{f}"] - p[f"mean_{f}"]
        out.append((p[f"mean_{f}"] + shift * F.try_divide(q["n"], n)).alias(f"mean_{f}"))
        squares = p[f"var_{f}"] * p["n"] + q[f"var_{f}"] * q["n"] + shift * shift * p["n"] * F.try_divide(q["n"], n)
        out.append(F.try_divide(squares, n).alias(f"var_{f}"))
    return out


def scaled(x: Column, mean: Column, variance: Column, n: Column | None = None) -> Column:
    """(x - mean) / sigma; 0 where nothing varies; x itself before a second point."""
    z = F.when(variance > 0, (x - mean) / F.sqrt(variance)).otherwise(0.0)
    return z if n is None else F.when(n > 1, z).otherwise(x)


def scale_batch(df: DataFrame, features: list[str], state: DataFrame | None = None) -> DataFrame:
    """All rows by the final state: fitted on them, or given (one row)."""
    fitted = state if state is not None else moments(df, [], features)
    row = fitted.select(*[F.col(c).alias(f"_{c}") for c in fitted.columns]).first().asDict()  # one row by construction
    value = lambda c: F.lit(row[f"_{c}"]).cast("double")
    z = {f"z_{f}": scaled(F.col(f).cast("double"), value(f"mean_{f}"), value(f"var_{f}"), F.lit(row["_n"])) for f in features}
    return df.withColumns(z)


def scale_running(df: DataFrame, keys: list[str], order: str, features: list[str], block: int = 4096) -> DataFrame:
    """Each row by the moments of the rows up to and with it, per key."""
    pilot = df.groupBy(*keys).agg(*[F.avg(f).alias(f"_mid_{f}") for f in features]) if keys else df.agg(*[F.avg(f).alias(f"_mid_{f}") for f in features])
    joined = df.join(pilot, keys) if keys else df.join(F.broadcast(pilot))
    sums = {"_n": F.lit(1).cast("long")}
    for f in features:  # around the key's mean, so that squares don't cancel
        shift = F.col(f) - F.col(f"_mid_{f}")
        sums |= {f"_s_{f}": shift, f"_q_{f}": shift * shift}
    out = running(joined, keys, order, sums, block)
    z = {}
    for f in features:
        mean = F.col(f"_s_{f}") / F.col("_n")
        variance = F.greatest(F.col(f"_q_{f}") / F.col("_n") - mean * mean, F.lit(0.0))
        flat = variance <= 1e-14 * F.greatest(F.lit(1.0), F.col(f) * F.col(f))
        z[f"z_{f}"] = scaled(F.col(f), mean + F.col(f"_mid_{f}"), F.when(flat, 0.0).otherwise(variance), F.col("_n"))
    return out.withColumns(z).drop("_n", *[c for f in features for c in (f"_s_{f}", f"_q_{f}", f"_mid_{f}")])
