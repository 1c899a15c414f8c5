"""A penalised cyclic cubic spline of a series over the steps of a period, its smoothing weight chosen by restricted likelihood.

Spark adds up count, sum and sum of squares by step, and a period has a known number of steps; the rest is algebra of knots.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.mixed import minimise


@dataclass(frozen=True)
class Spline:
    """Coefficients are the curve's values at the knots; covariance is theirs; edf the effective degrees of freedom."""

    period: int
    values: np.ndarray
    covariance: np.ndarray
    weight: float
    scale: float
    edf: float
    restricted: float

    def at(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The curve and its standard error at steps t."""
        b = basis(t, self.period, len(self.values))
        return b @ self.values, np.sqrt(np.maximum(((b @ self.covariance) * b).sum(1), 0))


def _second(period: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(second derivatives at the knots from the values there, penalty matrix of the integral of their square)."""
    h, turn = period / k, np.roll(np.eye(k), 1, axis=1)
    bends = (4 * np.eye(k) + turn + turn.T) * h / 6
    changes = (turn + turn.T - 2 * np.eye(k)) / h
    second = np.linalg.solve(bends, changes)
    return second, changes.T @ second


def basis(t: np.ndarray, period: int, k: int) -> np.ndarray:
    """Rows of the cyclic cubic spline through k knots, evenly spaced from step 1 on: a row times the knots' values is the curve."""
    h = period / k
    place = np.mod(np.asarray(t, float) - 1, period) / h
    j = np.minimum(place.astype(int), k - 1)
    right = place - j
    left = 1 - right
    second, _ = _second(period, k)
    nxt, rows = (j + 1) % k, np.arange(len(j))
    out = np.zeros((len(j), k))
    out[rows, j] += left
    out[rows, nxt] += right
    return out + ((left**3 - left) * h * h / 6)[:, None] * second[j] + ((right**3 - right) * h * h / 6)[:, None] * second[nxt]


def _criterion(log_weight: float, cross: np.ndarray, slope: np.ndarray, square: float, n: float, penalty: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray]:
    weight = float(np.exp(log_weight))
    whole = cross + weight * penalty
    inverse = np.linalg.pinv(whole)
    beta = inverse @ slope
    scale = max(square - beta @ slope, 1e-300) / (n - 1)
    eigen = np.sort(np.linalg.eigvalsh(penalty))[1:]
    value = (n - 1) * (np.log(2 * np.pi * scale) + 1) + np.linalg.slogdet(whole)[1] - np.log(weight * eigen).sum()
    return value, beta, scale, inverse


def fit_spline(df: DataFrame, t: str, x: str, period: int, knots: int = 30) -> Spline:
    """The spline of x over steps t (1..period; others wrap around); rows without either are left out."""
    step = F.pmod(F.col(t).cast("long") - 1, F.lit(period)) + 1
    v = F.col(x).cast("double")
    rows = df.where(F.col(t).isNotNull() & v.isNotNull()).groupBy(step.alias("t")).agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q")).orderBy("t").collect()
    if len(rows) <= 3:
        raise ValueError("too few steps with a value for a spline")
    at, n, s, q = (np.array([r[c] for r in rows], float) for c in ("t", "n", "s", "q"))
    k = min(knots, len(rows))
    b = basis(at, period, k)
    _, penalty = _second(period, k)
    sums = b.T @ (n[:, None] * b), b.T @ s, q.sum(), n.sum(), penalty
    f = lambda p: _criterion(float(p[0]), *sums)[0]
    level = np.log(np.trace(sums[0]) / np.trace(penalty))
    grid = [np.array([level + g]) for g in np.arange(-20.0, 21.0, 2.0)]
    best = minimise(f, min(grid, key=f))
    value, beta, scale, inverse = _criterion(float(best[0]), *sums)
    return Spline(period, beta, scale * inverse, float(np.exp(best[0])), float(scale), float(np.trace(inverse @ sums[0])), float(value))


def cyclic_spline(df: DataFrame, t: str, x: str, period: int, knots: int = 30) -> DataFrame:
    """df with smooth and smooth_se: the fitted curve at each row's step."""
    own = fit_spline(df, t, x, period, knots)
    steps = np.arange(1, period + 1)
    curve, error = own.at(steps)
    table = df.sparkSession.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(steps, curve, error, strict=True)], "_t long, smooth double, smooth_se double")
    return df.join(F.broadcast(table), F.pmod(F.col(t).cast("long") - 1, F.lit(period)) + 1 == F.col("_t")).drop("_t")
