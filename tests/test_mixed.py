"""Mixed models with crossed intercepts against dense algebra, known densities and simulated parameters."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import mixed as M


def simulated(rng, units=40, levels=8, lost=0.2):
    rows, u, v = [], rng.normal(0, 0.7, units), rng.normal(0, 0.4, levels)
    for g in range(units):
        for t in range(levels):
            if rng.random() < lost:
                continue
            x = rng.normal(), rng.normal()
            rows.append(("a", g, 2000 + t, 1.0 + 0.8 * x[0] - 0.5 * x[1] + u[g] + v[t] + rng.normal(0, 0.5), *x))
    return plain(rows)


def plain(rows):
    return [tuple(v.item() if isinstance(v, np.generic) else v for v in r) for r in rows]


def dense_m2ll(rows, su, st, s):
    """-2 log likelihood of the fixed effects' best fit, from the whole covariance matrix."""
    y = np.array([r[3] for r in rows])
    x = np.array([[1.0, r[4], r[5]] for r in rows])
    unit, level = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    cov = s**2 * np.eye(len(y)) + su**2 * (unit[:, None] == unit) + st**2 * (level[:, None] == level)
    inverse = np.linalg.inv(cov)
    c = np.linalg.inv(x.T @ inverse @ x)
    beta = c @ x.T @ inverse @ y
    r = y - x @ beta
    return len(y) * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1] + r @ inverse @ r, beta, c


@pytest.fixture(scope="module")
def frame(spark):
    rows = simulated(np.random.default_rng(1))
    schema = "season string, grid long, year long, y double, x1 double, x2 double"
    more = [("a", None, 2000, 1.0, None, 1.0), *(("b", *r[1:]) for r in simulated(np.random.default_rng(2), 30))]
    return rows, spark.createDataFrame(rows + more, schema)


def test_gaussian_equals_dense_likelihood(frame):
    rows, df = frame
    fit = M.gaussian(df, "season", "grid", "year", ["x1", "x2"], "y")[0]
    m2ll, beta, cov = dense_m2ll(rows, fit.sd_unit, fit.sd_level, fit.scale)
    assert fit.valid and fit.rows == len(rows) and fit.units == len({r[1] for r in rows})
    assert -2 * fit.loglik == pytest.approx(m2ll, rel=1e-9)
    assert fit.estimate == pytest.approx(beta, rel=1e-7) and fit.covariance == pytest.approx(cov, rel=1e-6)
    for su, st, s in ((1.02, 1, 1), (0.98, 1, 1), (1, 1.03, 1), (1, 0.97, 1), (1, 1, 1.02), (1, 1, 0.98)):
        assert dense_m2ll(rows, fit.sd_unit * su, fit.sd_level * st, fit.scale * s)[0] > m2ll
    assert abs(fit.estimate[1] - 0.8) < 0.1 and abs(fit.sd_unit - 0.7) < 0.15 and abs(fit.scale - 0.5) < 0.05


def test_unit_effects_shrink(frame):
    rows, df = frame
    fit = M.gaussian(df, "season", "grid", "year", ["x1", "x2"], "y")[0]
    got = {r["unit"]: r["effect"] for r in M.unit_effects(df, fit, "season", "grid", "year", ["x1", "x2"], "y").collect()}
    shift = dict(zip(fit.levels, fit.level_effects, strict=True))
    own = [r[3] - fit.estimate @ [1, r[4], r[5]] - shift[r[2]] for r in rows if r[1] == 5]
    k = (fit.sd_unit / fit.scale) ** 2
    assert got[5] == pytest.approx(k * sum(own) / (1 + k * len(own)), rel=1e-6)


def test_lgamma_and_density():
    x = np.array([0.01, 0.3, 1, 2.5, 40, 1e4])
    assert M.lgamma(x) == pytest.approx([math.lgamma(v) for v in x], abs=1e-10, rel=1e-10)
    y = np.concatenate([[0.0], np.exp(np.linspace(-90, 6, 60_001))])
    for mean, phi, power in ((1.0, 1.0, 1.5), (2.0, 0.4, 1.2), (0.5, 2.0, 1.8)):
        f = np.exp(M.tweedie_log_density(y, np.full(len(y), mean), phi, power))
        whole = f[0] + np.trapezoid(f[1:], y[1:])
        first = np.trapezoid(f[1:] * y[1:], y[1:])
        spread = np.trapezoid(f[1:] * y[1:] ** 2, y[1:]) - first**2
        assert (whole, first, spread) == pytest.approx((1, mean, phi * mean**power), rel=2e-3)


def tweedie_rows(rng, units, levels):
    rows, u, v = [], rng.normal(0, 0.6, units), rng.normal(0, 0.3, levels)
    for g in range(units):
        for t in range(levels):
            x, e = rng.normal(), rng.uniform(1, 3)
            mean = e * math.exp(0.3 + 0.5 * x + u[g] + v[t])
            jumps = rng.poisson(mean**0.5 / (0.8 * 0.5))  # power 1.5, phi 0.8
            y = rng.gamma(jumps, 0.8 * 0.5 * mean**0.5) if jumps else 0.0
            rows.append(("a", g, t, y, x, math.log(e)))
    return plain(rows)


def test_tweedie_recovers_its_parameters(spark):
    rows = tweedie_rows(np.random.default_rng(4), 250, 6)
    df = spark.createDataFrame(rows, "season string, grid long, year long, y double, x double, off double")
    fit = M.tweedie(df, "season", "grid", "year", ["x"], "y", "off")[0]
    assert fit.valid and fit.rows == len(rows) and fit.units == 250
    assert abs(fit.estimate[1] - 0.5) < 4 * fit.covariance[1, 1] ** 0.5 and fit.covariance[1, 1] ** 0.5 < 0.06
    assert abs(fit.power - 1.5) < 0.06 and abs(fit.scale - 0.8) < 0.1 and abs(fit.sd_unit - 0.6) < 0.12 and 0.05 < fit.sd_level < 0.7
    table = M.fixed_table(spark, [fit]).where(F.col("term") == "x").first()
    assert table["valid"] and table["low"] < 0.5 < table["high"] and table["p"] < 1e-6


def test_tweedie_laplace_value(spark):
    """The likelihood at the fit against Laplace's approximation from all random effects at once."""
    rows = tweedie_rows(np.random.default_rng(6), 40, 5)
    df = spark.createDataFrame(rows, "season string, grid long, year long, y double, x double, off double")
    fit = M.tweedie(df, "season", "grid", "year", ["x"], "y", "off")[0]
    y, x, off = (np.array([r[i] for r in rows]) for i in (3, 4, 5))
    z = np.zeros((len(rows), 45))
    for i, r in enumerate(rows):
        z[i, r[1]] = z[i, 40 + r[2]] = 1
    prior = np.r_[np.full(40, fit.sd_unit**-2), np.full(5, fit.sd_level**-2)]

    def value(beta):
        b = np.zeros(45)
        for _ in range(100):
            mean = np.exp(off + beta[0] + beta[1] * x + z @ b)
            slope = z.T @ ((y * mean ** (1 - fit.power) - mean ** (2 - fit.power)) / fit.scale) - prior * b
            w = ((2 - fit.power) * mean ** (2 - fit.power) + (fit.power - 1) * y * mean ** (1 - fit.power)) / fit.scale
            hess = z.T @ (w[:, None] * z) + np.diag(prior)
            b = b + np.linalg.solve(hess, slope)
        return M.tweedie_log_density(y, mean, fit.scale, fit.power).sum() - b @ (prior * b) / 2 + np.log(prior).sum() / 2 - np.linalg.slogdet(hess)[1] / 2

    assert fit.loglik == pytest.approx(value(fit.estimate), abs=1e-5)
    for e in ([0.02, 0], [-0.02, 0], [0, 0.02], [0, -0.02]):
        assert value(fit.estimate + np.array(e)) < fit.loglik
