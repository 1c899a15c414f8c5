"""Count regressions against likelihoods written out in Python, and on simulated rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import count_fits, counts


def nb1(y, m, a):
    r = m / a
    return math.lgamma(y + r) - math.lgamma(r) - math.lgamma(y + 1) - r * math.log1p(a) + y * (math.log(a) - math.log1p(a))


def nb2(y, m, a):
    r = 1 / a
    return math.lgamma(y + r) - math.lgamma(r) - math.lgamma(y + 1) - r * math.log1p(a * m) + y * math.log(a * m / (1 + a * m))


def likelihood(family, theta, rows):
    out = 0.0
    for y, e, x in rows:
        m, a = e * math.exp(theta[0] + theta[1] * x), math.exp(theta[2])
        one = nb2 if family == "nb2" else nb1
        if family == "ztnb1":
            out += one(y, m, a) - math.log(1 - math.exp(one(0, m, a)))
        elif family == "zinb1":
            pi = 1 / (1 + math.exp(-theta[3] - theta[4] * x))
            out += math.log(pi + (1 - pi) * math.exp(one(0, m, a))) if y == 0 else math.log(1 - pi) + one(y, m, a)
        else:
            out += one(y, m, a)
    return out


def simulated(n=1500, zero=0.0):
    rng = np.random.default_rng(4)
    x, e = rng.normal(size=n), rng.uniform(5, 20, n)
    m = e * np.exp(-1.5 + 0.6 * x)
    y = rng.poisson(rng.gamma(m / 0.8, 0.8))
    y[rng.random(n) < zero] = 0
    return [(int(a), float(b), float(c)) for a, b, c in zip(y, e, x, strict=True)]


@pytest.mark.parametrize("family", ["nb1", "nb2", "ztnb1", "zinb1"])
def test_scores_are_the_likelihoods_derivatives(spark, family):
    rows = [r for r in simulated(60) if r[0] or family != "ztnb1"]
    df = spark.createDataFrame(rows, "y int, e double, x double")
    theta = np.array([-1.2, 0.4, -0.3, -0.7, 0.5][: 5 if family == "zinb1" else 3])
    own = counts.prepared(df, ["x"], "y", "e", family == "ztnb1")
    value, gradient, _, n = counts._sums(counts.scores(own, family, ["x"], ["x"], theta), len(theta))
    assert n == len(rows) and value == pytest.approx(likelihood(family, theta, rows), rel=1e-8)
    for k in range(len(theta)):
        step = np.zeros(len(theta))
        step[k] = 1e-5
        slope = (likelihood(family, theta + step, rows) - likelihood(family, theta - step, rows)) / 2e-5
        assert gradient[k] == pytest.approx(slope, rel=1e-4, abs=1e-4)


def test_fits_find_the_parameters(spark):
    df = spark.createDataFrame(simulated(), "y int, e double, x double")
    model = counts.fit(df, "nb1", ["x"], "y", "e")
    assert model.gradient < 1e-3
    assert np.abs((model.estimate - [-1.5, 0.6, math.log(0.8)]) / np.sqrt(np.diag(model.covariance))).max() < 3.5
    cut = counts.fit(df, "ztnb1", ["x"], "y", "e")
    assert np.abs((cut.estimate - [-1.5, 0.6, math.log(0.8)]) / np.sqrt(np.diag(cut.covariance))).max() < 3.5
    table = {r["term"]: r for r in counts.wald_table(spark, model).collect()}
    assert table["x"]["low"] < 0.6 < table["x"]["high"] and table["x"]["p"] < 1e-6
    with pytest.raises(ValueError):
        counts.fit(df.where("y = 0"), "nb1", ["x"], "y", "e")


def test_zero_inflation_and_two_way_clusters(spark):
    rows = simulated(zero=0.3)
    df = spark.createDataFrame([(*r, k % 50, k % 7) for k, r in enumerate(rows)], "y int, e double, x double, g int, t int")
    model, plain = counts.fit(df, "zinb1", ["x"], "y", "e"), counts.fit(df, "nb1", ["x"], "y", "e")
    assert model.loglik > plain.loglik + 10
    assert 1 / (1 + math.exp(-model.estimate[-1])) == pytest.approx(0.3, abs=0.08)
    v, found = counts.two_way_covariance(df, plain, ["x"], "y", "e", "g", "t")
    assert found == {"g": 50, "t": 7, "both": 350, "clipped": 0} or found["clipped"] > 0
    # the same sums in numpy
    own = counts.scores(df.select("g", "t", F.col("y").cast("double").alias("_y"), F.ln("e").alias("_off"), "x"), "nb1", ["x"], [], plain.estimate).toPandas()
    s, n = own[["_s0", "_s1", "_s2"]], len(rows)
    meat = 0
    for keys, sign in ((["g"], 1), (["t"], 1), (["g", "t"], -1)):
        c = own.groupby(keys)[list(s)].sum().to_numpy()
        meat = meat + sign * c.T @ c * len(c) / (len(c) - 1) * (n - 1) / (n - 3)
    values, vectors = np.linalg.eigh(plain.covariance @ meat @ plain.covariance)
    assert np.allclose(v, (vectors * np.maximum(values, 0)) @ vectors.T)
    table = counts.wald_table(spark, plain, v, 6).where("term = 'x'").first()
    assert table["high"] - table["estimate"] == pytest.approx(2.446912 * table["se"], rel=1e-6) and table["ratio"] == pytest.approx(math.exp(table["estimate"]))


@pytest.mark.parametrize("family", ["nb1", "nb2", "ztnb1", "zinb1", "occurrence"])
def test_slopes_and_information_are_the_likelihoods_derivatives(family):
    rows = [r for r in simulated(80) if r[0] or family != "ztnb1"]
    y, e, x = (np.array([r[i] for r in rows], float) for i in range(3))
    design = np.stack([np.ones(len(x)), x], 1)
    theta = np.array({"zinb1": [-1.2, 0.4, -0.3, -0.7, 0.5], "occurrence": [0.4, 0.8]}.get(family, [-1.2, 0.4, -0.3]))
    at = lambda t: count_fits.sums(family, y, np.log(e), design, design, t)
    n, own = len(theta), at(theta)
    if family != "occurrence":
        assert own[0] == pytest.approx(likelihood(family, theta, rows), rel=1e-9)
    for k in range(n):
        step = np.zeros(n)
        step[k] = 1e-5
        up, down = at(theta + step), at(theta - step)
        assert own[1 + k] == pytest.approx((up[0] - down[0]) / 2e-5, rel=1e-5, abs=1e-5)
        assert own[1 + n : -1].reshape(n, n)[k] == pytest.approx((up[1 : 1 + n] - down[1 : 1 + n]) / 2e-5, rel=1e-5, abs=1e-5)


def test_many_fits_at_once_equal_fits_of_their_own_rows(spark):
    rows = [(*r, "ab"[k % 2], k % 3) for k, r in enumerate(simulated(600))]
    df = spark.createDataFrame(rows, "y int, e double, x double, s string, f long")
    many = count_fits.fit_many(df, "nb1", ["x"], "y", "e", ["s"], "f")
    assert [(m.key, m.fold) for m in many] == [(s, f) for s in "ab" for f in range(3)] and all(m.settled and m.identified and m.agreeing == m.starts == 3 for m in many)
    one = counts.fit(df.where("s = 'b' and f <> 1"), "nb1", ["x"], "y", "e")
    assert many[4].estimate == pytest.approx(one.estimate, abs=1e-6) and many[4].covariance == pytest.approx(one.covariance, rel=1e-4) and many[4].rows == one.rows
    flat = count_fits.fit_many(df.withColumn("x2", F.col("x") * 2), "nb1", ["x", "x2"], "y", "e")[0]
    assert flat.rank == 3 and not flat.identified


def test_hurdle_out_of_fold(spark):
    rows = [(*r, k % 3) for k, r in enumerate(simulated(600, zero=0.3))]
    df = spark.createDataFrame(rows, "y int, e double, x double, f long")
    got = counts.out_of_fold(df, "hurdle", ["x"], "y", "e", [], "f").where("f = 1").collect()
    yes = count_fits.fit_many(df, "occurrence", ["x"], "y", "e", fold="f")[1].estimate
    b = count_fits.fit_many(df, "ztnb1", ["x"], "y", "e", fold="f")[1].estimate
    assert len(got) == 200
    for r in got[:20]:
        p = 1 / (1 + math.exp(-yes[0] - yes[1] * r["x"]))
        m, a = r["e"] * math.exp(b[0] + b[1] * r["x"]), math.exp(b[2])
        some = 1 - math.exp(nb1(0, m, a))
        assert (r["positive"], r["expected"]) == (pytest.approx(p), pytest.approx(p * m / some))
        assert r["log_p"] == pytest.approx(math.log(1 - p) if r["y"] == 0 else math.log(p) + nb1(r["y"], m, a) - math.log(some))
    scores = {f: -counts.out_of_fold(df, f, ["x"], "y", "e", [], "f").agg(F.avg("log_p")).first()[0] for f in ("nb1", "zinb1")}
    assert scores["zinb1"] < scores["nb1"]
