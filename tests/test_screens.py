"""Screens: the sweep operator against inverses, the screen against a plain loop, candidates on common rows, ranks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import screens as V


def _correlation(seed, p=6, n=80):
    x = np.random.default_rng(seed).normal(size=(n, p))
    x[:, 1] += 2 * x[:, 0]
    return np.corrcoef(x, rowvar=False)


def test_sweeps_equal_inverses():
    r = _correlation(1)
    s = V.Swept(r)
    for k in (0, 3, 1, 5):
        s.pivot(k)
    s.pivot(3)
    inside = [0, 1, 5]
    want = np.diag(np.linalg.inv(r[np.ix_(inside, inside)]))
    assert [s.vif()[k] for k in inside] == pytest.approx(list(want))
    assert s.condition() == pytest.approx(np.linalg.cond(r[np.ix_(inside, inside)]))
    assert s.unexplained(2) == pytest.approx(1 - r[2, inside] @ np.linalg.solve(r[np.ix_(inside, inside)], r[inside, 2]))
    for k in inside:
        s.pivot(k)
    assert np.allclose(s.now, r)


def test_matrices_equal_pandas(spark):
    rng = np.random.default_rng(5)
    data = [(g, float(a), float(round(b, 1)), float(a * a)) for g in ("s", "t") for a, b in rng.normal(size=(60, 2))] + [("s", None, 1.0, 1.0)]
    df = spark.createDataFrame(data, "g string, a double, b double, c double")
    found, frame = V.matrices(df, ["a", "b", "c"], "g"), df.toPandas().dropna()
    for g in ("s", "t"):
        own = frame[frame.g == g][["a", "b", "c"]]
        assert found[g].rows == 60
        assert np.allclose(found[g].pearson, own.corr()) and np.allclose(found[g].spearman, own.corr("spearman"))
    with pytest.raises(ValueError, match="constant"):
        V.matrices(df.withColumn("b", F.lit(2.0)), ["a", "b"], "g")


def _plain(found, columns, names, limits):
    """Dropping by inverses, without domains and priorities."""
    names = list(names)
    while True:
        at = [columns.index(n) for n in names]
        vif = {n: max(np.diag(np.linalg.inv(m.pearson[np.ix_(at, at)]))[i] for m in found.values()) for i, n in enumerate(names)}
        rho = {(a, b): max(abs(m.spearman[columns.index(a), columns.index(b)]) for m in found.values()) for i, a in enumerate(names) for b in names[i + 1 :]}
        condition = max(np.linalg.cond(m.pearson[np.ix_(at, at)]) for m in found.values())
        worst = set()
        for m in found.values():
            pair = max(((abs(m.spearman[columns.index(a), columns.index(b)]), a, b) for a, b in rho), key=lambda t: t[0])
            worst |= set(pair[1:]) if pair[0] > limits.rho else set()
        if not worst and max(vif.values()) > limits.vif:
            worst = {max(vif, key=vif.get)}
        if not worst and condition <= limits.condition:
            return names
        close = {n: np.mean([abs(m.spearman[columns.index(n), columns.index(o)]) for m in found.values() for o in names if o != n]) for n in names}
        names.remove(min(worst or names, key=lambda n: (-vif[n], -close[n], n)))


@pytest.mark.parametrize("seed", range(6))
def test_repair_equals_a_plain_loop(seed):
    rng = np.random.default_rng(seed)
    columns = [f"v{i}" for i in range(8)]
    found = {}
    for g in ("a", "b", "c"):
        x = rng.normal(size=(100, 8))
        x[:, 1] = x[:, 0] + rng.normal(size=100) * 0.2
        x[:, 4] = x[:, 2] + x[:, 3] + x[:, 5] + rng.normal(size=100) * 0.3
        ranks = x.argsort(0).argsort(0)
        found[g] = V.Matrices(np.corrcoef(x, rowvar=False), np.corrcoef(ranks, rowvar=False), 100)
    limits = V.Limits()
    got = V.Screen(found, columns, limits).repair(columns)
    assert got == _plain(found, columns, columns, limits) and len(got) < 8


def test_exact_ties_domains_and_adding():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 4))
    x = np.column_stack([x, x[:, 0] + x[:, 1] + x[:, 2]])
    m = V.Matrices(np.corrcoef(x, rowvar=False), np.corrcoef(x.argsort(0).argsort(0), rowvar=False), 200)
    columns = ["a", "b", "c", "d", "sum"]
    s = V.Screen({"g": m}, columns, V.Limits())
    assert {k for k, v in s.measured(columns)["vif"].items() if math.isinf(v)} == {"a", "b", "c", "sum"}
    kept = V.Screen({"g": m}, columns, V.Limits(), domain={"sum": "s"}, minimum={"s": 1}).repair(columns)
    assert "sum" in kept and len(kept) == 4
    s = V.Screen({"g": m}, columns, V.Limits())
    assert s.extend(["a", "b", "c"], ["sum", "d"]) == ["a", "b", "c", "d"]
    assert [(h.variable, h.accepted) for h in s.history] == [("sum", False), ("d", True)]
    with pytest.raises(ValueError, match="domain"):
        V.Screen({"g": m}, columns, V.Limits(), domain=dict.fromkeys(columns, "s"), minimum={"s": 5}).repair(columns)


def test_candidates_and_ranks(spark):
    assert V.without_blocks(["a", "b"], {"x": ["a"], "all": ["a", "b"]}) == {"full": ["a", "b"], "without_x": ["b"]}
    with pytest.raises(ValueError, match="blocks"):
        V.without_blocks(["a"], {"x": ["q"]})
    data = [("u", "full", 2, 1.0), ("u", "less", 1, 1.00005), ("u", "worse", 1, 2.0), ("u", "wild", 1, float("nan")), ("v", "full", 2, None)]
    got = {(r["g"], r["candidate"]): r for r in V.ranked(spark.createDataFrame(data, "g string, candidate string, n_features int, l double"), ["g"], F.col("l")).collect()}
    assert [got["u", c]["rank"] for c in ("less", "full", "worse", "wild")] == [1, 2, 3, 4]
    assert got["u", "less"]["equivalent"] and not got["u", "wild"]["stable"] and not got["v", "full"]["equivalent"]


def test_out_of_fold_chances_equal_newton(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-0.5 - x[:, 0]))).astype(int)
    fold = np.arange(400) % 2
    df = spark.createDataFrame([("s", int(f), int(b), 1.0, float(a[0]), float(a[1])) for f, b, a in zip(fold, y, x, strict=True)] + [("s", 0, 1, 1.0, 0.5, None)], "k string, fold int, y int, e double, a double, b double")
    got = V.screened(df, "occurrence", {"full": ["a", "b"], "one": ["a"]}, "y", "e", ["k"], "fold").groupBy("candidate").agg(F.count("*").alias("n"), F.avg("log_p").alias("l")).collect()
    got = {r["candidate"]: r for r in got}
    assert got["full"]["n"] == got["one"]["n"] == 400
    for name, columns in (("full", [0, 1]), ("one", [0])):
        total = 0.0
        for held in (0, 1):
            d, t = np.column_stack([np.ones(400), x[:, columns]]), np.zeros(len(columns) + 1)
            fit = fold != held
            for _ in range(30):
                p = 1 / (1 + np.exp(-d[fit] @ t))
                t += np.linalg.solve((d[fit] * (p * (1 - p))[:, None]).T @ d[fit], d[fit].T @ (y[fit] - p))
            p = 1 / (1 + np.exp(-d[~fit] @ t))
            total += np.log(np.where(y[~fit] > 0, p, 1 - p)).sum()
        assert got[name]["l"] == pytest.approx(total / 400, abs=1e-7)
