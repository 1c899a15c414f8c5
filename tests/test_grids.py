"""Grids: metrics against numpy on given predictions, rank sums with ties and NULL, winners, refusals."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators import grids as G

A = [G.Config("a"), G.Config("b", 20, "0.5", balanced=True)]
B = [G.Config("s"), G.Config("t", 3, "all", 0.8)]


def test_metrics_equal_numpy(spark):
    rng = np.random.default_rng(4)
    y, p, s, fold = rng.poisson(0.8, 90).astype(float), rng.random((90, 2)).round(1), rng.random((90, 2)) + 1, np.arange(90) % 2
    df = spark.createDataFrame([(int(f), float(a), [float(v) for v in b], [float(v) for v in c]) for f, a, b, c in zip(fold, y, p, s, strict=True)], "k int, y double, p array<double>, severity array<double>")
    got = {(r["stage"], r["config"], r["fold"], r["metric"]): r["value"] for r in G.grid_metrics(df, "y", "k", A, B).collect()}
    assert len(got) == 2 * (2 * 5 + 2 * 4 + 4 * 7)
    m = fold == 1
    yes = y[m] > 0
    assert got["occurrence", "b", "1", "brier"] == pytest.approx(((p[m, 1] - yes) ** 2).mean())
    won = [(a > b) + 0.5 * (a == b) for a in p[m, 1][yes] for b in p[m, 1][~yes]]
    assert got["occurrence", "b", "1", "auc"] == pytest.approx(np.mean(won))
    assert got["severity", "s", "1", "mae"] == pytest.approx(np.abs(s[m, 0] - y[m])[yes].mean())
    e = p[m, 0] * s[m, 1]
    assert got["expected", "a x t", "1", "r2"] == pytest.approx(1 - ((e - y[m]) ** 2).mean() / y[m].var())
    assert got["expected", "a x t", "1", "spearman"] == pytest.approx(pd.Series(e).rank().corr(pd.Series(y[m]).rank()))


def test_rank_sums_and_winners(spark):
    data = [("rmse", "a", 1.0), ("rmse", "b", 1.0), ("rmse", "c", 2.0), ("auc", "a", 0.7), ("auc", "b", 0.9), ("auc", "c", None)]
    long = spark.createDataFrame(data, "metric string, m string, v double").withColumn("g", F.lit(1))
    got = {r["m"]: (r["rank_sum"], r["position"]) for r in G.rank_sums(long, ["g"], "m", "metric", "v").collect()}
    assert got == {"a": (3.5, 2), "b": (2.5, 1), "c": (6.0, 3)}
    same = [(s, c, f, "mae", 1.0) for s, cs in (("occurrence", "ab"), ("severity", "st")) for c in cs for f in "01"] + [("expected", f"{a} x {b}", "0", "mae", 2.0 if (a, b) != ("b", "t") else 1.0) for a in "ab" for b in "st"]
    out = G.winners(spark.createDataFrame(same, "stage string, config string, fold string, metric string, value double"), A, B).where("winner").collect()
    assert {(r["stage"], r["config"]) for r in out} == {("occurrence", "a"), ("severity", "s"), ("expected", "b x t")}


def test_predictions_are_out_of_fold(spark):
    rng = np.random.default_rng(8)
    x = rng.random(300)
    y = np.where(x > 0.5, np.ceil(10 * x), 0)
    df = spark.createDataFrame([(i, i % 2, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [(300, 0, None, 1.0)], "id int, k int, x double, y double")
    rows = G.grid_predictions(df, ["x"], "y", "k", A, B, trees=5, depth=4).collect()
    assert len(rows) == 300 and all(len(r["p"]) == len(r["severity"]) == 2 for r in rows)
    assert np.mean([(r["p"][0] > 0.5) == (r["y"] > 0) for r in rows]) > 0.95
    # a fold's own rows do not matter to it: swapped labels in fold 0 leave its predictions as they were
    other = G.grid_predictions(df.withColumn("y", F.when(F.col("k") == 0, 10 - F.col("y")).otherwise(F.col("y"))), ["x"], "y", "k", A[:1], B[:1], trees=5, depth=4).where("k = 0").collect()
    mine = {r["id"]: (r["p"][0], r["severity"][0]) for r in rows}
    assert all(mine[r["id"]] == pytest.approx((r["p"][0], r["severity"][0])) for r in other)
    with pytest.raises(ValueError, match="names"):
        G.grid_predictions(df, ["x"], "y", "k", [A[0], A[0]], B)
    with pytest.raises(ValueError, match="too few"):
        G.grid_predictions(df, ["x"], "y", "k", A, B, least_positives=1000)
    with pytest.raises(ValueError, match="two folds"):
        G.grid_predictions(df.where("k = 5"), ["x"], "y", "k", A, B)
