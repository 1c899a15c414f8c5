"""Invariants and hand-computed values of operators."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalar as S
from gridloom.operators import association as A
from gridloom.operators import calendar as C
from gridloom.operators import metrics as M
from gridloom.operators import models as L
from gridloom.operators import panel as P
from gridloom.operators import spatial as X
from gridloom.operators import trend as T
from gridloom.sources import tables


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_special_functions(spark):
    for x in (-2.5, -0.3, 0.0, 0.7, 3.2):
        assert one(spark, S.erfc(F.lit(x)))[0] == pytest.approx(math.erfc(x), rel=2e-7)
    for x in (0.5, 1.0, 4.2, 30.0):
        assert one(spark, S.lgamma(F.lit(x)))[0] == pytest.approx(math.lgamma(x), abs=1e-9)
    assert one(spark, S.digamma(F.lit(1.0)))[0] == pytest.approx(-0.5772156649015329, abs=1e-9)
    assert one(spark, S.log1mexp(F.lit(0.1)))[0] == pytest.approx(math.log(-math.expm1(-0.1)))
    assert one(spark, S.logaddexp(F.lit(1.0), F.lit(2.0)))[0] == pytest.approx(math.log(math.e + math.e**2))


def test_guards_give_null(spark):
    r = one(spark, S.ratio(F.lit(1), F.lit(0)), S.clean(F.lit(float("nan"))), S.clean(F.lit(float("inf"))), S.log1p_guarded(F.lit(-2.0)), S.truth(F.lit("maybe")), S.geometric_mean(F.lit(-1.0), F.lit(2.0)))
    assert list(r) == [None] * 6


def test_text_seed_matches_hashlib(spark):
    import hashlib

    want = int.from_bytes(hashlib.sha256(b"a|b").digest()[:8], "little") % (2**32 - 1)
    assert one(spark, S.text_seed(F.lit("a"), F.lit("b")))[0] == want


def test_sen_and_kendall_by_hand(spark):
    df = spark.createDataFrame([("g", t, float(y)) for t, y in enumerate([1, 3, 2, 5, 5])], "k string, t int, y double")
    assert T.sen_slope(df, ["k"], "t", "y").first()["slope"] == pytest.approx(1.0)
    r = T.kendall(df, ["k"], "t", "y").first()
    assert r["s"] == 7 and r["tau_b"] == pytest.approx(7 / math.sqrt(10 * 9))


def test_step_up_keeps_null_and_order(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "id string, p double")
    q = {r["id"]: r["q"] for r in T.step_up(df, [], "p", ["id"]).collect()}
    assert q["d"] is None and q["a"] == pytest.approx(0.03) and q["b"] == q["c"] == pytest.approx(0.04)


def test_longest_runs(spark):
    df = spark.createDataFrame([("x", y, y not in (3, 6)) for y in range(1, 9)], "k string, y int, a boolean")
    r = T.longest_runs(df, ["k"], "y", F.col("a")).first()
    assert (r["longest"], r["runs"]) == (2, "1-2;4-5;7-8")


def test_nearest_is_exact(spark):
    import random

    rnd = random.Random(3)
    pts = [(i, rnd.random() ** 4, rnd.random()) for i in range(120)] + [(200, 50.0, 50.0)]
    got = {(r["source"], r["rank"]): r["neighbour"] for r in X.nearest(spark.createDataFrame(pts, "grid_uid long, x double, y double"), 4).collect()}
    for i, x, y in pts:
        near = sorted((math.sqrt((x - a) * (x - a) + (y - b) * (y - b)), j) for j, a, b in pts if j != i)[:4]
        assert [got[i, k] for k in (1, 2, 3, 4)] == [j for _, j in near]


def test_nearest_of_too_few_points(spark):
    assert X.nearest(spark.createDataFrame([(1, 0.0, 0.0)], "grid_uid long, x double, y double"), 3).count() == 0
    assert X.nearest(spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0)], "grid_uid long, x double, y double"), 3).count() == 2


def test_leap_days_and_windows(spark):
    assert one(spark, S.doy_date(F.lit(2004), F.lit(60)))[0] == datetime.date(2004, 2, 29)
    assert one(spark, S.doy_label(F.lit(366)))[0] == "Dec 31"
    w = spark.sql("SELECT 1 AS id, DATE'2004-02-10' AS start, DATE'2004-04-05' AS end")
    assert [r["days"] for r in C.months_of(w).orderBy("month").collect()] == [20, 31, 5]


def test_spearman_of_constant_is_null(spark):
    df = spark.createDataFrame([("g", float(i), 1.0) for i in range(6)], "k string, x double, y double")
    assert A.spearman(df, ["k"], "x", "y").first()["rho"] is None


def test_auc_of_ties_and_one_class(spark):
    df = spark.createDataFrame([("a", 0.5, 1), ("a", 0.5, 0), ("b", 0.1, 1)], "k string, p double, y int")
    got = {r["k"]: r["auc"] for r in M.roc_auc(df, ["k"], "p", F.col("y") > 0).collect()}
    assert got == {"a": 0.5, "b": None}


def test_bootstrap_shares_draws_between_members(spark):
    sums = spark.createDataFrame([(m, "s", c, 10, 1.0, 1.0, float(c), float(c), 5, 5.0) for m in ("a", "b") for c in range(20)], "model string, st string, c int, n long, nll double, brier double, se double, ae double, observed long, predicted double")
    d = M.cluster_bootstrap(sums, ["model"], ["st"], "c", 30).groupBy("draw").agg(F.count_distinct("rmse").alias("n"))
    assert d.agg(F.max("n")).first()[0] == 1


def test_signature_ignores_order(spark):
    a = spark.range(500).select("id", (F.col("id") * 2).alias("b"))
    assert P.content_signature(a).collect() == P.content_signature(a.orderBy(F.desc("id")).repartition(7)).collect()
    assert P.content_signature(a).first()["signature"] != P.content_signature(a.where("id > 0")).first()["signature"]


def test_expectations_raise(spark):
    df = spark.createDataFrame([(1, "a"), (1, "z")], "k int, c string")
    with pytest.raises(ValueError, match="c_in_domain, keys_unique"):
        P.require(P.expectations(df, ["k"], {"c": ["a"]}))


def test_poisson_rate_recovers(spark):
    df = spark.range(4000).select((F.col("id") % 2).cast("double").alias("x"), F.lit(10).alias("e"), F.when(F.col("id") % 2 == 0, F.when(F.col("id") % 4 == 0, 3).otherwise(1)).otherwise(F.when(F.col("id") % 4 == 1, 5).otherwise(3)).alias("y"))
    r = {x["term"]: x["estimate"] for x in L.poisson_rate(df, ["x"], "y", "e").collect()}
    assert r["x"] == pytest.approx(math.log(2), abs=1e-6)


def test_sources(spark, tmp_path):
    f = tmp_path / "s.csv"
    f.write_text("﻿Date,AO\n2001-01-01,1.5\nbad,2\n2001-02-01,-9999.000\n")
    got = tables.read_monthly(spark, str(f)).orderBy("month").collect()
    assert [r["value"] for r in got] == [1.5, None]
    assert tables.missing_columns(spark, str(f), ["Date", "PDO"]) == ["PDO"]
    assert tables.resolve_columns(["date", "AO"], {"d": ["Date"], "v": ["AO", "ao"]}) == {"d": "date", "v": "AO"}
    with pytest.raises(ValueError):
        tables.resolve_columns(["date", "DATE"], {"d": ["Date"]})
    out = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 2.0)], "k int, v double")
    tables.append_new(df, out, ["k"])
    with pytest.raises(ValueError):
        tables.append_new(df, out, ["k"])
    gz = str(tmp_path / "c")
    tables.write_csv(df, gz, compression="bzip2")
    assert tables.read_csv(spark, gz, "k int, v double", ["v"]).collect()[0]["v"] == 2.0
    assert tables.manifest(spark, str(tmp_path), "s.csv").first()["size_bytes"] == f.stat().st_size


def test_json_and_recovery(spark, tmp_path):
    own = spark.createDataFrame([(1, 2.5), (2, 3.5)], "k int, v double")
    tables.write_json(own.coalesce(1), f"{tmp_path}/j")
    assert tables.read_json(spark, f"{tmp_path}/j", "k int, v double").where("k = 1").first()["v"] == 2.5
    part = {"season": 1, "response": "fc"}
    _, was = tables.recovered(own, f"{tmp_path}/c", part, ["k"], 2)
    again, there = tables.recovered(own.withColumn("v", F.col("v") + 1), f"{tmp_path}/c", part, ["k"], 2)
    assert (was, there) == (False, True) and {r["v"] for r in again.collect()} == {2.5, 3.5}
    new, there = tables.recovered(own.limit(1), f"{tmp_path}/c", part, ["k"], 1)
    assert not there and new.count() == 1


def test_order_operators_are_exact(spark):
    import numpy as np

    from gridloom.operators import order

    rng = np.random.default_rng(3)
    rows = [(int(g), float(round(v, 1))) for g, v in zip(rng.integers(0, 3, 900), rng.exponential(3, 900), strict=True)]
    df = spark.createDataFrame(rows, "g int, x double")
    qs = [0.0, 0.05, 0.5, 0.77, 1.0]
    for r in order.exact_quantiles(df, ["g"], "x", qs).collect():
        own = [v for g, v in rows if g == r["g"]]
        assert r["n"] == len(own) and np.allclose(r["quantiles"], np.quantile(own, qs))
    counts = df.groupBy("g", "x").agg(F.count("*").alias("n"))
    for r in order.running_totals(counts, ["g"], "x", ["n"], ranges=7).collect():
        assert r["before_n"] == sum(g == r["g"] and v < r["x"] for g, v in rows)
    places = [r["i"] for r in order.numbered(df.withColumn("id", F.monotonically_increasing_id()), [], F.xxhash64("id"), ["id"], "i").collect()]
    assert sorted(places) == list(range(900))
    assert order.exact_quantiles(df.limit(0), [], "x", [0.5]).first()["n"] is None


def test_t_tail_and_components(spark):
    from gridloom.functions.scalar import t_two_sided
    from gridloom.operators import graph

    # two-sided tails from tables: t(1) = 12.7062, t(5) = 2.5706, t(10) = 2.2281, t(30) = 2.0423 at 0.05, normal at the limit
    got = spark.createDataFrame([(12.7062, 1), (2.5706, 5), (2.2281, 10), (2.0423, 30), (1.9600, 10**7), (4.3027, 2)], "t double, v long").select(t_two_sided(F.col("t"), F.col("v")).alias("p")).collect()
    assert all(abs(r["p"] - 0.05) < 2e-5 for r in got)
    edges = spark.createDataFrame([(k, k + 1) for k in range(30) if k % 10 != 9], "source long, neighbour long")
    labels = {r["node"]: r["component"] for r in graph.weak_components(edges).collect()}
    assert all(labels[k] == k - k % 10 for k in labels)


def test_exact_kendall_p_counts_all_orders(spark):
    from itertools import permutations

    for n in (3, 4, 6):
        every = [sum((b > a) - (b < a) for i, a in enumerate(o) for b in o[i + 1 :]) for o in permutations(range(n))]
        for s in sorted(set(every)):
            p = spark.range(1).select(T.exact_p(F.lit(n), F.lit(float(s))).alias("p")).first()["p"]
            assert abs(p - min(1.0, sum(abs(x) >= abs(s) for x in every) / len(every))) < 1e-12 or s == 0
