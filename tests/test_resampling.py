"""Exact multinomial resampling: totals, agreement of parts, moments, twelve metrics, odd input."""

import numpy as np
import pytest

from gridloom.operators import resampling as R


def test_parts_of_a_stratum_agree_with_the_whole():
    size, draws = 1000, 300
    whole = np.zeros((draws, size), int)
    for a, b, counts in R.multiplicities(7, "s", size, np.arange(size), 0, draws):
        whole[:, a:b] = counts
    assert (whole.sum(1) == size).all()
    for numbers in (np.arange(0, size, 7), np.array([999]), np.arange(400, 470)):
        got = np.zeros((draws, len(numbers)), int)
        for a, b, counts in R.multiplicities(7, "s", size, numbers, 0, draws):
            got[:, a:b] = counts
        assert (got == whole[:, numbers]).all()
    # multinomial moments: mean 1, variance 1 - 1 / n, covariance -1 / n
    assert abs(whole.mean() - 1) < 1e-12
    assert abs(whole.var(0).mean() - 1) < 0.05
    assert len({tuple(w) for w in whole}) == draws


def test_totals_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    data = [(m, "a" if c < 150 else None, c, float(rng.normal()), 1.0) for c in range(200) for m in ("u", "v")]
    sums = spark.createDataFrame(data, "model string, land string, c long, x double, one double").repartition(7)
    got = {(r["model"], r["draw"]): (r["x"], r["one"]) for r in R.resampled(sums, ["model"], ["land"], "c", ["x", "one"], 40).collect()}
    assert len(got) == 80 and all(one == 200 for _, one in got.values())
    placed = {(r["stratum"], r["number"], r["key"]): r for r in R._numbered(sums, ["model"], ["land"], "c", ["x", "one"], 2026).collect()}
    want = np.zeros(40)
    for stratum, size in (('{"land":"a"}', 150), ("{}", 50)):
        for a, b, counts in R.multiplicities(2026, stratum, size, np.arange(size), 0, 40):
            want += counts @ np.array([placed[stratum, k, '{"model":"u"}']["x"] for k in range(a, b)])
    assert np.allclose([got["u", d][0] for d in range(1, 41)], want)


def test_members_share_draws_and_checks_hold(spark):
    sums = spark.range(130).selectExpr("id as c", "id % 2 as half", "1.0D as one").crossJoin(spark.createDataFrame([("u",), ("v",)], "model string"))
    drawn = R.resampled(sums.withColumn("x", sums["c"] * 1.0), ["model"], ["half"], "c", ["x"], 25).collect()
    by = {(r["model"], r["draw"]): r["x"] for r in drawn}
    assert all(by["u", d] == by["v", d] for d in range(1, 26)) and len({by["u", d] for d in range(1, 26)}) > 5
    checks = R.draw_checks(sums, ["half"], "c", 25).collect()
    assert len(checks) == 2 and all(r["clusters"] == r["least"] == r["greatest"] == 65 and r["draws"] == 25 and 30 < r["mean_different"] < 52 and r["most"] >= 2 for r in checks)


def test_odd_input(spark):
    empty = spark.createDataFrame([], "model string, land string, c long, x double")
    assert R.resampled(empty, ["model"], ["land"], "c", ["x"], 5).collect() == []
    assert R.draw_checks(empty, ["land"], "c", 5).collect() == []
    one = spark.createDataFrame([(None, None, None, None), ("u", "a", 1, 2.0)], "model string, land string, c long, x double")
    got = {r["model"]: r["x"] for r in R.resampled(one, ["model"], ["land"], "c", ["x"], 3).where("draw = 2").collect()}
    assert got == {None: 0.0, "u": 2.0}  # a stratum of one cluster draws it once


def test_metrics_of_a_hurdle(spark):
    df = spark.createDataFrame([(0, 1.0, 0.5, 2.0, 2.0), (4, 2.0, 0.5, 3.0, 2.0), (9, 9.0, 1.0, 9.0, 0.0)], "observed int, predicted double, p double, severity double, exposure double")
    m = R.hurdle_metrics(R.hurdle_sums(df, []), []).first()
    assert m["rate_rmse"] == pytest.approx(np.sqrt((0.25 + 1) / 2)) and m["count_mae"] == 1.5 and m["brier"] == 0.25
    assert m["positive_count_rmse"] == 1.0 and m["positive_rate_mae"] == 0.5 and m["count_abs_bias"] == 0.5 and m["chance_abs_bias"] == 0.0
    none = R.hurdle_metrics(R.hurdle_sums(df.where("observed = 0"), []), []).first()
    assert none["positive_count_rmse"] is None and none["count_rmse"] == 1.0
