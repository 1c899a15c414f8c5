"""The cyclic spline against dense algebra, and keyed bijections."""

import numpy as np
import pytest

from gridloom.operators import shuffles, smooth


def test_basis_is_periodic_smooth_and_interpolates():
    rng = np.random.default_rng(1)
    values, knots = rng.normal(size=12), 1 + 366 / 12 * np.arange(12)
    assert smooth.basis(knots, 366, 12) @ values == pytest.approx(values)
    f = lambda t: smooth.basis(np.asarray(t, float), 366, 12) @ values
    assert f([1, 100.5]) == pytest.approx(f([367, 466.5]))
    h = 1e-3
    for k in knots:  # value, slope and second derivative agree from both sides
        left, right = f(k - h * np.arange(4)), f(k + h * np.arange(4))
        assert (left[0] - left[1]) / h == pytest.approx((right[1] - right[0]) / h, abs=1e-3)
        assert (left[0] - 2 * left[1] + left[2]) / h**2 == pytest.approx((right[0] - 2 * right[1] + right[2]) / h**2, abs=1e-3)
    second, penalty = smooth._second(366, 12)
    t = np.linspace(1, 367, 200_001)
    bend = np.gradient(np.gradient(f(t), t), t)
    assert values @ penalty @ values == pytest.approx(np.trapezoid(bend**2, t), rel=1e-3)
    assert np.abs(penalty @ np.ones(12)).max() < 1e-12


def test_spline_finds_a_curve_and_its_weight(spark):
    rng = np.random.default_rng(2)
    t = np.arange(1, 367)
    true = np.sin(2 * np.pi * t / 366) + 0.5 * np.cos(4 * np.pi * t / 366)
    rows = [(int(a), float(b)) for a, b in zip(t, true + rng.normal(0, 0.3, 366), strict=True)]
    df = spark.createDataFrame([*rows, (None, 1.0), (5, None)], "d int, v double")
    own = smooth.fit_spline(df, "d", "v", 366)
    curve, error = own.at(t)
    assert np.abs(curve - true).max() < 0.2 and 0.2**2 < own.scale < 0.4**2 and 4 < own.edf < 25
    assert np.mean(np.abs(curve - true) < 2 * error) > 0.8
    b, y = smooth.basis(t, 366, 30), np.array([r[1] for r in rows])
    _, penalty = smooth._second(366, 30)

    def restricted(weight):
        beta = np.linalg.solve(b.T @ b + weight * penalty, b.T @ y)
        scale = (((y - b @ beta) ** 2).sum() + weight * beta @ penalty @ beta) / 365
        whole = np.linalg.slogdet(b.T @ b + weight * penalty)[1] - np.log(weight * np.sort(np.linalg.eigvalsh(penalty))[1:]).sum()
        return 365 * (np.log(2 * np.pi * scale) + 1) + whole

    assert own.restricted == pytest.approx(restricted(own.weight), rel=1e-9)
    assert all(restricted(own.weight * k) > own.restricted for k in (0.8, 1.25))
    out = smooth.cyclic_spline(df.where("d is not null"), "d", "v", 366)
    assert out.count() == 367 and out.where("d = 5").select("smooth").distinct().count() == 1
    with pytest.raises(ValueError):
        smooth.fit_spline(df.where("d < 3"), "d", "v", 366)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 97, 1000, 65_537])
def test_bijections(n):
    seen = {tuple(shuffles.bijection(np.arange(n), n, k)[:20]) for k in range(20)}
    for k in range(3):
        assert np.array_equal(np.sort(shuffles.bijection(np.arange(n), n, k)), np.arange(n))
    assert len(seen) == 20 or n < 20


def test_permutations_are_even_and_dealt_once(spark):
    counts = np.zeros((5, 5))
    for k in range(4000):
        counts[np.arange(5), shuffles.bijection(np.arange(5), 5, k)] += 1
    assert np.abs(counts / 4000 - 0.2).max() < 0.04
    df = spark.createDataFrame([(i, float(i * i)) for i in range(50)], "i long, v double")
    rows = shuffles.dealt(df, "i", "v", 50, 7, batch=4).collect()
    assert len(rows) == 100 and {len(r["zs"]) for r in rows} == {4, 3}
    for part, width in ((0, 4), (1, 3)):
        for d in range(width):
            assert sorted(r["zs"][d] for r in rows if r["part"] == part) == [float(i * i) for i in range(50)]
    assert sorted(r["i"] for r in shuffles.sent(df, "i", 50, 3).collect()) == list(range(50))
