"""Nearest neighbours against brute force where points are dense, coincide, lie on lines or are few."""

import numpy as np
import pytest

from gridloom.operators import spatial as X


def _brute(data, k):
    out = {}
    for i, x, y in data:
        near = sorted((float(np.sqrt((x - a) * (x - a) + (y - b) * (y - b))), j) for j, a, b in data if j != i)[:k]
        out[i] = [(j, d) for d, j in near]
    return out


def _points(kind):
    rng = np.random.default_rng(11)
    if kind == "even":
        xy = rng.random((150, 2))
    elif kind == "ten places":
        xy = rng.random((10, 2))[rng.integers(0, 10, 300)]
    elif kind == "dense":  # a cluster a millionth as wide as the box, a tighter one in it, and a few far away
        xy = np.concatenate([rng.random((80, 2)) * 1e-6, rng.random((60, 2)) * 1e-10 + 5e-7, rng.random((12, 2)) * 1.0, [[1.0, 1.0], [-1.0, 1.0]]])
    elif kind == "line":
        xy = np.column_stack([np.arange(60) // 2, np.full(60, 3.0)])
    elif kind == "one place":
        xy = np.full((40, 2), -0.0)
    else:
        xy = rng.random((3, 2))
    return [(int(i), float(x), float(y)) for i, (x, y) in zip(rng.permutation(len(xy)), xy, strict=True)]


@pytest.mark.parametrize("kind", ["even", "ten places", "dense", "line", "one place", "few"])
def test_equal_brute_force(spark, kind):
    data = _points(kind)
    rows = X.nearest(spark.createDataFrame([*data, (9999, None, 1.0)], "grid_uid int, x double, y double"), 5).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["source"], r["rank"])):
        got.setdefault(r["source"], []).append((r["neighbour"], r["distance"]))
    assert got == _brute(data, 5)
    assert sorted({r["rank"] for r in rows}) == list(range(1, min(5, len(data) - 1) + 1))


def test_no_points(spark):
    df = spark.createDataFrame([], "grid_uid int, x double, y double")
    assert X.nearest(df, 3).columns == ["source", "neighbour", "rank", "distance"] and not X.nearest(df, 3).count()
