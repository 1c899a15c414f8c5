"""Attributions of forests against all subsets, and their summaries."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from gridloom.operators import forests as T
from gridloom.operators.models import assembled

X = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4)).round(1)
    y = np.where(x[:, 0] > 0, 2 * x[:, 1] + x[:, 2], x[:, 3]) + rng.normal(0, 0.3, 400)
    rows = [(i, i % 3, *map(float, r), float(max(v, 0))) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, fold int, a double, b double, c double, d double, y double")


def expectation(tree, x, known):
    """Mean prediction of a tree where only the known features decide, the others by the training rows' shares."""

    def go(n):
        at = tree[n]
        if at["left"] < 0:
            return at["value"]
        if at["feature"] in known:
            return go(at["left"] if x[at["feature"]] <= at["threshold"] else at["right"])
        return sum(tree[c]["cover"] / at["cover"] * go(c) for c in (at["left"], at["right"]))

    return go(0)


def all_subsets(trees, x, n):
    out = np.zeros(n)
    for j in range(n):
        rest = [k for k in range(n) if k != j]
        for size in range(n):
            w = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
            for known in itertools.combinations(rest, size):
                out[j] += w * sum(expectation(t, x, {*known, j}) - expectation(t, x, set(known)) for t in trees) / len(trees)
    return out


@pytest.mark.parametrize("kind", ["severity", "occurrence"])
def test_values_equal_all_subsets_and_add_up(frame, kind):
    own = assembled(frame.withColumn("o", (F.col("y") > 0.5).cast("double")), X)
    common = {"numTrees": 5, "maxDepth": 5, "seed": 1, "minInstancesPerNode": 3}
    model = (RandomForestRegressor(labelCol="y", **common) if kind == "severity" else RandomForestClassifier(labelCol="o", **common)).fit(own)
    table = {}
    for r in T.nodes(model).collect():
        table.setdefault(r["tree"], {})[r["node"]] = r
    trees = [table[k] for k in sorted(table)]
    forest = T.forest(model, 4)
    said = F.col("prediction") if kind == "severity" else F.get(vector_to_array("probability"), 1)
    expected = {r[0]: r[1] for r in model.transform(own).select("id", said).collect()}
    for method in ("shapley", "path"):
        rows = T.explained(frame, forest, X, ["id"], method).collect()
        assert len(rows) == 400
        for r in rows:
            assert abs(r["base"] + sum(r["phi"]) - expected[r["id"]]) < 1e-9 and abs(r["predicted"] - expected[r["id"]]) < 1e-9
        if method == "shapley":
            for r in rows[:6]:
                assert r["phi"] == pytest.approx(all_subsets(trees, r["x"], 4), abs=1e-10)


def test_path_values_follow_the_splits():
    tree = {0: {"value": 2.0, "cover": 10, "left": 1, "right": 2, "feature": 0, "threshold": 0.5}, 1: {"value": 1.0, "cover": 5, "left": -1, "right": -1}, 2: {"value": 3.0, "cover": 5, "left": 3, "right": 4, "feature": 1, "threshold": 0.0}, 3: {"value": 2.5, "cover": 2, "left": -1, "right": -1}, 4: {"value": 10 / 3, "cover": 3, "left": -1, "right": -1}}
    own = T.from_nodes([tree], 2)
    phi, predicted = T.attributions(np.array([[0.5, 9.0], [0.6, 0.0], [0.6, 0.1]]), own, "path")
    assert phi == pytest.approx(np.array([[-1, 0], [1, -0.5], [1, 1 / 3]])) and predicted == pytest.approx([1, 2.5, 10 / 3])


def test_out_of_fold_rows_and_baseline(frame):
    rows = T.explain_oof(frame, X, "y", "fold", ["id"], trees=4, depth=3)
    counts = {r["stage"]: r["count"] for r in rows.groupBy("stage").count().collect()}
    assert counts == {"occurrence": 400, "severity": frame.where("y > 0").count()}
    assert rows.where("abs(base + aggregate(phi, 0D, (a, v) -> a + v) - predicted) > 1e-9").count() == 0
    plain = T.forest_oof(frame, X, "y", "fold", trees=10, depth=5)
    assert plain.count() == 400 and plain.agg(F.corr("y", "predicted")).first()[0] > 0.5


def test_summaries_and_curves(spark):
    x = [k / 100 for k in range(100)]
    rows = spark.createDataFrame([("s", [v, 1.0], [v - 0.5, 0.1]) for v in x], "stage string, x array<double>, phi array<double>")
    cells = T.long_form(rows, ["u", "w"], ["stage"])
    got = {r["feature"]: r for r in T.value_summary(cells, ["stage"]).collect()}
    assert got["u"]["direction"] == "positive" and got["u"]["rank"] == 1 and got["u"]["rho"] == pytest.approx(1)
    assert got["u"]["contrast"] == pytest.approx(np.mean(x[80:]) - np.mean(x[:20]), abs=0.011) and got["u"]["mean_abs"] == pytest.approx(np.mean(np.abs(np.array(x) - 0.5)))
    assert got["w"]["direction"] == "undetermined" and got["w"]["n"] == 100
    groups = {r["feature_group"]: r for r in T.group_summary(rows, ["u", "w"], {"both": ["u", "w"], "w": ["w"]}, ["stage"]).collect()}
    assert groups["both"]["mean"] == pytest.approx(np.mean(x) - 0.4) and groups["w"]["positive"] == 1.0
    curve = T.binned(cells.where("feature = 'u'"), ["stage"], 10)
    assert curve.count() == 10 and curve.agg(F.sum("n")).first()[0] == 100
    shape = T.curve_metrics(curve, ["stage"]).first()
    assert (shape["bins"], shape["monotone"], shape["crossings"]) == (10, 1.0, 1) and shape["rho"] == pytest.approx(1)
    judged = spark.createDataFrame([("s", "j1", "u", 4.0), ("s", "j1", "w", 1.0), ("s", "j2", "u", 1.0), ("s", "j2", "w", 1.0)], "stage string, judge string, feature string, score double")
    ranks = {r["feature"]: r for r in T.consensus(judged, ["stage"], "judge", "score").collect()}
    assert ranks["u"]["rank"] == 1 and ranks["w"]["consensus"] == pytest.approx(0.5)
