"""What must not grow faster than the input: guesses of sizes, rounds, passes."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import count_fits, forest_fits, forests, graph, mixed, models, shuffles, spatial
from gridloom.plans import mixed as plans_mixed
from gridloom.plans import relations

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_components_of_a_long_path_settle_and_keep_a_small_plan(spark):
    n = 600
    edges = spark.createDataFrame([((k * 7919) % n, ((k + 1) * 7919) % n) for k in range(n - 1)] + [(n, n), (n + 1, n + 2)], "source long, neighbour long")
    found = graph.weak_components(edges)
    labels = {r["node"]: r["component"] for r in found.collect()}
    assert labels == {**dict.fromkeys(range(n), 0), n: n, n + 1: n + 1, n + 2: n + 1}
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 64


def _counts(spark, n=240):
    rng = np.random.default_rng(3)
    x = rng.normal(size=n)
    y = rng.poisson(np.exp(0.3 + 0.4 * x) * rng.gamma(2, 0.5, n))
    return spark.createDataFrame([(float(a), int(b), 1.0, k % 3, "ab"[k % 2]) for k, (a, b) in enumerate(zip(x, y, strict=True))], "x double, y long, e double, f long, s string").repartition(3)


def test_gamma_sums_by_the_recurrence_keep_their_digits_where_the_series_cancels():
    y, r = np.array([0.0, 1, 3, 24, 25, 2.5]), np.array([2.0, 1e9, 1e9, 1e9, 0.7, 0.7])
    g, d, t = count_fits.polygamma_sums(y, r)
    assert np.allclose(g[1:4], [sum(math.log(b + k) for k in range(int(a))) for a, b in zip(y[1:4], r[1:4], strict=True)], rtol=1e-14)
    assert np.allclose(d[:4], [0, 1e-9, 3e-9, 24e-9], rtol=1e-7) and np.allclose(t[:4], [0, -1e-18, -3e-18, -24e-18], rtol=1e-7)
    assert np.allclose(g[4:], [math.lgamma(25.7) - math.lgamma(0.7), math.lgamma(3.2) - math.lgamma(0.7)], rtol=1e-9)


def test_jobs_of_several_families_and_folds_share_passes_and_end_where_single_ones_do(spark, monkeypatch):
    df, passes, real = _counts(spark), [], count_fits._pass
    monkeypatch.setattr(count_fits, "_pass", lambda *a: (passes.append(len(a[1])), real(*a))[1])
    jobs = [count_fits.Job("nb1", ("s",), "f"), count_fits.Job("ztnb1"), count_fits.Job("occurrence", (), "f")]
    together = count_fits.fit_jobs(df, jobs, ["x"], "y", "e")
    shared, alone = len(passes), []
    for j, found in zip(jobs, together, strict=True):
        del passes[:]
        one = count_fits.fit_many(df, j.family, ["x"], "y", "e", list(j.keys), j.fold)
        alone.append(len(passes))
        assert [(a.key, a.fold, a.rows) for a in one] == [(a.key, a.fold, a.rows) for a in found]
        assert all(np.allclose(a.loglik, b.loglik, rtol=1e-9) for a, b in zip(one, found, strict=True))
    assert shared == max(alone) and len(together[0]) == 6 and sum(alone) > shared


def test_shuffles_are_looked_up_where_the_edges_are_with_the_same_results(spark, monkeypatch):
    for n in (2, 7, 100, 997):
        assert (shuffles.bijection(shuffles.bijection(np.arange(n), n, 5), n, 5, back=True) == np.arange(n)).all()
    rng = np.random.default_rng(1)
    points = spark.createDataFrame([(k, *map(float, rng.normal(size=3))) for k in range(150)] + [(150, 0.0, 0.0, None)], "grid_uid long, x double, y double, v double")
    edges = spatial.nearest(points, 4)
    moved = spatial.moran_permutation(points, edges, "v", 60, batch=25, most=0).first()
    monkeypatch.setattr(spatial, "dealt", None)  # no value is moved
    here = spatial.moran_permutation(points, edges, "v", 60).first()
    assert all(abs(moved[c] - here[c]) < 1e-9 for c in here.asDict())
    assert spatial.moran_permutation(points.drop("x"), edges, "v", 60).first()["p"] == here["p"]


def _block(rng, units=40, levels=5):
    size = rng.integers(1, levels + 1, units)
    level = np.concatenate([rng.permutation(levels)[:k] for k in size])
    n = len(level)
    y = rng.integers(0, 4, n) / 2
    cells = np.stack([y, rng.normal(size=n) * 0.2, level.astype(float), np.ones(n), rng.normal(size=n)])
    return mixed._block(size.astype(np.int64).tobytes(), cells.tobytes(), 2, levels), cells, size


def test_a_pass_of_the_tweedie_fit_takes_distinct_values_and_sums_of_units():
    own, cells, size = _block(np.random.default_rng(5))
    y, offset, level, x = cells[0], cells[1], cells[2].astype(int), cells[3:].T
    assert len(own.above) <= 3 and own.times.sum() == (y > 0).sum()
    z = np.concatenate([x, np.eye(5)[level]], axis=1)
    for scale in (0.3, 40.0):  # the larger one reaches the bounds of the predictor
        theta = {"power": 1.4, "phi": 0.9, "sd_unit": 0.5, "z": scale * np.array([0.4, 1.0, 0.2, -0.1, 0.3, 0.0, -0.2])}
        got, u = mixed._unit_pass(own, theta, 0.0, np.zeros(len(size)))
        eta = np.clip(z @ theta["z"] + offset + np.repeat(u, size), -60, 60)
        low, high = y * np.exp(-0.4 * eta), np.exp(0.6 * eta)
        w = (0.6 * high + 0.4 * low) / 0.9
        owner = np.repeat(np.arange(len(size)), size)
        inside = np.eye(len(size))[owner]
        bend = inside.T @ w + 4
        curve = z.T @ (w[:, None] * z) - (z.T @ (w[:, None] * inside) / bend) @ (inside.T @ (w[:, None] * z))
        value = (low / (-0.4 * 0.9) - high / (0.6 * 0.9)).sum() - 2 * (u * u).sum() - 0.5 * np.log(bend * 0.25).sum()
        assert np.allclose(got, np.r_[value, z.T @ (low - high) / 0.9, curve.ravel(), len(y), len(size)], rtol=1e-7, atol=1e-7 * np.abs(curve).max())
        if scale < 1:
            assert np.allclose(inside.T @ (low - high) / 0.9, 4 * u, atol=1e-6)
            warm, _ = mixed._unit_pass(own, theta, 0.0, u + 0.1)
            assert np.allclose(got, warm, rtol=1e-7, atol=1e-7 * np.abs(curve).max())


def test_scores_of_the_mixed_models_are_stored_once(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    plan = plans_mixed.scores(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan and "grid_uid" in plan


def _watched(df):
    """df, and an accumulator of the rows that have been read from it."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


def _frame(spark, n=300):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(n, 2))
    return spark.createDataFrame([(i, i % 3, float(a), float(b), float(max(0, a + b))) for i, (a, b) in enumerate(x)], "id long, fold int, a double, b double, y double")


def test_rows_are_read_once_to_be_explained_and_leaves_work_out_their_values_once(spark, monkeypatch):
    df, seen = _watched(_frame(spark))
    assert forests.explain_oof(df, ["a", "b"], "y", "fold", ["id"], trees=3, depth=3).count() > 300
    assert seen.value == 300
    tree = {0: {"value": 2.0, "cover": 10, "left": 1, "right": 2, "feature": 0, "threshold": 0.5}, 1: {"value": 1.0, "cover": 5, "left": -1}, 2: {"value": 3.0, "cover": 5, "left": -1}}
    own, calls, real = forests.from_nodes([tree], 2), [], forests._leaf_values
    monkeypatch.setattr(forests, "_leaf_values", lambda *a: (calls.append(1), real(*a))[1])
    first = forests.attributions(np.array([[0.1, 0], [0.9, 0]]), own)[0]
    assert (forests.attributions(np.array([[0.9, 0], [0.1, 0]]), own)[0] == first[::-1]).all() and len(calls) == 2
    monkeypatch.setattr(forests, "TABLED", 0)
    assert np.allclose(forests.attributions(np.array([[0.1, 0], [0.9, 0]]), forests.from_nodes([tree], 2))[0], first)


def test_explained_rows_have_two_tasks_a_core_and_only_the_columns_needed(spark):
    df = _frame(spark).repartition(30).withColumn("dear", F.raise_error(F.lit("an unused column was worked out")).cast("double"))
    found = forests.explain_oof(df, ["a", "b"], "y", "fold", ["id", "fold"], trees=3, depth=3)
    assert found.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert {r["id"] for r in found.where("stage = 'occurrence'").collect()} == set(range(300))


def test_forests_of_all_folds_and_stages_share_a_pass_for_each_level(spark, monkeypatch):
    df, seen = _watched(_frame(spark).repartition(3))
    passes, real = [], forest_fits._sums
    monkeypatch.setattr(forest_fits, "_sums", lambda *a: (passes.append(len(a[1])), real(*a))[1])
    found = forest_fits.fit_forests(df, ["a", "b"], "y", "fold", ("occurrence", "severity"), 4, 3, 5, 7)
    assert passes == [6, 6, 6] and seen.value == 900 and set(found) == {(k, kind) for k in range(3) for kind in ("occurrence", "severity")}
    for trees in found.values():
        assert len(trees) == 4
        for tree in trees:
            for at in tree.values():
                if at["left"] >= 0:
                    children = [tree[at[c]] for c in ("left", "right")]
                    assert min(c["cover"] for c in children) >= 5 and sum(c["cover"] for c in children) == at["cover"]
                    assert abs(sum(c["cover"] * c["value"] for c in children) - at["cover"] * at["value"]) < 1e-9 * at["cover"]


def test_line_items_are_summed_before_they_meet_suppliers_with_the_same_panel(spark, tmp_path):
    con, sf = duckdb.connect(), str(tmp_path)
    con.sql("SET TimeZone = 'UTC'")
    made = {
        "region": "SELECT * FROM (VALUES (0, 'A'), (1, 'B'), (2, NULL)) t(r_regionkey, r_name)",
        "nation": "SELECT * FROM (VALUES (0, 0), (1, 1), (2, 2), (3, NULL), (4, 0), (4, 1)) t(n_nationkey, n_regionkey)",
        # number 1 twice in one region, 2 in two regions, 3 in none, 4 with a region without a name, 5 by a nation of two regions
        "supplier": "SELECT s::BIGINT AS s_suppkey, n::INTEGER AS s_nationkey, b::DOUBLE AS s_acctbal FROM (VALUES (0, 0, 1.5), (1, 0, 2), (1, 0, -3), (1, 0, NULL), (2, 0, 4), (2, 1, 5), (3, 3, 6), (4, 2, NULL), (5, 4, 8), (NULL, 0, 9)) t(s, n, b)",
        "lineitem": """SELECT CASE WHEN i % 8 < 7 THEN i % 8 END::BIGINT AS l_suppkey, CASE WHEN i % 11 THEN 40 + i % 13 END::DOUBLE AS l_quantity, CASE WHEN i % 8 <> 4 THEN ((i % 7) * 0.03)::DOUBLE END AS l_discount, ((i % 5) * 0.02)::DOUBLE AS l_tax,
            (1000.25 * (i % 17))::DOUBLE AS l_extendedprice, CASE i % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'N' END AS l_returnflag, CASE WHEN i % 19 THEN TIMESTAMP '1995-01-15' + to_days((i * 37 % 900)::INTEGER) END AS l_shipdate FROM range(4000) t(i)""",
    }
    for name, body in made.items():
        con.sql(f"COPY ({body}) TO '{sf}/{name}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {name} AS FROM '{sf}/{name}.parquet'")
    order = ["grid_uid", "country", "year", "season", "pixels", "fire_count", "burned_count", "x1", "x2", "x3", "x4", "x5"]
    own = relations.panel(spark, sf).select(*order)
    cells = lambda rows: sorted(tuple(f"{v:.9f}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    got, want = cells(own.collect()), cells(con.sql(relations.sql("panel", f"SELECT {', '.join(order)} FROM panel")).fetchall())
    assert len(got) > 60 and got == want
    plan = own._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first_join = next(i for i, line in enumerate(plan) if "Join" in line)
    assert any("Aggregate [l_suppkey" in line for line in plan[first_join:])


def test_ranks_of_a_summary_go_by_ranges(spark):
    cells = spark.createDataFrame([("s", "u", float(k % 7), float((k * 37) % 50)) for k in range(200)], "stage string, feature string, x double, phi double")
    found = forests.value_summary(cells, ["stage"])
    data = np.array([(k % 7, (k * 37) % 50) for k in range(200)], float)
    ranks = [np.array([(c < v).sum() + ((c == v).sum() + 1) / 2 for v in c]) for c in data.T]
    assert abs(found.first()["rho"] - np.corrcoef(*ranks)[0, 1]) < 1e-12
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all("_range" in line for line in plan.splitlines() if "Window [sum(k" in line)


def test_rows_are_read_for_their_numbers_only_to_shuffle_columns(spark):
    df, seen = _watched(_frame(spark))
    got = {r["feature"]: r["mean"] for r in models.permutation_importance(df, ["a", "b"], {"a": ["a"], "both": ["a", "b"]}, "y", repeats=2).collect()}
    assert seen.value <= 600 and got["both"] > got["a"] > 0
