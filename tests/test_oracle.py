"""Every query against its SQL in DuckDB on the smallest tables; queries without SQL against what must hold of their rows."""

import math
import os

import duckdb
import pytest

from gridloom import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v + 0.0:.5f}"
        return str(v)

    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in data)


def ordered(r):
    return r["low"] <= r["high"] and r["draws"] > 0


def wald(r):
    return r["se"] > 0 and r["low"] < r["estimate"] < r["high"] and 0 <= r["p"] <= 1


#: What holds of every row of a query without SQL: draws, iterative fits, forests.
HOLDS = {
    "cluster_bootstrap_ci": lambda r: ordered(r) and r["draws"] == 2000 and 0 <= r["probability_better"] <= 1,
    "exact_bootstrap_ci": lambda r: ordered(r) and r["draws"] == 2000 and 0 <= r["probability_better"] <= 1,
    "cluster_inflation": lambda r: r["cluster_se"] > 0 and r["row_se"] > 0 and abs(r["inflation"] - r["cluster_se"] / r["row_se"]) < 0.05 * r["inflation"],
    "spearman_bootstrap_ci": lambda r: r["low"] is None or (ordered(r) and -1 <= r["low"] and r["high"] <= 1),
    "season_screen": lambda r: r["size"] >= 1 and r["action"] in ("measure", "drop", "add") and (r["action"] != "measure" or not r["accepted"] or (r["vif"] <= 5 and r["rho"] <= 0.8)),
    "zero_component_screen": lambda r: r["loss"] > 0 and 1 <= r["rank"] <= 4 and r["delta"] > -1e-6 and r["stable"],
    "count_component_screen": lambda r: r["loss"] > 0 and 1 <= r["rank"] <= 4 and r["delta"] > -1e-6 and r["stable"],
    "indicator_screen": lambda r: r["season"] in (1, 2, 3) and r["feature"].startswith(("x", "p")),
    "fai_spline": lambda r: r["smooth_se"] > 0 and isinstance(r["peak"], bool),
    "hurdle_grid": lambda r: r["rank_sum"] > 0 and 1 <= r["position"] <= 9 and (r["position"] == 1 or not r["winner"]),
    "hurdle_importance": lambda r: r["n"] == 4 and 0 <= r["rmse_above"] <= 1 and 0 <= r["log_loss_above"] <= 1,
    "moran_permutation": lambda r: 1 / 10_000 <= r["p"] <= 1 and 1 / 10_000 <= r["p_greater"] <= 1 and r["permutations"] == 9999 and abs(r["expected"] + 1 / (r["n"] - 1)) < 1e-6,
    "vif_condition": lambda r: r["vif"] >= 1 - 1e-9 and r["condition"] >= 1,
    "glm_poisson_offset": lambda r: wald(r) and abs(r["rate_ratio"] - math.exp(r["estimate"])) < 1e-3 * r["rate_ratio"],
    "nb1_rate": wald,
    "truncated_nb1_rate": wald,
    "zinb1_rate": lambda r: r["loglik"] < 0,
    "two_way_wald": lambda r: r["se"] > 0 and r["low"] < r["estimate"] < r["high"] and r["valid"],
    "oof_count_families": lambda r: r["n"] > 0 and r["log_loss"] > 0 and 0 <= r["brier"] <= 1,
    "count_family_comparison": lambda r: r["delta_aic"] >= 0 and r["score"] < 0.05,
    "oof_attributions": lambda r: abs(r["base"] + sum(r[f"phi_{c}"] for c in ("x1", "x2", "x3", "x4", "pixels")) - r["predicted"]) < 1e-5,
    "attribution_summary": lambda r: r["mean_abs"] >= abs(r["mean"]) - 1e-6 and 0 <= r["positive"] <= 1 and 1 <= r["rank"] <= 5,
    "attribution_groups": lambda r: r["mean_abs"] >= abs(r["mean"]) - 1e-6 and 1 <= r["rank"] <= 2,
    "attribution_consensus": lambda r: r["judges"] == 2 and 0 < r["consensus"] <= 1 and (r["monotone"] is None or 0.5 <= r["monotone"] <= 1),
    "forest_baseline": lambda r: r["rmse"] >= r["mae"] >= abs(r["bias"]) - 1e-6,
    "mixed_mediators": lambda r: r["n"] > r["n_units"] > 0 and r["scale"] > 0 and (r["se"] is None or wald(r)),
    "mixed_tweedie": lambda r: wald(r) and 1 < r["power"] < 2 and r["scale"] > 0 and r["n"] > r["n_units"],
    "path_effects": lambda r: r["low"] <= r["median"] <= r["high"] and r["draws"] == 5000 and 0 < r["p"] <= 1 and abs(r["response_ratio"] - math.exp(r["estimate"])) < 1e-3,
    "hurdle_rf_oof": lambda r: 0 <= r["p"] <= 1 and r["severity"] > 0 and abs(r["predicted"] - r["p"] * r["severity"]) < 1e-4 and r["fold"] == r["year"] % 3,
    "kmeans_blocks": lambda r: 1 <= r["block"] <= 5 and r["n"] > 0,
    "permutation_importance": lambda r: 0 <= r["share_positive"] <= 1 and r["sd"] >= 0,
    "first_component_score": lambda r: r["score"] is None or abs(r["score"]) < 50,
}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    if name not in registry.ORACLE_SQL:
        found = got.collect()
        assert found and all(HOLDS[name](r) for r in found)
        return
    want = duck.sql(registry.ORACLE_SQL[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
