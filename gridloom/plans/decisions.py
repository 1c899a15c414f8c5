"""Queries: aligned models, audits of predictions, decision tables, set operations, tests with p values."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import scalar as S
from gridloom.operators import alignment as A
from gridloom.operators import association as R
from gridloom.operators import decisions as D
from gridloom.operators import graph as G
from gridloom.operators import metrics as M
from gridloom.operators import panel as P
from gridloom.operators import spatial as X
from gridloom.operators import trend as T
from gridloom.plans.analysis import _KNN
from gridloom.plans.descriptive import rounded
from gridloom.plans.evaluation import _ANNUAL, _METRICS, _O, _Q, _annual
from gridloom.plans.relations import ev, oof, panel, pts, sql
from gridloom.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


_KEYS = ["grid_uid", "country", "year", "season"]

# --- alignment ----------------------------------------------------------------------------------


@query("two_year_full_outer", sql("panel", """
SELECT coalesce(a.grid_uid, b.grid_uid) AS grid_uid, coalesce(a.season, b.season) AS season,
  a.fire_count AS left_fire_count, b.fire_count AS right_fire_count, a.burned_count AS left_burned_count, b.burned_count AS right_burned_count,
  CASE WHEN a.grid_uid IS NOT NULL AND b.grid_uid IS NOT NULL THEN 'both' WHEN a.grid_uid IS NOT NULL THEN 'left' ELSE 'right' END AS status,
  CASE WHEN a.grid_uid IS NOT NULL AND b.grid_uid IS NOT NULL THEN abs(a.fire_count - b.fire_count) <= 1 AND abs(a.burned_count - b.burned_count) <= 1 END AS agree
FROM (SELECT * FROM panel WHERE year = 1995) a FULL OUTER JOIN (SELECT * FROM panel WHERE year = 2001) b ON a.grid_uid = b.grid_uid AND a.season = b.season"""))
def two_year_full_outer(spark, sf):
    own = panel(spark, sf)
    return A.outer_compare(own.where("year = 1995"), own.where("year = 2001"), ["grid_uid", "season"], ["fire_count", "burned_count"], absolute=1.0)


@query("aligned_models_wide", sql("oof", """
SELECT grid_uid, country, year, season, round(s.predicted, 6) AS season_predicted, round(s.p, 6) AS season_p,
  round(c.predicted, 6) AS country_predicted, round(c.p, 6) AS country_p, round(g.predicted, 6) AS grid_predicted, round(g.p, 6) AS grid_p
FROM (SELECT * FROM oof WHERE model = 'season') s JOIN (SELECT * FROM oof WHERE model = 'country') c USING (grid_uid, country, year, season)
JOIN (SELECT * FROM oof WHERE model = 'grid') g USING (grid_uid, country, year, season)"""))
def aligned_models_wide(spark, sf):
    return rounded(A.wide_members(oof(spark, sf), _KEYS, "model", ["season", "country", "grid"], ["predicted", "p"]))


@query("reference_order_join", sql("panel", """, ref AS (SELECT DISTINCT grid_uid, season FROM panel), own AS (SELECT * FROM panel WHERE year = 1995)
SELECT r.grid_uid, r.season, o.fire_count, o.grid_uid IS NOT NULL AS found FROM ref r LEFT JOIN own o ON o.grid_uid = r.grid_uid AND o.season = r.season"""))
def reference_order_join(spark, sf):
    own = panel(spark, sf)
    return A.reindexed(own, own.where("year = 1995"), ["grid_uid", "season"], ["fire_count"])


@query("match_indicator", """
WITH a AS (SELECT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 300000)
SELECT (SELECT count(*) FROM a) AS n_rows, (SELECT count(*) FROM a WHERE k IN (SELECT k FROM b)) AS n_matched,
  (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS n_unmatched, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS n_reverse""")
def match_indicator(spark, sf):
    orders = table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("k"))
    return A.match_counts(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), orders, ["k"])


@query("exact_sample", sql("oof", """, s AS (SELECT grid_uid, year, season, exposure, observed FROM oof WHERE model = 'grid')
SELECT count(p.grid_uid) AS n_rebuilt, CAST(count_if(p.grid_uid IS NULL) AS BIGINT) AS n_lacking, CAST(count_if(p.pixels <> s.exposure) AS BIGINT) AS n_differ_pixels, CAST(count_if(p.fire_count <> s.observed) AS BIGINT) AS n_differ_fire_count
FROM s LEFT JOIN panel p USING (grid_uid, year, season)"""))
def exact_sample(spark, sf):
    stored = oof(spark, sf).where("model = 'grid'").select("grid_uid", "year", "season", F.col("exposure").alias("pixels"), F.col("observed").alias("fire_count"))
    return A.sample_checks(panel(spark, sf), stored, ["grid_uid", "year", "season"], ["pixels", "fire_count"])


@query("oof_key_checks", sql("oof", """
SELECT model, season, count(*) AS n_rows, count(DISTINCT (grid_uid, year)) AS n_keys, CAST(0 AS BIGINT) AS n_null_keys, CAST(sum(observed) AS BIGINT) AS total_observed, CAST(sum(exposure) AS BIGINT) AS total_exposure, count(*) = count(DISTINCT (grid_uid, year)) AS unique_keys
FROM oof GROUP BY model, season"""))
def oof_key_checks(spark, sf):
    return A.key_checks(oof(spark, sf), ["grid_uid", "year"], ["model", "season"], ["observed", "exposure"])


@query("edge_table_comparison", sql("pts", _KNN + """, b AS (SELECT * FROM e WHERE NOT (rank > 6 AND source % 2 = 0))
SELECT count(*) FILTER (WHERE e.source IS NOT NULL AND b.source IS NOT NULL) AS n_both, count(*) FILTER (WHERE b.source IS NULL) AS n_left, count(*) FILTER (WHERE e.source IS NULL) AS n_right,
  count(*) FILTER (WHERE e.neighbour <> b.neighbour) AS n_other_neighbour, count(*) FILTER (WHERE abs(e.distance - b.distance) > 1e-6) AS n_other_distance
FROM e FULL OUTER JOIN b ON e.source = b.source AND e.rank = b.rank"""))
def edge_table_comparison(spark, sf):
    edges = X.nearest(pts(spark, sf), 8)
    return A.edge_differences(edges, edges.where("not (rank > 6 and source % 2 = 0)"))


# --- predictions --------------------------------------------------------------------------------

_RATES = """CAST(observed AS DOUBLE) / exposure AS orate, predicted / exposure AS frate"""


@query("oof_normalised", sql("oof", f"""
SELECT model AS model_role, 'temporal' AS scheme, grid_uid, country, year, season, fold, exposure, observed, round(predicted, 6) AS predicted, round(p, 6) AS p,
  round(orate, 6) AS observed_rate, round(frate, 6) AS predicted_rate, round(observed - predicted, 6) AS residual, round(orate - frate, 6) AS rate_residual,
  round(CAST(observed > 0 AS INT) - p, 6) AS occurrence_residual, round(CASE WHEN p > 0 THEN predicted / p END, 6) AS mean_if_positive
FROM (SELECT *, {_RATES} FROM oof)"""))
def oof_normalised(spark, sf):
    return rounded(D.normalised(oof(spark, sf)))


@query("conditional_mean", sql("oof", """
SELECT model, season, round(avg(CASE WHEN p > 0 THEN predicted / p END), 6) AS mean_if_positive, round(max(CASE WHEN p > 0 THEN predicted / p END), 6) AS greatest,
  count_if(p > 0) AS n_defined, round(avg(1 - exp(-predicted)), 6) AS poisson_positive FROM oof GROUP BY model, season"""))
def conditional_mean(spark, sf):
    c = D.conditional_mean(F.col("predicted"), F.col("p"))
    return rounded(oof(spark, sf).groupBy("model", "season").agg(F.avg(c).alias("mean_if_positive"), F.max(c).alias("greatest"), F.count(c).alias("n_defined"), F.avg(D.poisson_positive(F.col("predicted"))).alias("poisson_positive")))


@query("residual_families", sql("oof", f"""
SELECT model, country, season, round(avg({_O} - p), 6) AS r_occurrence, round(avg((observed - predicted) / exposure), 6) AS r_rate, round(avg(observed - predicted), 6) AS r_count,
  round(avg(CASE WHEN observed > 0 AND predicted > 0 THEN ln(observed) - ln(predicted) END), 6) AS r_magnitude, round(avg(-({_O} * ln({_Q}) + (1 - {_O}) * ln(1 - {_Q}))), 6) AS nll,
  round(avg(pow(p - {_O}, 2)), 6) AS brier, round(avg(pow(observed - predicted, 2)), 6) AS se, round(avg(abs(observed - predicted)), 6) AS ae FROM oof GROUP BY model, country, season"""))
def residual_families(spark, sf):
    names = ("r_occurrence", "r_rate", "r_count", "r_magnitude", "nll", "brier", "se", "ae")
    return rounded(D.residual_families(oof(spark, sf)).groupBy("model", "country", "season").agg(*(F.avg(c).alias(c) for c in names)))


@query("rate_multiple", sql("oof", f"""
SELECT model, season, round(max(orate), 6) AS greatest_observed, round(max(frate), 6) AS greatest_predicted,
  round(CASE WHEN max(orate) > 0 THEN max(frate) / max(orate) WHEN max(frate) = 0 THEN 1 ELSE CAST('inf' AS DOUBLE) END, 6) AS multiple
FROM (SELECT *, {_RATES} FROM oof) GROUP BY model, season"""))
def rate_multiple(spark, sf):
    return rounded(D.rate_multiple(oof(spark, sf), ["model", "season"]))


@query("prediction_audit", sql("oof", """, d AS (SELECT model, season, CASE WHEN grid_uid % 97 = 1 THEN -predicted WHEN grid_uid % 97 = 2 THEN NULL ELSE predicted END AS predicted, CASE WHEN grid_uid % 89 = 3 THEN 1.5 ELSE p END AS p FROM oof)
SELECT model, season, count(*) AS n, CAST(count_if(predicted IS NULL) AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_not_finite, CAST(count_if(predicted < 0) AS BIGINT) AS n_negative,
  CAST(count_if(NOT coalesce(p BETWEEN 0 AND 1, false)) AS BIGINT) AS n_bad_probability, count_if(predicted IS NULL) + count_if(predicted < 0) + count_if(NOT coalesce(p BETWEEN 0 AND 1, false)) = 0 AS valid
FROM d GROUP BY model, season"""))
def prediction_audit(spark, sf):
    """The audit of predictions in which some units have faults put in, so that it has something to find."""
    fault = F.when(F.col("grid_uid") % 97 == 1, -F.col("predicted")).when(F.col("grid_uid") % 97 == 2, F.lit(None)).otherwise(F.col("predicted"))
    own = oof(spark, sf).withColumns({"predicted": fault, "p": F.when(F.col("grid_uid") % 89 == 3, 1.5).otherwise(F.col("p"))})
    return D.prediction_audit(own, ["model", "season"])


def _newton(rounds: int) -> str:
    """SQL of the same Newton steps, two common table expressions each; NULL where the last step was not small."""
    clipped = "least(1 - 1e-6, greatest(1e-6, q))"
    steps = [f""", c AS (SELECT model, season, ln({clipped}) - ln(1 - {clipped}) AS x, count_if(observed > 0) AS pos, count(*) AS n
  FROM (SELECT *, round(p, 9) AS q FROM oof WHERE model <> 'season') GROUP BY model, season, q),
n0 AS (SELECT DISTINCT model, season, CAST(0 AS DOUBLE) AS a, CAST(1 AS DOUBLE) AS b, CAST(1 AS DOUBLE) AS moved FROM c)"""]
    for k in range(rounds):
        steps.append(f""", s{k} AS (SELECT model, season, any_value(a) AS a, any_value(b) AS b, sum(pos - n * m) AS g0, sum((pos - n * m) * x) AS g1, sum(n * m * (1 - m)) AS h00, sum(n * m * (1 - m) * x) AS h01, sum(n * m * (1 - m) * x * x) AS h11
  FROM (SELECT *, 1 / (1 + exp(-(a + b * x))) AS m FROM c JOIN n{k} USING (model, season)) GROUP BY model, season),
d{k} AS (SELECT *, (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS da, (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS db FROM s{k}),
n{k + 1} AS (SELECT model, season, a + da AS a, b + db AS b, abs(da) + abs(db) AS moved FROM d{k})""")
    settled = "isfinite(moved) AND moved < 1e-6"
    return "".join(steps) + f" SELECT model, season, CASE WHEN {settled} THEN round(a, 6) END AS intercept, CASE WHEN {settled} THEN round(b, 6) END AS slope FROM n{rounds}"


@query("occurrence_calibration", sql("oof", _newton(25)))
def occurrence_calibration(spark, sf):
    return rounded(D.occurrence_calibration(oof(spark, sf).where("model <> 'season'"), ["model", "season"]))


@query("linear_calibration", sql("oof", """
SELECT model, season, round(regr_slope(observed, predicted), 6) AS calibration_slope, round(regr_intercept(observed, predicted), 6) AS calibration_intercept, round(regr_r2(observed, predicted), 6) AS calibration_r2 FROM oof WHERE model <> 'season' GROUP BY model, season"""))
def linear_calibration(spark, sf):
    y, f = F.col("observed").cast("double"), F.col("predicted")
    return rounded(oof(spark, sf).where("model <> 'season'").groupBy("model", "season").agg(F.regr_slope(y, f).alias("calibration_slope"), F.regr_intercept(y, f).alias("calibration_intercept"), F.regr_r2(y, f).alias("calibration_r2")))


# --- decisions ----------------------------------------------------------------------------------


@query("metric_reconciliation", sql("oof", """, f AS (SELECT model, season, fold, count(*) AS n, sum(abs(predicted - observed)) AS ae FROM oof GROUP BY ALL),
a AS (SELECT model, season, sum(ae) / sum(n) AS mae FROM f GROUP BY ALL), b AS (SELECT model, season, avg(abs(predicted - observed)) + CASE WHEN season = 2 THEN 0.001 ELSE 0 END AS mae FROM oof WHERE NOT (model = 'grid' AND season = 3) GROUP BY model, season)
SELECT CAST(count_if(a.model IS NOT NULL AND b.model IS NOT NULL) AS BIGINT) AS n_both, CAST(count_if(b.model IS NULL) AS BIGINT) AS n_left, CAST(count_if(a.model IS NULL) AS BIGINT) AS n_right, CAST(count_if(abs(a.mae - b.mae) > 1e-6) AS BIGINT) AS n_differ, false AS reconciled
FROM a FULL OUTER JOIN b ON a.model = b.model AND a.season = b.season"""))
def metric_reconciliation(spark, sf):
    """Pooled metrics rebuilt from folds against stored ones, of which one is missing and some are off."""
    own = oof(spark, sf)
    folds = own.groupBy("model", "season", "fold").agg(F.count("*").alias("n"), F.sum(F.abs(F.col("predicted") - F.col("observed"))).alias("ae"))
    rebuilt = folds.groupBy("model", "season").agg((F.sum("ae") / F.sum("n")).alias("mae"))
    stored = M.metric_rows(own, ["model", "season"]).where("not (model = 'grid' and season = 3)").withColumn("mae", F.col("mae") + F.when(F.col("season") == 2, 0.001).otherwise(0.0))
    return A.reconciliation(A.outer_compare(rebuilt, stored, ["model", "season"], ["mae"], absolute=1e-6))


@query("main_comparison_table", sql("oof", _ANNUAL.rstrip() + f""", m AS (SELECT model, season, {_METRICS} FROM oof GROUP BY model, season),
y AS (SELECT model, season, round(sqrt(avg(pow(predicted - observed, 2))), 6) AS annual_rmse FROM a GROUP BY model, season)
SELECT model, CASE season WHEN 1 THEN 'spring' WHEN 2 THEN 'summer' ELSE 'autumn' END AS season_label, n, rmse, mae, brier, annual_rmse, CAST(rank() OVER (PARTITION BY season ORDER BY rmse) AS INTEGER) AS rmse_rank, CAST(rank() OVER (PARTITION BY season ORDER BY annual_rmse) AS INTEGER) AS annual_rank
FROM m JOIN y USING (model, season)"""))
def main_comparison_table(spark, sf):
    overall = rounded(M.metric_rows(oof(spark, sf), ["model", "season"]))
    annual = rounded(_annual(spark, sf).groupBy("model", "season").agg(F.sqrt(F.avg((F.col("predicted") - F.col("observed")) * (F.col("predicted") - F.col("observed")))).alias("annual_rmse")))
    own = overall.join(annual, ["model", "season"])
    own = M.ranks(own, ["season"], "rmse", F.lit(True)).withColumnRenamed("rank_min", "rmse_rank").drop("rank_average")
    own = M.ranks(own, ["season"], "annual_rmse", F.lit(True)).withColumnRenamed("rank_min", "annual_rank")
    label = A.recode(F.col("season").cast("string"), {"1": "spring", "2": "summer", "3": "autumn"})
    return own.select("model", label.alias("season_label"), "n", "rmse", "mae", "brier", "annual_rmse", "rmse_rank", "annual_rank")


_SIDE = "CASE WHEN {0} < -0.0001 THEN 'better' WHEN {0} > 0.0001 THEN 'worse' ELSE 'same' END"


@query("tradeoff", sql("oof", f""", r AS (SELECT model, season, sqrt(avg(pow(predicted - observed, 2))) AS rmse, abs(avg(predicted - observed)) AS bias FROM oof GROUP BY model, season),
d AS (SELECT a.model AS candidate, a.season, a.rmse - b.rmse AS de, a.bias - b.bias AS dd FROM r a JOIN r b ON b.season = a.season AND b.model = 'season' AND a.model <> 'season'),
s AS (SELECT *, {_SIDE.format('de')} AS error_side, {_SIDE.format('dd')} AS dependence_side FROM d),
c AS (SELECT *, CASE WHEN error_side = 'better' AND dependence_side <> 'worse' THEN 'gain' WHEN error_side = 'better' THEN 'trade-off' WHEN error_side = 'worse' AND dependence_side = 'better' THEN 'trade-off' WHEN error_side = 'worse' THEN 'loss' WHEN dependence_side = 'better' THEN 'gain' WHEN dependence_side = 'worse' THEN 'loss' ELSE 'no change' END AS category FROM s)
SELECT candidate, season, round(de, 6) AS error_difference, round(dd, 6) AS dependence_difference, error_side, dependence_side, category,
  CASE category WHEN 'gain' THEN 'use the candidate' WHEN 'loss' THEN 'keep the reference' WHEN 'trade-off' THEN 'report both' ELSE 'either' END AS recommendation FROM c"""))
def tradeoff(spark, sf):
    m = M.metric_rows(oof(spark, sf), ["model", "season"]).select("model", "season", "rmse", F.abs("bias").alias("bias"))
    base = m.where("model = 'season'").select("season", F.col("rmse").alias("b_rmse"), F.col("bias").alias("b_bias"))
    own = m.where("model <> 'season'").join(base, "season").select(F.col("model").alias("candidate"), "season", (F.col("rmse") - F.col("b_rmse")).alias("error_difference"), (F.col("bias") - F.col("b_bias")).alias("dependence_difference"))
    return rounded(D.tradeoff(own, "error_difference", "dependence_difference", 0.0001))


@query("winner_with_tolerance", sql("oof", """, m AS (SELECT model, season, fold, round(sqrt(avg(pow(predicted - observed, 2))), 6) AS rmse FROM oof GROUP BY ALL), b AS (SELECT *, min(rmse) OVER (PARTITION BY season, fold) AS best FROM m)
SELECT season, fold, string_agg(model, ';' ORDER BY model) AS winner, any_value(best) AS best, count(*) AS n_winners FROM b WHERE abs(rmse - best) <= 0.05 GROUP BY season, fold"""))
def winner_with_tolerance(spark, sf):
    return D.winners(rounded(M.metric_rows(oof(spark, sf), ["model", "season", "fold"]).select("model", "season", "fold", "rmse")), ["season", "fold"], "model", "rmse", 0.05)


@query("rank_of_rank_sum", sql("oof", """, m AS (SELECT model, season, round(sqrt(avg(pow(predicted - observed, 2))), 9) AS rmse, round(avg(abs(predicted - observed)), 9) AS mae FROM oof GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY season ORDER BY rmse) + (count(*) OVER (PARTITION BY season, rmse) - 1) / 2.0 + rank() OVER (PARTITION BY season ORDER BY mae) + (count(*) OVER (PARTITION BY season, mae) - 1) / 2.0 AS rank_sum FROM m)
SELECT model, season, rank_sum, CAST(rank() OVER (PARTITION BY season ORDER BY rank_sum) AS INTEGER) AS place FROM r"""))
def rank_of_rank_sum(spark, sf):
    own = M.metric_rows(oof(spark, sf), ["model", "season"]).select("model", "season", F.round("rmse", 9).alias("rmse"), F.round("mae", 9).alias("mae"))
    own = M.ranks(own, ["season"], "rmse", F.lit(True)).select("model", "season", "mae", F.col("rank_average").alias("a"))
    own = M.ranks(own, ["season"], "mae", F.lit(True)).select("model", "season", (F.col("a") + F.col("rank_average")).alias("rank_sum"))
    return M.ranks(own, ["season"], "rank_sum", F.lit(True)).select("model", "season", "rank_sum", F.col("rank_min").alias("place"))


@query("relative_importance", sql("panel", """, v AS (SELECT season, country, sum(fire_count) AS fires FROM panel GROUP BY ALL)
SELECT season, country, CAST(fires AS BIGINT) AS fires, round(100.0 * fires / max(fires) OVER (PARTITION BY season), 6) AS relative FROM v"""))
def relative_importance(spark, sf):
    own = panel(spark, sf).groupBy("season", "country").agg(F.sum("fire_count").alias("fires"))
    return rounded(D.relative_to_greatest(own, ["season"], "fires").select("season", "country", "fires", "relative"))


@query("residual_sign_changes", sql("oof", """, r AS (SELECT model, country, season, year, round(sum(observed - predicted), 9) AS r FROM oof GROUP BY ALL), s AS (SELECT *, sign(r) <> lag(sign(r)) OVER (PARTITION BY model, country, season ORDER BY year) AS change FROM r WHERE r <> 0)
SELECT model, country, season, count(*) AS n_nonzero, CAST(count_if(change) AS BIGINT) AS n_changes FROM s GROUP BY model, country, season"""))
def residual_sign_changes(spark, sf):
    own = oof(spark, sf).groupBy("model", "country", "season", "year").agg(F.round(F.sum(F.col("observed") - F.col("predicted")), 9).alias("r"))
    return D.sign_changes(own, ["model", "country", "season"], "year", "r")


_DEPENDENCE = """, x AS (SELECT season, grid_uid, year, observed - predicted AS r FROM oof WHERE model = 'country'), c AS (SELECT season, grid_uid, count(*) AS n, avg(r) AS m, var_pop(r) * count(*) AS w FROM x GROUP BY ALL),
g AS (SELECT season, count(*) AS k, sum(n) AS t, sum(n * n) AS n2, sum(w) AS ssw, sum(n * m * m) - pow(sum(n * m), 2) / sum(n) AS ssb FROM c GROUP BY season),
h AS (SELECT *, ssb / (k - 1) AS msb, ssw / (t - k) AS msw, (t - CAST(n2 AS DOUBLE) / t) / (k - 1) AS n0 FROM g), i AS (SELECT season, (msb - msw) / (msb + (n0 - 1) * msw) AS icc, n0 FROM h),
l AS (SELECT season, r, lag(r) OVER w AS b, year - lag(year) OVER w AS step FROM x WINDOW w AS (PARTITION BY season, grid_uid ORDER BY year)), lc AS (SELECT season, corr(r, b) AS lag1 FROM l WHERE step = 1 GROUP BY season),
s AS (SELECT season, icc, lag1, 1 + (n0 - 1) * greatest(0, least(1, icc)) AS design_effect FROM i JOIN lc USING (season))
SELECT season, round(icc, 6) AS icc, round(lag1, 6) AS lag1, round(design_effect, 6) AS design_effect, icc >= 0.05 AS icc_signal, abs(lag1) >= 0.1 AS lag_signal, sqrt(design_effect) >= 1.1 AS inflation_signal,
  CASE CAST(icc >= 0.05 AS INT) + CAST(abs(lag1) >= 0.1 AS INT) + CAST(sqrt(design_effect) >= 1.1 AS INT) WHEN 0 THEN 'independent rows' WHEN 1 THEN 'report both' ELSE 'clustered inference' END AS decision FROM s"""


@query("dependence_signal", sql("oof", _DEPENDENCE))
def dependence_signal(spark, sf):
    own = oof(spark, sf).where("model = 'country'").withColumn("r", F.col("observed") - F.col("predicted"))
    a = M.icc(own, ["season"], ["grid_uid"], "r").select("season", "icc", "design_effect")
    b = M.lag_one(own, ["season"], ["grid_uid"], "year", "r").select("season", F.col("pearson").alias("lag1"))
    return rounded(D.dependence_signal(a.join(b, "season")))


@query("moran_compare", sql("pts", _KNN.rstrip() + """, v AS (SELECT vec_id AS grid_uid, 'baseline' AS model, CAST(embedding[3] AS DOUBLE) AS value FROM embeddings UNION ALL SELECT vec_id, 'final', CAST(embedding[4] AS DOUBLE) FROM embeddings),
z AS (SELECT model, grid_uid, value - avg(value) OVER w AS z, var_pop(value) OVER w AS s2 FROM v WINDOW w AS (PARTITION BY model)),
m AS (SELECT a.model, sum(a.z * b.z / 8) / sum(1.0 / 8) / any_value(a.s2) AS i FROM e JOIN z a ON a.grid_uid = source JOIN z b ON b.grid_uid = neighbour AND b.model = a.model GROUP BY a.model)
SELECT round(a.i, 6) AS baseline, round(b.i, 6) AS final, round(abs(b.i) - abs(a.i), 6) AS change, CASE WHEN abs(b.i) < abs(a.i) THEN 'less dependence' WHEN abs(b.i) > abs(a.i) THEN 'more dependence' ELSE 'same' END AS conclusion FROM m a, m b WHERE a.model = 'baseline' AND b.model = 'final'"""))
def moran_compare(spark, sf):
    own = pts(spark, sf)
    edges = X.nearest(own, 8)
    other = table(spark, sf, "embeddings").select(F.col("vec_id").alias("grid_uid"), F.element_at("embedding", 4).cast("double").alias("value"))
    a = X.moran(own, edges, "value").select(F.col("moran").alias("baseline"))
    out = a.crossJoin(X.moran(other, edges, "value").select(F.col("moran").alias("final")))
    change = F.abs("final") - F.abs("baseline")
    return rounded(out.select("baseline", "final", change.alias("change"), F.when(change < 0, "less dependence").when(change > 0, "more dependence").otherwise("same").alias("conclusion")))


@query("knn_components", "WITH RECURSIVE " + sql("pts", _KNN.rstrip())[5:] + """, both_ways AS (SELECT source AS u, neighbour AS v FROM e UNION SELECT neighbour, source FROM e),
reach(u, c) AS (SELECT DISTINCT u, u FROM both_ways UNION SELECT b.v, r.c FROM reach r JOIN both_ways b ON b.u = r.u WHERE r.c < b.v)
SELECT component, count(*) AS n_nodes FROM (SELECT u, min(c) AS component FROM reach GROUP BY u) GROUP BY component""")
def knn_components(spark, sf):
    return G.component_sizes(G.weak_components(X.nearest(pts(spark, sf), 8)))


# --- sets, samples, recodes ---------------------------------------------------------------------


@query("set_comparison", """
WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE year(l_shipdate) = 1996), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE year(l_shipdate) = 2001), n AS (SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b USING (k)) AS n_both)
SELECT n_a, n_b, n_both, n_a = n_both AND n_b = n_both AS equal FROM n""")
def set_comparison(spark, sf):
    own = table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year"), "l_partkey")
    return A.set_comparison(own, "year", 1996, 2001, "l_partkey")


@query("seeded_sample", sql("ev", """, h AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY md5('2026|' || fire_id), fire_id) AS k FROM ev)
SELECT fire_id, country, year, season, round(frp, 6) AS frp FROM h WHERE k <= 20"""))
def seeded_sample(spark, sf):
    return rounded(A.seeded_sample(ev(spark, sf), ["country"], ["fire_id"], 20, 2026))


@query("top_n_candidates", sql("panel", """, h AS (SELECT season, grid_uid, sum(fire_count) AS fires, sum(pixels) AS pixels FROM panel GROUP BY ALL)
SELECT season, grid_uid, CAST(fires AS BIGINT) AS fires, CAST(pixels AS BIGINT) AS pixels, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY fires DESC, pixels, grid_uid) AS place FROM h) WHERE place <= 5"""))
def top_n_candidates(spark, sf):
    own = panel(spark, sf).groupBy("season", "grid_uid").agg(F.sum("fire_count").alias("fires"), F.sum("pixels").alias("pixels"))
    return A.top_rows(own, ["season"], [F.desc("fires"), F.asc("pixels"), F.asc("grid_uid")], 5)


_BLOCKS = {"x1": "size", "x2": "price", "x3": "price", "x4": "price", "x5": "place", "pixels": "size"}


@query("omission_candidates", sql("panel", """, seen AS (""" + " UNION ALL ".join(f"SELECT '{g}' AS block, '{c}' AS predictor FROM panel HAVING count(DISTINCT {c}) > 1" for c, g in _BLOCKS.items()) + """), c AS (SELECT DISTINCT block FROM seen)
SELECT 'without ' || c.block AS candidate, CAST(count(*) AS INTEGER) AS n_predictors, string_agg(b.predictor, ';' ORDER BY b.predictor) AS predictors FROM c JOIN seen b ON b.block <> c.block GROUP BY c.block
UNION ALL SELECT 'all', CAST(count(*) AS INTEGER), string_agg(predictor, ';' ORDER BY predictor) FROM seen"""))
def omission_candidates(spark, sf):
    """Candidates of the panel's predictors that vary: all, and all without each block."""
    varied = P.missingness(panel(spark, sf), [], list(_BLOCKS)).where("n_unique > 1")
    block = F.element_at(F.create_map(*(F.lit(x) for pair in _BLOCKS.items() for x in pair)), F.col("variable"))
    return A.omission_candidates(varied.select(block.alias("block"), F.col("variable").alias("predictor")))


@query("unit_conversion", sql("panel", """
SELECT season, CASE season WHEN 1 THEN 'spring' WHEN 2 THEN 'summer' ELSE 'autumn' END AS season_label, CASE country WHEN 'AMERICA' THEN 'AM' WHEN 'MIDDLE EAST' THEN 'ME' ELSE country END AS country_code,
  round(sum(pixels * CAST(0.25 AS DOUBLE)), 6) AS km2, round(sum(pixels * CAST(25 AS DOUBLE)), 6) AS ha, CAST(count_if(abs(pixels * 25.0 - pixels * 0.25 * 100) > 1e-9) AS BIGINT) AS n_off FROM panel GROUP BY ALL"""))
def unit_conversion(spark, sf):
    season = A.recode(F.col("season").cast("string"), {"1": "spring", "2": "summer", "3": "autumn"})
    country = A.recode(F.col("country"), {"AMERICA": "AM", "MIDDLE EAST": "ME"})
    km2, ha = F.col("pixels") * 0.25, F.col("pixels") * 25.0
    return rounded(panel(spark, sf).groupBy("season", season.alias("season_label"), country.alias("country_code")).agg(F.sum(km2).alias("km2"), F.sum(ha).alias("ha"), F.count_if(~S.close(ha, km2 * 100)).alias("n_off")))


@query("json_fields", """
SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS INTEGER)) AS BIGINT) AS k_sum, max(CAST(json_extract(props, '$.k') AS INTEGER)) AS k_max, CAST(count_if(json_extract(props, '$.k') IS NULL) AS BIGINT) AS n_lacking FROM events GROUP BY event_type""")
def json_fields(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"), F.count_if(k.isNull()).alias("n_lacking"))


@query("train_scaled", sql("panel", """, f AS (SELECT *, year % 5 + 1 AS fold FROM panel), k AS (SELECT DISTINCT fold AS held FROM f), s AS (SELECT held, avg(x1) AS m, stddev_pop(x1) AS sd FROM f JOIN k ON fold <> held GROUP BY held)
SELECT fold, count(*) AS n, round(avg((x1 - m) / sd), 6) AS mean_z, round(stddev_pop((x1 - m) / sd), 6) AS sd_z, round(min((x1 - m) / sd), 6) AS least, round(max((x1 - m) / sd), 6) AS greatest FROM f JOIN s ON held = fold GROUP BY fold"""))
def train_scaled(spark, sf):
    own = panel(spark, sf).withColumn("fold", F.col("year") % 5 + 1)
    z = P.zscore_held_out(own, "fold", "x1")
    return rounded(z.groupBy("fold").agg(F.count("*").alias("n"), F.avg("x1_z").alias("mean_z"), F.stddev_pop("x1_z").alias("sd_z"), F.min("x1_z").alias("least"), F.max("x1_z").alias("greatest")))


@query("fai_equal_panel", sql("panel", """, r AS (SELECT grid_uid, year, season, country, CAST(fire_count AS DOUBLE) / pixels AS f, CAST(burned_count AS DOUBLE) / pixels AS b FROM panel), t AS (SELECT max(f) AS fm, max(b) AS bm, avg(f) AS fa, avg(b) AS ba FROM r)
SELECT grid_uid, year, season, round(0.5 * (f / fm + b / bm), 6) AS fai_max, round(0.5 * (f / fa + b / ba), 6) AS fai_equal, round(CASE WHEN f / fa + b / ba > 0 THEN f / fa / (f / fa + b / ba) END, 6) AS fire_share FROM r, t"""))
def fai_equal_panel(spark, sf):
    own = panel(spark, sf).withColumns({"f": S.ratio(F.col("fire_count"), F.col("pixels")), "b": S.ratio(F.col("burned_count"), F.col("pixels"))})
    own = own.crossJoin(F.broadcast(own.agg(F.max("f").alias("fm"), F.max("b").alias("bm"), F.avg("f").alias("fa"), F.avg("b").alias("ba"))))
    f, b = F.col("f") / F.col("fa"), F.col("b") / F.col("ba")
    return rounded(own.select("grid_uid", "year", "season", (0.5 * (F.col("f") / F.col("fm") + F.col("b") / F.col("bm"))).alias("fai_max"), (0.5 * (f + b)).alias("fai_equal"), S.ratio(f, f + b).alias("fire_share")))


# --- tests with p values ------------------------------------------------------------------------


def t_tail_sql(t: str, v: str) -> str:
    """SQL of the two-sided tail of Student's t: the same finite series, its terms from gamma functions."""
    c2 = f"({v} / ({v} + {t} * {t}))"
    odd = f"(atan(abs({t}) / sqrt({v})) + CASE WHEN {v} > 1 THEN sqrt(1 - {c2}) * sqrt({c2}) * list_sum(list_transform(range(0, CAST(({v} - 3) // 2 + 1 AS BIGINT)), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5)) * pow({c2}, k))) ELSE 0 END) * 2 / pi()"
    even = f"sqrt(1 - {c2}) * list_sum(list_transform(range(0, CAST(({v} - 2) // 2 + 1 AS BIGINT)), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow({c2}, k)))"
    return f"(CASE WHEN CAST({v} AS BIGINT) % 2 = 1 THEN 1 - {odd} ELSE 1 - {even} END)"


def _p_sql(r: str, v: str) -> str:
    return f"CASE WHEN abs({r}) >= 1 - 1e-12 THEN 0 ELSE greatest(0, {t_tail_sql(f'({r} * sqrt({v} / (1 - {r} * {r})))', v)}) END"


_YEARLY = """, y AS (SELECT country, season, year, CAST(sum(fire_count) AS DOUBLE) / sum(pixels) AS rate, avg(x1) AS x FROM panel GROUP BY ALL),
k AS (SELECT *, rank() OVER (PARTITION BY country, season ORDER BY round(rate, 12)) + (count(*) OVER (PARTITION BY country, season, round(rate, 12)) - 1) / 2.0 AS rr,
  rank() OVER (PARTITION BY country, season ORDER BY round(x, 12)) + (count(*) OVER (PARTITION BY country, season, round(x, 12)) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY country, season ORDER BY year) * 1.0 AS ry FROM y)
"""


def _yearly(spark, sf):
    return panel(spark, sf).groupBy("country", "season", "year").agg(S.ratio(F.sum("fire_count"), F.sum("pixels")).alias("rate"), F.avg("x1").alias("x"))


@query("spearman_p", sql("panel", _YEARLY.rstrip() + f""", c AS (SELECT country, season, count(*) AS n, corr(rr, rx) AS rho, CAST(count(*) - 2 AS DOUBLE) AS v FROM k GROUP BY country, season)
SELECT country, season, n, round(rho, 6) AS rho, round({_p_sql('rho', 'v')}, 6) AS p FROM c"""))
def spearman_p(spark, sf):
    own = R.spearman(_yearly(spark, sf), ["country", "season"], "rate", "x")
    return rounded(own.select("country", "season", "n", "rho", S.correlation_p(F.col("rho"), F.col("n") - 2).alias("p")))


@query("partial_spearman_p", sql("panel", _YEARLY.rstrip() + f""", c AS (SELECT country, season, count(*) AS n, corr(rr, rx) AS a, corr(rr, ry) AS b, corr(rx, ry) AS d, CAST(count(*) - 3 AS DOUBLE) AS v FROM k GROUP BY country, season), r AS (SELECT *, CASE WHEN (1 - b * b) * (1 - d * d) > 1e-12 THEN (a - b * d) / sqrt((1 - b * b) * (1 - d * d)) END AS rho FROM c)
SELECT country, season, n, round(rho, 6) AS rho, round({_p_sql('rho', 'v')}, 6) AS p FROM r"""))
def partial_spearman_p(spark, sf):
    own = R.partial_spearman(_yearly(spark, sf), ["country", "season"], "rate", "x", "year")
    return rounded(own.select("country", "season", "n", "rho", S.correlation_p(F.col("rho"), F.col("n") - 3).alias("p")))


_EXPOSURE = f"""SELECT season, measure, count(*) AS n, corr(rv, re) AS rho, CAST(count(*) - 2 AS DOUBLE) AS v FROM (
  SELECT season, measure, rank() OVER (PARTITION BY season, measure ORDER BY v) + (count(*) OVER (PARTITION BY season, measure, v) - 1) / 2.0 AS rv, rank() OVER (PARTITION BY season, measure ORDER BY e) + (count(*) OVER (PARTITION BY season, measure, e) - 1) / 2.0 AS re FROM (
    SELECT unnest([CAST(season AS VARCHAR), 'all']) AS season, measure, v, e FROM (SELECT season, 'count' AS measure, CAST(fire_count AS DOUBLE) AS v, pixels AS e FROM g UNION ALL SELECT season, 'rate', round(CAST(fire_count AS DOUBLE) / pixels, 12), pixels FROM g)))
GROUP BY season, measure"""


@query("exposure_association", sql("panel", f""", g AS (SELECT season, grid_uid, sum(fire_count) AS fire_count, sum(pixels) AS pixels FROM panel GROUP BY ALL), c AS ({_EXPOSURE})
SELECT season, measure, n, round(rho, 6) AS rho, round({_p_sql('rho', 'v')}, 6) AS p FROM c"""))
def exposure_association(spark, sf):
    own = panel(spark, sf).groupBy("season", "grid_uid").agg(F.sum("fire_count").alias("fire_count"), F.sum("pixels").alias("e"))
    value = F.when(F.col("measure") == "count", F.col("fire_count").cast("double")).otherwise(S.ratio(F.col("fire_count"), F.col("e")))
    own = own.select("season", "e", "fire_count", F.explode(F.array(F.lit("count"), F.lit("rate"))).alias("measure")).withColumn("v", value)
    own = own.select(F.explode(F.array(F.col("season").cast("string"), F.lit("all"))).alias("season"), "measure", "e", "v")
    out = R.spearman(own, ["season", "measure"], "v", "e")
    return rounded(out.select("season", "measure", "n", "rho", S.correlation_p(F.col("rho"), F.col("n") - 2).alias("p")))


@query("fai_association", sql("panel", """, r AS (SELECT season, country, CAST(fire_count AS DOUBLE) / pixels AS f, CAST(burned_count AS DOUBLE) / pixels AS b FROM panel), t AS (SELECT max(f) AS fm, max(b) AS bm FROM r), i AS (SELECT season, country, round(f, 12) AS f, round(0.5 * (f / fm + b / bm), 12) AS a FROM r, t),
k AS (SELECT season, country, rank() OVER (PARTITION BY season, country ORDER BY f) + (count(*) OVER (PARTITION BY season, country, f) - 1) / 2.0 AS rf, rank() OVER (PARTITION BY season, country ORDER BY a) + (count(*) OVER (PARTITION BY season, country, a) - 1) / 2.0 AS ra FROM i)
SELECT season, country, count(*) AS n, round(corr(rf, ra), 6) AS rho FROM k GROUP BY season, country"""))
def fai_association(spark, sf):
    own = panel(spark, sf).withColumns({"f": S.ratio(F.col("fire_count"), F.col("pixels")), "b": S.ratio(F.col("burned_count"), F.col("pixels"))})
    own = own.crossJoin(F.broadcast(own.agg(F.max("f").alias("fm"), F.max("b").alias("bm")))).withColumn("fai", 0.5 * (F.col("f") / F.col("fm") + F.col("b") / F.col("bm")))
    return rounded(R.spearman(own, ["season", "country"], "f", "fai").select("season", "country", "n", "rho"))


@query("kendall_excluding_peaks", sql("ev", """, s AS (SELECT country, year, count(*) AS n FROM ev GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY n DESC, year) AS place FROM s),
v AS (SELECT country, 'all' AS period, year, n FROM k UNION ALL SELECT country, 'without peaks', year, n FROM k WHERE place > 2),
q AS (SELECT a.country, a.period, sum(sign(b.n - a.n)) AS s FROM v a JOIN v b ON a.country = b.country AND a.period = b.period AND a.year < b.year GROUP BY ALL),
t AS (SELECT country, period, sum(m) AS n, sum(m * (m - 1) / 2.0) AS tp, sum(m * (m - 1) * (2 * m + 5)) AS tv FROM (SELECT country, period, n AS x, count(*) AS m FROM v GROUP BY ALL) GROUP BY ALL)
SELECT country, period, CAST(t.n AS BIGINT) AS n, round(s / sqrt(t.n * (t.n - 1) / 2.0 * (t.n * (t.n - 1) / 2.0 - tp)), 6) AS tau_b, round(s / sqrt((t.n * (t.n - 1) * (2 * t.n + 5) - tv) / 18.0), 6) AS z FROM q JOIN t USING (country, period)"""))
def kendall_excluding_peaks(spark, sf):
    own = ev(spark, sf).groupBy("country", "year").agg(F.count("*").alias("n"))
    ranked = A.top_rows(own, ["country"], [F.desc("n"), F.asc("year")], 2).select("country", "year")
    both = own.withColumn("period", F.lit("all")).unionByName(own.join(ranked, ["country", "year"], "left_anti").withColumn("period", F.lit("without peaks")))
    return rounded(T.kendall(both.withColumn("v", F.col("n").cast("double")).drop("n"), ["country", "period"], "year", "v").select("country", "period", F.col("n").cast("long"), "tau_b", "z"))


@query("kendall_exact", "WITH RECURSIVE " + sql("panel", """, v AS (SELECT country, season, year, round(avg(x4), 9) AS y FROM panel GROUP BY ALL),
q AS (SELECT a.country, a.season, sum(sign(b.y - a.y)) AS s FROM v a JOIN v b ON a.country = b.country AND a.season = b.season AND a.year < b.year GROUP BY ALL), c AS (SELECT country, season, count(*) AS n FROM v GROUP BY ALL),
m(k, d) AS (SELECT 1, [CAST(1 AS DOUBLE)] UNION ALL SELECT k + 1, list_transform(range(0, len(d) + k), lambda j: list_sum(d[greatest(1, j - k + 1) : least(len(d), j + 1)]) / (k + 1)) FROM m WHERE k < 33)
SELECT country, season, CAST(n AS INTEGER) AS n, CAST(s AS DOUBLE) AS s, round(s / (n * (n - 1) / 2.0), 6) AS tau_b, round(least(1, 2 * list_sum(d[1 : CAST((n * (n - 1) / 2.0 - abs(s)) / 2 + 1 AS BIGINT)])), 6) AS p, true AS exact FROM q JOIN c USING (country, season) JOIN m ON k = n""")[5:])
def kendall_exact(spark, sf):
    own = panel(spark, sf).groupBy("country", "season", "year").agg(F.round(F.avg("x4"), 9).alias("y"))
    return rounded(T.kendall_small(own, ["country", "season"], "year", "y"))
