"""Queries: out-of-fold metrics, rankings, calibration, resampling and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import scalar as S
from gridloom.operators import metrics as M
from gridloom.operators.order import exact_quantiles
from gridloom.plans.descriptive import rounded
from gridloom.plans.relations import oof, panel, sql

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


_Q = "least(1 - 1e-6, greatest(1e-6, p))"
_O = "CAST(observed > 0 AS INT)"
_METRICS = f"""count(predicted - observed) AS n, round(sqrt(avg(pow(predicted - observed, 2))), 6) AS rmse, round(avg(abs(predicted - observed)), 6) AS mae, round(median(abs(predicted - observed)), 6) AS median_ae, round(avg(predicted - observed), 6) AS bias,
 round(CASE WHEN var_pop(observed) * count(*) > 1e-12 THEN 1 - sum(pow(predicted - observed, 2)) / (var_pop(observed) * count(*)) END, 6) AS r2, CAST(sum(observed) AS BIGINT) AS total_observed, round(sum(predicted), 6) AS total_predicted, round(CASE WHEN sum(observed) > 0 THEN sum(predicted) / sum(observed) END, 6) AS total_ratio,
 round(avg(pow(p - {_O}, 2)), 6) AS brier, round(var_pop({_O}), 6) AS brier_null, round(CASE WHEN var_pop({_O}) > 0 THEN 1 - avg(pow(p - {_O}, 2)) / var_pop({_O}) END, 6) AS brier_skill, round(-avg({_O} * ln({_Q}) + (1 - {_O}) * ln(1 - {_Q})), 6) AS log_loss"""


@query("temporal_fold_oof", sql("oof", "SELECT model, grid_uid, year, season, fold, exposure, observed, round(predicted, 6) AS predicted, round(p, 6) AS p FROM oof"))
def temporal_fold_oof(spark, sf):
    return rounded(oof(spark, sf).select("model", "grid_uid", "year", "season", "fold", "exposure", "observed", "predicted", "p"))


@query("metric_overall", sql("oof", f"SELECT model, season, {_METRICS} FROM oof GROUP BY ALL"))
def metric_overall(spark, sf):
    return rounded(M.metric_rows(oof(spark, sf), ["model", "season"]))


@query("metric_fold", sql("oof", f"SELECT model, season, fold, {_METRICS} FROM oof GROUP BY ALL"))
def metric_fold(spark, sf):
    return rounded(M.metric_rows(oof(spark, sf), ["model", "season", "fold"]))


@query("metric_subgroup", sql("oof", f"SELECT model, season, country, {_METRICS} FROM oof GROUP BY ALL"))
def metric_subgroup(spark, sf):
    return rounded(M.metric_rows(oof(spark, sf), ["model", "season", "country"]))


@query("fold_summary", sql("oof", """, f AS (SELECT model, season, fold, sqrt(avg(pow(predicted - observed, 2))) AS rmse, avg(abs(predicted - observed)) AS mae FROM oof GROUP BY ALL), l AS (SELECT model, season, 'rmse' AS metric, rmse AS v FROM f UNION ALL SELECT model, season, 'mae', mae FROM f)
SELECT model, season, metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(stddev_samp(v) / sqrt(count(v)), 6) AS se, count(v) AS n_folds FROM l GROUP BY ALL"""))
def fold_summary(spark, sf):
    return rounded(M.fold_summary(M.metric_rows(oof(spark, sf), ["model", "season", "fold"]), ["model", "season"], ["rmse", "mae"]))


@query("roc_auc", sql("oof", """, c AS (SELECT model, season, round(p, 9) AS p, count_if(observed > 0) AS pos, count_if(observed = 0) AS neg FROM oof GROUP BY ALL), b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model, season ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT model, season, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS auc FROM b GROUP BY ALL"""))
def roc_auc(spark, sf):
    return rounded(M.roc_auc(oof(spark, sf).withColumn("p", F.round("p", 9)), ["model", "season"], "p", F.col("observed") > 0))


@query("pr_auc", sql("oof", """, c AS (SELECT model, season, round(p, 9) AS p, count_if(observed > 0) AS pos, count_if(observed = 0) AS neg FROM oof GROUP BY ALL), b AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM c WINDOW w AS (PARTITION BY model, season ORDER BY p DESC ROWS UNBOUNDED PRECEDING))
SELECT model, season, CAST(sum(pos) AS BIGINT) AS n_pos, round(sum(CAST(pos AS DOUBLE) * tp / (tp + fp)) / sum(pos), 6) AS average_precision FROM b GROUP BY ALL"""))
def pr_auc(spark, sf):
    return rounded(M.average_precision(oof(spark, sf).withColumn("p", F.round("p", 9)), ["model", "season"], "p", F.col("observed") > 0))


_BINS = """, o AS (SELECT model, season, observed, round(p, 9) AS p FROM oof), c AS (SELECT model, season, list_distinct(quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS cuts FROM o GROUP BY ALL),
b AS (SELECT model, season, observed, p, CAST(len(list_filter(cuts, lambda c: c < p)) + 1 AS INT) AS bin FROM o JOIN c USING (model, season)),
g AS (SELECT model, season, bin, count(*) AS n, min(p) AS p_min, avg(p) AS p_mean, max(p) AS p_max, avg(CAST(observed > 0 AS INT)) AS observed_share FROM b GROUP BY ALL)
"""


@query("calibration_bins", sql("oof", _BINS + "SELECT model, season, bin, n, round(p_min, 6) AS p_min, round(p_mean, 6) AS p_mean, round(p_max, 6) AS p_max, round(observed_share, 6) AS observed_share, round(observed_share - p_mean, 6) AS gap FROM g"))
def calibration_bins(spark, sf):
    return rounded(M.calibration(oof(spark, sf).withColumn("p", F.round("p", 9)), ["model", "season"]))


@query("expected_calibration_error", sql("oof", _BINS + "SELECT model, season, round(sum(n * abs(observed_share - p_mean)) / sum(n), 6) AS ece FROM g GROUP BY ALL"))
def expected_calibration_error(spark, sf):
    return rounded(M.expected_error(M.calibration(oof(spark, sf).withColumn("p", F.round("p", 9)), ["model", "season"]), ["model", "season"]))


@query("extreme_metrics", sql("oof", """, c AS (SELECT model, season, quantile_cont(CAST(observed AS DOUBLE), 0.9) AS threshold FROM oof WHERE observed > 0 GROUP BY ALL)
SELECT model, season, round(any_value(threshold), 6) AS threshold, count(*) AS n, round(sqrt(avg(pow(predicted - observed, 2))), 6) AS rmse, round(avg(abs(predicted - observed)), 6) AS mae, round(avg(predicted - observed), 6) AS bias, round(sum(predicted) / sum(observed), 6) AS total_ratio FROM oof JOIN c USING (model, season) WHERE observed >= threshold GROUP BY ALL"""))
def extreme_metrics(spark, sf):
    return rounded(M.extremes(oof(spark, sf), ["model", "season"]))


_ANNUAL = """, a AS (SELECT model, season, year, CAST(sum(observed) AS BIGINT) AS observed, sum(predicted) AS predicted, CAST(sum(exposure) AS BIGINT) AS exposure, sum(p) AS expected_positive FROM oof GROUP BY ALL)
"""


def _annual(spark, sf):
    return oof(spark, sf).groupBy("model", "season", "year").agg(F.sum("observed").alias("observed"), F.sum("predicted").alias("predicted"), F.sum("exposure").alias("exposure"), F.sum("p").alias("expected_positive"))


@query("annual_series", sql("oof", _ANNUAL + "SELECT model, season, year, observed, round(predicted, 6) AS predicted, exposure, round(expected_positive, 6) AS expected_positive, round(CAST(observed AS DOUBLE) / exposure, 6) AS observed_rate, round(predicted / exposure, 6) AS predicted_rate FROM a"))
def annual_series(spark, sf):
    return rounded(_annual(spark, sf).withColumns({"observed_rate": S.ratio(F.col("observed"), F.col("exposure")), "predicted_rate": S.ratio(F.col("predicted"), F.col("exposure"))}))


@query("annual_series_metrics", sql("oof", _ANNUAL.rstrip() + """, r AS (SELECT *, row_number() OVER (PARTITION BY model, season ORDER BY observed DESC, year) AS ry, row_number() OVER (PARTITION BY model, season ORDER BY predicted DESC, year) AS rf FROM (SELECT model, season, year, observed, round(predicted, 9) AS predicted FROM a))
SELECT model, season, round(sqrt(avg(pow(predicted - observed, 2))), 6) AS rmse, round(corr(observed, predicted), 6) AS pearson, round(regr_slope(predicted, year) - regr_slope(observed, year), 6) AS slope_difference, round(regr_slope(observed, predicted), 6) AS calibration_slope, round(regr_intercept(observed, predicted), 6) AS calibration_intercept, round(count_if(ry <= 3 AND rf <= 3) / 3.0, 6) AS overlap FROM r GROUP BY ALL"""))
def annual_series_metrics(spark, sf):
    own = _annual(spark, sf).withColumn("predicted", F.round("predicted", 9))
    y, f = F.col("observed").cast("double"), F.col("predicted")
    out = own.groupBy("model", "season").agg(F.sqrt(F.avg((f - y) * (f - y))).alias("rmse"), S.correlation(y, f).alias("pearson"), (F.regr_slope(f, F.col("year")) - F.regr_slope(y, F.col("year"))).alias("slope_difference"), F.regr_slope(y, f).alias("calibration_slope"), F.regr_intercept(y, f).alias("calibration_intercept"))
    return rounded(out.join(M.top_overlap(own, ["model", "season"], 3, ["year"]), ["model", "season"]))


_RANKED = """, m AS (SELECT model, season, sqrt(avg(pow(predicted - observed, 2))) AS rmse, avg(abs(predicted - observed)) AS mae FROM oof GROUP BY ALL), l AS (SELECT model, season, 'rmse' AS metric, round(rmse, 9) AS v FROM m UNION ALL SELECT model, season, 'mae', round(mae, 9) FROM m),
r AS (SELECT *, rank() OVER (PARTITION BY season, metric ORDER BY v) AS rank_min, count(*) OVER (PARTITION BY season, metric, v) AS same FROM l)
"""


def _ranked(spark, sf):
    own = M.metric_rows(oof(spark, sf), ["model", "season"])
    long = own.select("model", "season", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.round(m, 9).alias("v")) for m in ("rmse", "mae")))))
    return M.ranks(long, ["season", "metric"], "v", F.lit(True))


@query("metric_ranks", sql("oof", _RANKED + "SELECT season, metric, model, round(v, 6) AS v, CAST(rank_min AS INT) AS rank_min, rank_min + (same - 1) / 2.0 AS rank_average FROM r"))
def metric_ranks(spark, sf):
    return rounded(_ranked(spark, sf).select("season", "metric", "model", "v", "rank_min", "rank_average"))


@query("rank_sum", sql("oof", _RANKED + "SELECT model, CAST(count_if(rank_min = 1) AS BIGINT) AS wins, sum(rank_min + (same - 1) / 2.0) AS rank_sum, count(rank_min) AS n_ranked FROM r GROUP BY model"))
def rank_sum(spark, sf):
    return M.wins(_ranked(spark, sf), ["model"])


@query("paired_percent_improvement", sql("oof", """, m AS (SELECT model, season, sqrt(avg(pow(predicted - observed, 2))) AS v FROM oof GROUP BY ALL)
SELECT a.season, a.model AS candidate, b.model AS reference, round(a.v, 6) AS candidate_value, round(b.v, 6) AS reference_value, round(a.v - b.v, 6) AS difference, round(CASE WHEN b.v <> 0 THEN 100 * (b.v - a.v) / abs(b.v) END, 6) AS improvement FROM m a JOIN m b ON a.season = b.season JOIN (VALUES ('grid', 'season'), ('country', 'season'), ('grid', 'country')) AS x(c, r) ON a.model = c AND b.model = r"""))
def paired_percent_improvement(spark, sf):
    own = M.metric_rows(oof(spark, sf), ["model", "season"])
    return rounded(M.paired(own, ["season"], "model", "rmse", [("grid", "season"), ("country", "season"), ("grid", "country")]))


@query("cluster_sufficient_stats", sql("oof", f"SELECT model, country, grid_uid, count(*) AS n, round(sum(-({_O} * ln({_Q}) + (1 - {_O}) * ln(1 - {_Q}))), 6) AS nll, round(sum(pow(p - {_O}, 2)), 6) AS brier, round(sum(pow(predicted - observed, 2)), 6) AS se, round(sum(abs(predicted - observed)), 6) AS ae, CAST(sum(observed) AS BIGINT) AS observed, round(sum(predicted), 6) AS predicted FROM oof GROUP BY ALL"))
def cluster_sufficient_stats(spark, sf):
    return rounded(M.cluster_sums(oof(spark, sf), ["model", "country", "grid_uid"]))


_PAIRS = [("grid", "season"), ("country", "season"), ("grid", "country")]


@query("cluster_bootstrap_ci")
def cluster_bootstrap_ci(spark, sf):
    """Stratified by country: every metric of each pair of models."""
    draws = M.cluster_bootstrap(M.cluster_sums(oof(spark, sf), ["model", "country", "grid_uid"]), ["model"], ["country"], "grid_uid", 2000)
    long = draws.select("model", "draw", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in ("rmse", "mae", "brier", "log_loss", "bias")))))
    pairs = M.paired(long, ["draw", "metric"], "model", "v", _PAIRS)
    return rounded(M.percentile_interval(pairs, ["metric", "candidate", "reference"], "difference"))


@query("cluster_inflation")
def cluster_inflation(spark, sf):
    """Standard errors of whole clusters, drawn without strata, over those of independent rows."""
    own = oof(spark, sf)
    draws = M.cluster_bootstrap(M.cluster_sums(own, ["model", "country", "grid_uid"]), ["model"], [], "grid_uid", 2000)
    both = M.bootstrap_spread(draws, ["model"], ["rmse", "mae", "brier", "bias"]).join(M.independent_errors(own, ["model"]), ["model", "metric"])
    return rounded(both.withColumn("inflation", S.ratio(F.col("cluster_se"), F.col("row_se"))))


@query("independent_errors", sql("oof", """, e AS (SELECT model, pow(predicted - observed, 2) AS se, abs(predicted - observed) AS ae, pow(p - CAST(observed > 0 AS INT), 2) AS br, predicted - observed AS d FROM oof)
SELECT model, unnest(['rmse', 'mae', 'brier', 'bias']) AS metric, round(unnest([stddev_samp(se) / (2 * sqrt(avg(se)) * sqrt(count(*))), stddev_samp(ae) / sqrt(count(*)), stddev_samp(br) / sqrt(count(*)), stddev_samp(d) / sqrt(count(*))]), 6) AS row_se FROM e GROUP BY model"""))
def independent_errors(spark, sf):
    return rounded(M.independent_errors(oof(spark, sf), ["model"]))


@query("one_way_icc", sql("oof", """, x AS (SELECT season, grid_uid, observed - predicted AS r FROM oof WHERE model = 'country'), c AS (SELECT season, grid_uid, count(*) AS n, avg(r) AS m, var_pop(r) * count(*) AS w FROM x GROUP BY ALL),
g AS (SELECT season, count(*) AS k, sum(n) AS t, sum(n * n) AS n2, sum(w) AS ssw, sum(n * m * m) - pow(sum(n * m), 2) / sum(n) AS ssb FROM c GROUP BY season), h AS (SELECT *, ssb / (k - 1) AS msb, ssw / (t - k) AS msw, (t - CAST(n2 AS DOUBLE) / t) / (k - 1) AS n0 FROM g), i AS (SELECT *, (msb - msw) / (msb + (n0 - 1) * msw) AS r FROM h)
SELECT season, k AS clusters, CAST(t AS BIGINT) AS n, round(r, 6) AS icc, round(greatest(0.0, least(1.0, r)), 6) AS icc_cut, round(1 + (n0 - 1) * greatest(0.0, least(1.0, r)), 6) AS design_effect FROM i"""))
def one_way_icc(spark, sf):
    own = oof(spark, sf).where("model = 'country'").select("season", "grid_uid", (F.col("observed") - F.col("predicted")).alias("r"))
    return rounded(M.icc(own, ["season"], ["grid_uid"], "r"))


@query("lag1_autocorrelation", sql("oof", """, x AS (SELECT season, observed - predicted AS x, lag(observed - predicted) OVER w AS b, year - lag(year) OVER w AS step FROM oof WHERE model = 'country' WINDOW w AS (PARTITION BY season, grid_uid ORDER BY year)) SELECT season, count(*) AS n_pairs, round(corr(x, b), 6) AS pearson FROM x WHERE step = 1 GROUP BY season"""))
def lag1_autocorrelation(spark, sf):
    own = oof(spark, sf).where("model = 'country'").withColumn("r", F.col("observed") - F.col("predicted"))
    return rounded(M.lag_one(own, ["season"], ["grid_uid"], "year", "r"))


@query("grid_residual_summary", sql("oof", """, x AS (SELECT *, observed - predicted AS r FROM oof) SELECT model, grid_uid, season, count(*) AS n, count(DISTINCT year) AS n_years, min(year) AS first_year, max(year) AS last_year, CAST(sum(observed) AS BIGINT) AS observed, round(sum(predicted), 6) AS predicted, CAST(sum(exposure) AS BIGINT) AS exposure, round(sum(r), 6) AS residual_sum, round(avg(r), 6) AS residual_mean, round(median(r), 6) AS residual_median, round(stddev_samp(r), 6) AS residual_sd, round(avg(abs(r)), 6) AS mae, round(sqrt(avg(r * r)), 6) AS rmse, round(sum(r) / sum(exposure), 6) AS rate_residual FROM x GROUP BY ALL"""))
def grid_residual_summary(spark, sf):
    return rounded(M.unit_residuals(oof(spark, sf), ["model", "grid_uid", "season"]))


@query("nll_equivalence", sql("oof", f""", m AS (SELECT model, season, round(-avg({_O} * ln({_Q}) + (1 - {_O}) * ln(1 - {_Q})), 9) AS v FROM oof GROUP BY ALL), d AS (SELECT *, v - min(v) OVER (PARTITION BY season) AS delta, (v - min(v) OVER (PARTITION BY season)) <= 0.02 AND (v - min(v) OVER (PARTITION BY season)) <= 0.02 * abs(min(v) OVER (PARTITION BY season)) AS equivalent FROM m)
SELECT season, model, round(v, 6) AS log_loss, round(delta, 6) AS delta, equivalent, row_number() OVER (PARTITION BY season ORDER BY equivalent DESC, model) = 1 AS selected FROM d"""))
def nll_equivalence(spark, sf):
    own = M.metric_rows(oof(spark, sf), ["model", "season"]).select("season", "model", F.round("log_loss", 9).alias("log_loss"))
    return rounded(M.gates(own, ["season"], "log_loss", 0.02, 0.02, ["model"]))


@query("one_standard_error_rule", sql("oof", f""", f AS (SELECT model, season, fold, -avg({_O} * ln({_Q}) + (1 - {_O}) * ln(1 - {_Q})) AS v FROM oof GROUP BY ALL), d AS (SELECT a.season, a.model, a.v - b.v AS d FROM f a JOIN f b ON a.season = b.season AND a.fold = b.fold AND b.model = 'season' AND a.model <> 'season')
SELECT season, model, round(avg(d), 6) AS mean_difference, round(stddev_samp(d) / sqrt(count(d)), 6) AS se, round(max(d), 6) AS worst, CAST(count_if(d < 0) AS BIGINT) AS better_folds, count(d) AS n_folds, avg(d) <= stddev_samp(d) / sqrt(count(d)) AS non_inferior FROM d GROUP BY ALL"""))
def one_standard_error_rule(spark, sf):
    return rounded(M.one_standard_error(M.metric_rows(oof(spark, sf), ["model", "season", "fold"]), ["season"], "model", "fold", "log_loss", "season"))


@query("fai_q95_panel", sql("panel", """, q AS (SELECT quantile_cont(CAST(fire_count AS DOUBLE) / pixels, 0.95) FILTER (WHERE fire_count > 0) AS f, quantile_cont(CAST(burned_count AS DOUBLE) / pixels, 0.95) FILTER (WHERE burned_count > 0) AS b FROM panel)
SELECT grid_uid, year, season, round(0.5 * (CAST(fire_count AS DOUBLE) / pixels / f + CAST(burned_count AS DOUBLE) / pixels / b), 6) AS fai, fire_count + burned_count > 0 AS occurrence FROM panel, q"""))
def fai_q95_panel(spark, sf):
    own = panel(spark, sf).withColumns({"f": S.ratio(F.col("fire_count"), F.col("pixels")), "b": S.ratio(F.col("burned_count"), F.col("pixels"))})
    q95 = lambda c: exact_quantiles(own.where(F.col(c) > 0), [], c, [0.95]).select(F.get("quantiles", 0).alias(f"{c}q"))
    cut = q95("f").crossJoin(q95("b"))
    fai = 0.5 * (F.col("f") / F.col("fq") + F.col("b") / F.col("bq"))
    return rounded(own.crossJoin(F.broadcast(cut)).select("grid_uid", "year", "season", fai.alias("fai"), (F.col("fire_count") + F.col("burned_count") > 0).alias("occurrence")))


@query("threshold_retention", sql("panel", """SELECT threshold, season, count(*) AS n, CAST(count_if(pixels > threshold) AS BIGINT) AS kept, round(100.0 * count_if(pixels > threshold) / count(*), 6) AS kept_percent, round(sum(fire_count) FILTER (WHERE pixels > threshold) * 100.0 / sum(fire_count), 6) AS fire_percent FROM panel, (VALUES (20), (28), (35)) AS t(threshold) GROUP BY ALL"""))
def threshold_retention(spark, sf):
    own = panel(spark, sf).withColumn("threshold", F.explode(F.array(F.lit(20), F.lit(28), F.lit(35))))
    kept = F.col("pixels") > F.col("threshold")
    return rounded(own.groupBy("threshold", "season").agg(F.count("*").alias("n"), F.count_if(kept).alias("kept"), (100 * S.ratio(F.count_if(kept), F.count("*"))).alias("kept_percent"), (100 * S.ratio(F.sum(F.when(kept, F.col("fire_count"))), F.sum("fire_count"))).alias("fire_percent")))
