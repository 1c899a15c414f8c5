"""Queries: exact multinomial resampling of clusters and the metrics that it is done for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalar import ratio
from gridloom.operators import metrics as M
from gridloom.operators import resampling as R
from gridloom.plans.descriptive import rounded
from gridloom.plans.relations import oof, sql

QUERIES, ORACLE_SQL = {}, {}
_DRAWS = 2000


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def _sums(spark, sf) -> DataFrame:
    """Sums of each model and grid; a stratum is a country and one of three blocks of grids."""
    own = oof(spark, sf).withColumns({"block": F.col("grid_uid") % 3, "severity": F.coalesce(ratio(F.col("predicted"), F.col("p")), "predicted")})
    return R.hurdle_sums(own, ["model", "country", "block", "grid_uid"])


@query("exact_bootstrap_checks", sql("oof", f"""
SELECT country, grid_uid % 3 AS block, count(DISTINCT grid_uid) AS clusters, {_DRAWS} AS draws, count(DISTINCT grid_uid) AS least, count(DISTINCT grid_uid) AS greatest
FROM oof WHERE exposure > 0 GROUP BY ALL"""))
def exact_bootstrap_checks(spark, sf):
    """Every draw of a stratum has as many clusters as the stratum."""
    return R.draw_checks(_sums(spark, sf), ["country", "block"], "grid_uid", _DRAWS).select("country", "block", "clusters", "draws", "least", "greatest")


@query("hurdle_cluster_metrics", sql("oof", """, e AS (
  SELECT model, exposure AS e, observed > 0 AS pos, predicted - observed AS d, CASE WHEN p > 0 THEN predicted / p ELSE predicted END - observed AS c, p - CAST(observed > 0 AS INT) AS b FROM oof)
SELECT model, round(sqrt(avg(pow(d / e, 2))), 6) AS rate_rmse, round(avg(abs(d / e)), 6) AS rate_mae, round(sqrt(avg(d * d)), 6) AS count_rmse, round(avg(abs(d)), 6) AS count_mae,
  round(avg(b * b), 6) AS brier, round(sqrt(avg(pow(c / e, 2)) FILTER (pos)), 6) AS positive_rate_rmse, round(avg(abs(c / e)) FILTER (pos), 6) AS positive_rate_mae,
  round(sqrt(avg(c * c) FILTER (pos)), 6) AS positive_count_rmse, round(avg(abs(c)) FILTER (pos), 6) AS positive_count_mae,
  round(abs(avg(d / e)), 6) AS rate_abs_bias, round(abs(avg(d)), 6) AS count_abs_bias, round(abs(avg(b)), 6) AS chance_abs_bias
FROM e GROUP BY model"""))
def hurdle_cluster_metrics(spark, sf):
    """The twelve metrics of each model from the sums of clusters."""
    whole = _sums(spark, sf).groupBy("model").agg(*(F.sum(c).alias(c) for c in R.SUMS))
    return rounded(R.hurdle_metrics(whole, ["model"]))


@query("exact_bootstrap_ci")
def exact_bootstrap_ci(spark, sf):
    """Percentile intervals of the differences of all twelve metrics between models, by exact draws within strata."""
    drawn = R.resampled(_sums(spark, sf), ["model"], ["country", "block"], "grid_uid", list(R.SUMS), _DRAWS)
    own = R.hurdle_metrics(drawn, ["model", "draw"])
    long = own.select("model", "draw", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in R.METRICS))))
    pairs = M.paired(long, ["draw", "metric"], "model", "v", [("grid", "season"), ("country", "season"), ("grid", "country")])
    return rounded(M.percentile_interval(pairs, ["metric", "candidate", "reference"], "difference"))
