"""Queries: grids of configurations and rank sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import grids as G
from gridloom.operators import metrics as M
from gridloom.plans.descriptive import rounded
from gridloom.plans.evaluation import _O, _Q
from gridloom.plans.relations import oof, panel, sql

QUERIES, ORACLE_SQL = {}, {}
_OCCURRENCE = [G.Config("leaf5"), G.Config("leaf20", 20), G.Config("half_balanced", 20, "0.5", balanced=True)]
_SEVERITY = [G.Config("leaf3", 3, rows=0.8), G.Config("leaf10", 10, rows=0.8), G.Config("all3", 3, "all", 0.8)]
_JUDGES = ("rmse", "mae", "brier", "log_loss", "abs_bias")


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


@query("hurdle_grid")
def hurdle_grid(spark, sf):
    """Three configurations of either stage on three folds by year, their nine pairs, and the winner of each kind."""
    own = panel(spark, sf).withColumn("fold", F.col("year") % 3)
    found = G.grid_predictions(own, ["x1", "x2", "x3", "x4", "pixels"], "fire_count", "fold", _OCCURRENCE, _SEVERITY, trees=20, depth=5)
    out = G.winners(G.grid_metrics(found, "fire_count", "fold", _OCCURRENCE, _SEVERITY), _OCCURRENCE, _SEVERITY)
    return rounded(out.select("stage", "config", *(F.col("means")[m].alias(m) for m in ("brier", "log_loss", "rmse", "mae", "abs_bias", "auc", "average_precision", "spearman", "r2")), "rank_sum", "position", "winner"))


_KEYS = " UNION ALL ".join(f"SELECT season, model, '{m}' AS metric, round({m}, 12) AS v FROM s" for m in _JUDGES)


@query("model_rank_sums", sql("oof", f""", s AS (
  SELECT season, model, sqrt(avg(pow(predicted - observed, 2))) AS rmse, avg(abs(predicted - observed)) AS mae, avg(pow(p - {_O}, 2)) AS brier,
    -avg({_O} * ln({_Q}) + (1 - {_O}) * ln(1 - {_Q})) AS log_loss, abs(avg(predicted - observed)) AS abs_bias FROM oof GROUP BY ALL),
k AS ({_KEYS}),
r AS (SELECT season, model, rank() OVER (PARTITION BY season, metric ORDER BY v) + (count(*) OVER (PARTITION BY season, metric, v) - 1) / 2.0 AS place FROM k),
t AS (SELECT season, model, CAST(sum(place) AS DOUBLE) AS rank_sum FROM r GROUP BY ALL)
SELECT season, model, rank_sum, CAST(rank() OVER (PARTITION BY season ORDER BY rank_sum) AS INTEGER) AS position FROM t"""))
def model_rank_sums(spark, sf):
    """Models of each season by the sum of their ranks in five metrics."""
    e = F.col("predicted") - F.col("observed")
    o = (F.col("observed") > 0).cast("double")
    q = M.clip(F.col("p"), 1e-6, 1 - 1e-6)
    cells = [F.sqrt(F.avg(e * e)), F.avg(F.abs(e)), F.avg((F.col("p") - o) * (F.col("p") - o)), -F.avg(o * F.ln(q) + (1 - o) * F.ln(1 - q)), F.abs(F.avg(e))]
    wide = oof(spark, sf).groupBy("season", "model").agg(*(c.alias(n) for n, c in zip(_JUDGES, cells, strict=True)))
    long = wide.select("season", "model", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in _JUDGES))))
    return G.rank_sums(long, ["season"], "model", "metric", "value")
