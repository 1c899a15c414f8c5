"""Queries: forests explained out of fold, their summaries and curves, and the baseline forest."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.operators import forests as T
from gridloom.plans.descriptive import rounded
from gridloom.plans.relations import panel, sql

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


_X = ["x1", "x2", "x3", "x4", "pixels"]
_GROUPS = {"prices": ["x2", "x3", "x4"], "amounts": ["x1", "pixels"]}


def _oof(spark, sf):
    own = panel(spark, sf).withColumn("fold", F.col("year") % 3)
    return T.explain_oof(own, _X, "fire_count", "fold", ["grid_uid", "year", "season"], trees=20, depth=5)


@query("oof_attributions")
def oof_attributions(spark, sf):
    """Shapley values of the hurdle forest's two stages for every row, by forests that did not see it."""
    own = _oof(spark, sf)
    cells = {f: F.round(F.get("phi", i), 6).alias(f"phi_{f}") for i, f in enumerate(_X)}
    return own.select("stage", "fold", "grid_uid", "year", "season", *cells.values(), F.round("base", 6).alias("base"), F.round("predicted", 6).alias("predicted"))


@query("attribution_summary")
def attribution_summary(spark, sf):
    return rounded(T.value_summary(T.long_form(_oof(spark, sf), _X, ["stage"]), ["stage"]))


@query("attribution_groups")
def attribution_groups(spark, sf):
    return rounded(T.group_summary(_oof(spark, sf), _X, _GROUPS, ["stage"]))


@query("attribution_consensus")
def attribution_consensus(spark, sf):
    """Features ranked by the geometric mean of their size in both stages, with the shape of their curves."""
    cells = T.long_form(_oof(spark, sf), _X, ["stage"])
    shape = T.curve_metrics(T.binned(cells, ["stage"], 8), ["stage"])
    size = cells.groupBy("stage", "feature").agg(F.avg(F.abs("phi")).alias("score")).withColumn("all", F.lit("all"))
    ranks = T.consensus(size, ["all"], "stage", "score").drop("all")
    return rounded(shape.join(ranks, "feature"))


@query("forest_baseline")
def forest_baseline(spark, sf):
    """The plain forest out of fold: rows, error and squared error by season, to compare the hurdle with."""
    own = T.forest_oof(panel(spark, sf).withColumn("fold", F.col("year") % 3), _X, "fire_count", "fold", trees=30, depth=6)
    miss = F.col("predicted") - F.col("fire_count")
    return rounded(own.groupBy("season").agg(F.count("*").alias("n"), F.avg(F.abs(miss)).alias("mae"), F.sqrt(F.avg(miss * miss)).alias("rmse"), F.avg(miss).alias("bias")))


@query("hurdle_importance")
def hurdle_importance(spark, sf):
    """Permutation importance of single columns and groups for the hurdle of forests, on rows that it did not see."""
    own = panel(spark, sf).withColumn("fold", F.col("year") % 2)
    return rounded(T.hurdle_importance(own, _X, {"x1": ["x1"], "pixels": ["pixels"], **_GROUPS}, "fire_count", "fold", repeats=2, trees=15, depth=5))


_CELLS = """, rate AS (SELECT season, CAST(pixels AS DOUBLE) AS px, CAST(x5 AS DOUBLE) AS x5, CAST(fire_count AS DOUBLE) / pixels AS r FROM panel),
base AS (SELECT season, px, x5, round(r - avg(r) OVER (PARTITION BY season), 9) AS phi FROM rate),
cells AS (SELECT season, 'pixels' AS feature, px AS x, phi FROM base UNION ALL SELECT season, 'x5', x5, phi FROM base)"""


def _cells(spark, sf):
    """The deviation of the rate from its season's mean beside two features: a response that SQL can repeat."""
    own = panel(spark, sf).withColumn("r", F.col("fire_count").cast("double") / F.col("pixels"))
    own = own.withColumn("phi", F.round(F.col("r") - F.avg("r").over(Window.partitionBy("season")), 9))
    rows = own.select("season", F.array(F.col("pixels").cast("double"), F.col("x5").cast("double")).alias("x"), F.array("phi", "phi").alias("phi"))
    return T.long_form(rows, ["pixels", "x5"], ["season"])


@query("response_summary", sql("panel", _CELLS + """,
k AS (SELECT *, rank() OVER (PARTITION BY season, feature ORDER BY x) + (count(*) OVER (PARTITION BY season, feature, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY season, feature ORDER BY phi) + (count(*) OVER (PARTITION BY season, feature, phi) - 1) / 2.0 AS rp FROM cells),
c AS (SELECT season, feature, quantile_cont(x, 0.2) AS lo, quantile_cont(x, 0.8) AS hi FROM cells GROUP BY ALL),
s AS (SELECT season, feature, count(*) AS n, avg(abs(phi)) AS mean_abs, avg(phi) AS mean, stddev_samp(phi) AS sd, avg(CASE WHEN phi > 0 THEN 1.0 ELSE 0.0 END) AS positive, median(abs(phi)) AS median_abs,
  avg(phi) FILTER (WHERE x <= lo) AS low_mean, avg(phi) FILTER (WHERE x >= hi) AS high_mean, corr(rx, rp) AS rho FROM k JOIN c USING (season, feature) GROUP BY ALL)
SELECT season, feature, n, round(mean_abs, 6) AS mean_abs, round(mean, 6) AS mean, round(sd, 6) AS sd, round(positive, 6) AS positive, round(median_abs, 6) AS median_abs, round(lo, 6) AS lo, round(hi, 6) AS hi,
  round(low_mean, 6) AS low_mean, round(high_mean, 6) AS high_mean, round(rho, 6) AS rho, round(high_mean - low_mean, 6) AS contrast,
  CASE WHEN rho IS NULL THEN 'undetermined' WHEN abs(rho) < 0.1 THEN 'non-monotonic' WHEN rho > 0 AND high_mean - low_mean > 0 THEN 'positive' WHEN rho < 0 AND high_mean - low_mean < 0 THEN 'negative' ELSE 'mixed' END AS direction,
  CAST(rank() OVER (PARTITION BY season ORDER BY round(mean_abs, 9) DESC) AS INTEGER) AS rank FROM s JOIN c USING (season, feature)"""))
def response_summary(spark, sf):
    found = T.value_summary(_cells(spark, sf), ["season"])
    again = F.rank().over(Window.partitionBy("season").orderBy(F.desc(F.round("mean_abs", 9))))  # equal sizes of both features, whatever the order of adding
    cuts = T.exact_quantiles(_cells(spark, sf), ["season", "feature"], "x", [0.2, 0.8]).select("season", "feature", F.get("quantiles", 0).alias("lo"), F.get("quantiles", 1).alias("hi"))
    return rounded(found.withColumn("rank", again).join(cuts, ["season", "feature"]))


@query("response_curves", sql("panel", _CELLS + """,
q AS (SELECT season, feature, list_distinct(quantile_cont(x, [0.2, 0.4, 0.6, 0.8])) AS cuts FROM cells GROUP BY ALL),
b AS (SELECT season, feature, 1 + (SELECT count(*) FROM unnest(cuts) AS t(cut) WHERE cut < x) AS bin, x, phi FROM cells JOIN q USING (season, feature)),
m AS (SELECT season, feature, bin, round(avg(phi), 9) AS phi, quantile_cont(phi, 0.75) - quantile_cont(phi, 0.25) AS iqr FROM b GROUP BY ALL),
d AS (SELECT *, phi - lag(phi) OVER w AS step, CASE WHEN sign(phi) <> sign(lag(phi) OVER w) AND phi <> 0 THEN 1 ELSE 0 END AS crossed, row_number() OVER w AS rb, rank() OVER (PARTITION BY season, feature ORDER BY phi) AS rp FROM m WINDOW w AS (PARTITION BY season, feature ORDER BY bin)),
u AS (SELECT season, feature, count(*) AS bins, max(phi) - min(phi) AS amplitude, avg(iqr) AS iqr, sum(CASE WHEN step > 0 THEN step ELSE 0 END) AS up, sum(CASE WHEN step < 0 THEN -step ELSE 0 END) AS down, sum(crossed) AS crossings, corr(rb, rp) AS rho FROM d GROUP BY ALL)
SELECT season, feature, bins, round(amplitude, 6) AS amplitude, round(greatest(up, down) / nullif(up + down, 0), 6) AS monotone, CAST(crossings AS BIGINT) AS crossings, round(rho, 6) AS rho, round(amplitude / nullif(iqr, 0), 6) AS amplitude_by_iqr FROM u"""))
def response_curves(spark, sf):
    curve = T.binned(_cells(spark, sf), ["season"], 5).withColumn("phi", F.round("phi", 9))
    return rounded(T.curve_metrics(curve, ["season"]))
