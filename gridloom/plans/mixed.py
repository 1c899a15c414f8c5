"""Queries: mixed models of the panel by season, and effects along their paths."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import effects as E
from gridloom.operators import mixed as M
from gridloom.operators import panel as P
from gridloom.plans.descriptive import rounded
from gridloom.plans.relations import panel, sql
from gridloom.sources.scratch import checkpointed

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


_COUNTRIES = ["AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_CONTROLS = [*(f"is_{c.lower().replace(' ', '_')}" for c in _COUNTRIES), "year_z"]


def scores(spark, sf):
    """Four scores of the panel within its season (meteorology, vegetation, topography, people), controls, response and log exposure. The panel is stored, as fits read it again and again."""
    own = checkpointed(panel(spark, sf))
    scaled = P.zscore(own.withColumns({"year_d": F.col("year").cast("double"), "x5": F.col("x5").cast("double")}), ["season"], ["x1", "x3", "x4", "x5", "year_d"], population=True)
    flags = {n: (F.col("country") == c).cast("double") for n, c in zip(_CONTROLS, _COUNTRIES, strict=False)}
    return scaled.withColumns(flags).select(
        "season", "grid_uid", "year", *flags, F.col("year_d_z").alias("year_z"), F.col("x1_z").alias("meteorology"), F.col("x3_z").alias("vegetation"), F.col("x5_z").alias("topography"), F.col("x4_z").alias("people"),
        (F.col("fire_count") + 0.5 * F.col("burned_count")).alias("activity"), F.ln(F.col("pixels").cast("double")).alias("log_pixels"),
    )


_MEDIATORS = {"meteorology": ["topography", *_CONTROLS], "vegetation": ["meteorology", "topography", "people", *_CONTROLS]}
_OUTCOME = ["meteorology", "vegetation", "topography", "people", *_CONTROLS]


def _mediators(own):
    return {y: M.gaussian(own, "season", "grid_uid", "year", x, y) for y, x in _MEDIATORS.items()}


def _outcome(own):
    return M.tweedie(own, "season", "grid_uid", "year", _OUTCOME, "activity", "log_pixels")


@query("mixed_mediators")
def mixed_mediators(spark, sf):
    """The two mediators of each season by maximum likelihood, with intercepts of unit and year."""
    found = _mediators(scores(spark, sf))
    out = None
    for y, fits in found.items():
        part = M.fixed_table(spark, fits).withColumn("response", F.lit(y))
        out = part if out is None else out.unionByName(part)
    return rounded(out, 4)


@query("mixed_tweedie")
def mixed_tweedie(spark, sf):
    """The activity of each season: Tweedie with log link, offset of the log exposure, intercepts of unit and year."""
    return rounded(M.fixed_table(spark, _outcome(scores(spark, sf))), 4)


@query("path_effects")
def path_effects(spark, sf):
    """Effects of topography on the activity by each route of a season's three equations, drawn from their covariances."""
    own = scores(spark, sf)
    fits = {**_mediators(own), "activity": _outcome(own)}
    rows = [(f.system, y, f.names, f.estimate, f.covariance) for y, fs in fits.items() for f in fs]
    routes = {
        "topography>activity": [("activity", "topography")],
        "topography>meteorology>activity": [("meteorology", "topography"), ("activity", "meteorology")],
        "topography>vegetation>activity": [("vegetation", "topography"), ("activity", "vegetation")],
        "topography>meteorology>vegetation>activity": [("meteorology", "topography"), ("vegetation", "meteorology"), ("activity", "vegetation")],
    }
    used = {step for steps in routes.values() for step in steps}
    on_routes = E.coefficient_rows(spark, rows).where(F.concat_ws(">", "equation", "term").isin([f"{e}>{t}" for e, t in used]))
    found = E.along(E.drawn(on_routes, 5000), routes)
    return rounded(E.summary(E.with_totals(found, ["topography>activity"])), 4)


_GLS = """, base AS (SELECT season, grid_uid, x1 AS x, x3 AS y FROM panel),
whole AS (SELECT season, count(*) AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM base GROUP BY season),
unit AS (SELECT season, grid_uid, 0.5 / (1 + 0.5 * count(*)) AS w, count(*) AS n, sum(x) AS x, sum(y) AS y FROM base GROUP BY ALL),
gone AS (SELECT season, sum(w * n * n) AS n, sum(w * n * x) AS x, sum(w * n * y) AS y, sum(w * x * x) AS xx, sum(w * x * y) AS xy, sum(w * y * y) AS yy FROM unit GROUP BY season),
c AS (SELECT season, w.n AS rows, w.n - g.n AS n, w.x - g.x AS x, w.y - g.y AS y, w.xx - g.xx AS xx, w.xy - g.xy AS xy, w.yy - g.yy AS yy FROM whole w JOIN gone g USING (season)),
b AS (SELECT *, n * xx - x * x AS det, (xx * y - x * xy) / (n * xx - x * x) AS b0, (n * xy - x * y) / (n * xx - x * x) AS b1 FROM c),
v AS (SELECT *, (yy - b0 * y - b1 * xy) / rows AS s2 FROM b)
SELECT CAST(season AS VARCHAR) AS system, term, round(estimate, 6) AS estimate, round(se, 6) AS se, round(s2, 8) AS variance FROM (
  SELECT season, '(intercept)' AS term, b0 AS estimate, sqrt(s2 * xx / det) AS se, s2 FROM v UNION ALL SELECT season, 'x1', b1, sqrt(s2 * n / det), s2 FROM v)"""


@query("mixed_given_ratio", sql("panel", _GLS))
def mixed_given_ratio(spark, sf):
    """x3 on x1 by season at half the residual's variance for units: the mixed-model equations with units eliminated."""
    found = M.moments(panel(spark, sf), "season", "grid_uid", "year", ["x1"], "x3")
    own = M.given_ratios(spark, found, ["x1"], 0.5)
    return own.select("system", "term", F.round("estimate", 6).alias("estimate"), F.round("se", 6).alias("se"), F.round("variance", 8).alias("variance"))


_U = lambda part: f"((CAST(('0x' || substr(md5(concat_ws('|', '2026', system, equation, '0', CAST(draw AS VARCHAR), '{part}')), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)"


@query("simple_effect_draws", sql("panel", f""", eq AS (
  SELECT CAST(season AS VARCHAR) AS system, 'x2' AS equation, regr_slope(x2, x1) AS b, sqrt((regr_syy(x2, x1) - regr_slope(x2, x1) * regr_sxy(x2, x1)) / (count(*) - 2) / regr_sxx(x2, x1)) AS se FROM panel GROUP BY season
  UNION ALL SELECT CAST(season AS VARCHAR), 'x3', regr_slope(x3, x2), sqrt((regr_syy(x3, x2) - regr_slope(x3, x2) * regr_sxy(x3, x2)) / (count(*) - 2) / regr_sxx(x3, x2)) FROM panel GROUP BY season),
d AS (SELECT system, equation, draw, CASE WHEN draw = 0 THEN b ELSE b + se * sqrt(-2 * ln({_U('r')})) * cos(2 * pi() * {_U('a')}) END AS value FROM eq, range(0, 401) AS r(draw)),
e AS (SELECT a.system, 'x1>x2>x3' AS route, a.draw, a.value * b.value AS effect FROM d a JOIN d b ON a.system = b.system AND a.draw = b.draw AND a.equation = 'x2' AND b.equation = 'x3')
SELECT system, route, round(max(effect) FILTER (WHERE draw = 0), 8) AS estimate, round(avg(effect) FILTER (WHERE draw > 0), 8) AS mean, round(stddev_samp(effect) FILTER (WHERE draw > 0), 8) AS sd,
  round(quantile_cont(effect, 0.025) FILTER (WHERE draw > 0), 8) AS low, round(quantile_cont(effect, 0.5) FILTER (WHERE draw > 0), 8) AS median, round(quantile_cont(effect, 0.975) FILTER (WHERE draw > 0), 8) AS high,
  round(least(1.0, 2.0 * (least(count_if(draw > 0 AND effect <= 0), count_if(draw > 0 AND effect >= 0)) + 1) / 401.0), 8) AS p, round(exp(max(effect) FILTER (WHERE draw = 0)), 8) AS response_ratio, count_if(draw > 0) AS draws
FROM e GROUP BY system, route"""))
def simple_effect_draws(spark, sf):
    """The indirect effect of x1 on x3 through x2 in each season, from two simple regressions and 400 draws."""
    own = panel(spark, sf)
    rows = []
    for y, x in (("x2", "x1"), ("x3", "x2")):
        parts = [F.regr_slope(y, x).alias("b"), F.regr_syy(y, x).alias("yy"), F.regr_sxy(y, x).alias("xy"), F.regr_sxx(y, x).alias("xx"), F.count("*").alias("n")]
        for r in own.groupBy("season").agg(*parts).orderBy("season").collect():
            rows.append((str(r["season"]), y, [x], [r["b"]], np.array([[(r["yy"] - r["b"] * r["xy"]) / (r["n"] - 2) / r["xx"]]])))
    found = E.summary(E.along(E.drawn(E.coefficient_rows(spark, rows), 400), {"x1>x2>x3": [("x2", "x1"), ("x3", "x2")]}))
    return rounded(found, 8)
