"""Queries: activity curves, calendar windows, rank associations, space, models, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import scalar as S
from gridloom.operators import association as A
from gridloom.operators import calendar as C
from gridloom.operators import models as L
from gridloom.operators import smooth as SM
from gridloom.operators import spatial as X
from gridloom.operators import trend as T
from gridloom.plans.descriptive import rounded
from gridloom.plans.relations import doy, monthly, oof, panel, pts, sql
from gridloom.sources.tables import fill_missing, sentinel_null, table
from gridloom.streaming import windows as W

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


_FAI = """, fai AS (SELECT doy, 0.5 * (CAST(fire_count AS DOUBLE) / max(fire_count) OVER () + burned_area / max(burned_area) OVER ()) AS fai FROM doy),
sm AS (SELECT a.doy, any_value(a.fai) AS fai, round(avg(b.fai), 9) AS smooth FROM fai a JOIN fai b ON least(abs(a.doy - b.doy), 366 - abs(a.doy - b.doy)) <= 7 GROUP BY a.doy)
"""


def _fai(spark, sf):
    own = C.activity_index(doy(spark, sf), ["fire_count", "burned_area"]).select("doy", F.col("index").alias("fai"))
    return C.circular_smooth(own, "doy", "fai", 366, 7).withColumn("smooth", F.round("smooth", 9))


@query("fai_daily", sql("doy", _FAI + "SELECT doy, round(fai, 6) AS fai, round(smooth, 6) AS smooth FROM sm"))
def fai_daily(spark, sf):
    return rounded(_fai(spark, sf))


_PEAKS = _FAI.rstrip() + """, pk AS (SELECT a.doy, a.smooth FROM sm a JOIN sm b ON b.doy = a.doy % 366 + 1 JOIN sm c ON c.doy = (a.doy + 364) % 366 + 1 WHERE a.smooth > b.smooth AND a.smooth > c.smooth)
"""


@query("fai_local_peaks", sql("doy", _PEAKS + "SELECT doy, round(smooth, 6) AS smooth FROM pk"))
def fai_local_peaks(spark, sf):
    return rounded(C.local_peaks(_fai(spark, sf), "doy", "smooth", 366).select("doy", "smooth"))


@query("fai_separate_peaks", "WITH RECURSIVE " + sql("doy", _PEAKS.rstrip())[5:] + """, o AS (SELECT row_number() OVER (ORDER BY smooth DESC, doy) AS i, doy, smooth FROM pk),
g(i, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS INTEGER[]) UNION ALL SELECT o.i, CASE WHEN len(list_filter(kept, lambda d: least(abs(d - o.doy), 366 - abs(d - o.doy)) < 60)) = 0 THEN list_append(kept, o.doy) ELSE kept END FROM g JOIN o ON o.i = g.i + 1),
f AS (SELECT kept FROM g ORDER BY i DESC LIMIT 1), u AS (SELECT unnest(kept[1:3]) AS doy, unnest(range(1, len(kept[1:3]) + 1)) AS rank FROM f)
SELECT CAST(rank AS INTEGER) AS rank, doy, round(smooth, 6) AS smooth FROM u JOIN pk USING (doy)""")
def fai_separate_peaks(spark, sf):
    peaks = C.local_peaks(_fai(spark, sf), "doy", "smooth", 366)
    return rounded(C.separate_peaks(peaks, "doy", "smooth", 366, 60, 3))


@query("fai_threshold_intervals", sql("doy", _FAI.rstrip() + """, th AS (SELECT t, doy FROM sm, (VALUES (0.85), (0.9), (0.95)) AS x(t) WHERE smooth >= t * (SELECT max(smooth) FROM sm)),
r AS (SELECT t, min(doy) AS first, max(doy) AS last, count(*) AS length FROM (SELECT t, doy, doy - row_number() OVER (PARTITION BY t ORDER BY doy) AS i FROM th) GROUP BY t, i), d AS (VALUES (1, 120, 'spring'), (121, 240, 'summer'), (270, 366, 'autumn'))
SELECT CAST(t AS DOUBLE) AS threshold, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last, length, CAST((first + last) // 2 AS BIGINT) AS midpoint, coalesce((SELECT col2 FROM d WHERE (first + last) // 2 BETWEEN col0 AND col1), 'transition') AS season FROM r"""))
def fai_threshold_intervals(spark, sf):
    own = _fai(spark, sf)
    top = own.agg(F.max("smooth").alias("top"))
    own = own.crossJoin(F.broadcast(top)).withColumn("threshold", F.explode(F.array(F.lit(0.85), F.lit(0.9), F.lit(0.95))))
    out = T.runs(own, ["threshold"], "doy", F.col("smooth") >= F.col("threshold") * F.col("top")).withColumn("midpoint", F.floor((F.col("first") + F.col("last")) / 2))
    seasons = spark.createDataFrame([(1, 120, "spring"), (121, 240, "summer"), (270, 366, "autumn")], "first long, last long, season string")
    return C.in_interval(out, seasons, "midpoint", "season", "transition")


_CLEAN = """, m AS (SELECT index, month, CASE WHEN abs(value) < 90 THEN value END AS value FROM monthly)
"""


def _clean(spark, sf):
    return monthly(spark, sf).withColumn("value", sentinel_null(F.col("value")))


@query("monthly_sentinel_clean", sql("monthly", _CLEAN + "SELECT index, count(*) AS n, count(value) AS n_values, round(min(value), 6) AS least, round(max(value), 6) AS greatest FROM m GROUP BY index"))
def monthly_sentinel_clean(spark, sf):
    return rounded(_clean(spark, sf).groupBy("index").agg(F.count("*").alias("n"), F.count("value").alias("n_values"), F.min("value").alias("least"), F.max("value").alias("greatest")))


@query("monthly_fill", sql("monthly", _CLEAN.rstrip() + ", f AS (SELECT month, avg(value) AS v FROM m WHERE index = '1-URGENT' GROUP BY month) SELECT month, round(coalesce(value, 12.5), 6) AS value, value IS NULL AS filled FROM m WHERE index = '2-HIGH'"))
def monthly_fill(spark, sf):
    own = _clean(spark, sf).where("index = '2-HIGH'").select("month", "value")
    return rounded(fill_missing(own, own.select("month").withColumn("value", F.lit(12.5))))


_WINDOWS = _CLEAN.rstrip() + """, y AS (SELECT CAST(y AS INTEGER) AS year, s, make_date(y, 3 * s, 15) AS d FROM range(1996, 2002) AS a(y), range(1, 4) AS b(s)),
w AS (SELECT year, s AS season, 'Lag' || n AS win, d - CAST(n AS INTEGER) AS a, d - 1 AS b FROM y, (VALUES (30), (60), (90)) AS l(n) UNION ALL SELECT year, s, 'PreWinter', make_date(year - 1, 12, 1), make_date(year, 2, 12) FROM y),
wm AS (SELECT year, season, win, CAST(unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS DATE) AS month, a, b FROM w),
wd AS (SELECT year, season, win, month, date_diff('day', greatest(a, month), least(b, last_day(month))) + 1 AS days FROM wm),
wv AS (SELECT year, season, win, index, sum(value * days) / sum(CASE WHEN value IS NOT NULL THEN days END) AS mean, CAST(sum(CASE WHEN value IS NOT NULL THEN days END) AS BIGINT) AS days FROM wd JOIN m USING (month) GROUP BY ALL)
"""


def _lags(spark, sf):
    years = spark.range(1996, 2002).select(F.col("id").cast("int").alias("year")).withColumn("season", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return C.lag_windows(years, F.make_date("year", F.col("season") * 3, F.lit(15)))


def _window_means(spark, sf):
    return C.window_mean(_lags(spark, sf), _clean(spark, sf), ["index"], ["year", "season", "window"])


@query("lag_windows", sql("monthly", _WINDOWS + "SELECT year, CAST(season AS INTEGER) AS season, win AS \"window\", CAST(a AS DATE) AS start, CAST(b AS DATE) AS \"end\", date_diff('day', CAST(a AS DATE), CAST(b AS DATE)) + 1 AS days FROM w WHERE year IN (SELECT year(month) FROM monthly)"))
def lag_windows(spark, sf):
    """The windows of the years that the monthly series has."""
    years = monthly(spark, sf).select(F.year("month").alias("year")).distinct()
    return _lags(spark, sf).join(years, "year", "left_semi").select("year", "season", "window", "start", "end", (F.date_diff("end", "start") + 1).cast("long").alias("days"))


@query("climate_window_weighted_mean", sql("monthly", _WINDOWS + 'SELECT year, CAST(season AS INTEGER) AS season, win AS "window", index, round(mean, 6) AS mean, days FROM wv'))
def climate_window_weighted_mean(spark, sf):
    return rounded(_window_means(spark, sf))


#: Average ranks in SQL, as a column over a partition.
def _rk(x: str, part: str) -> str:
    return f"(rank() OVER (PARTITION BY {part} ORDER BY round({x}, 12)) + (count(*) OVER (PARTITION BY {part}, round({x}, 12)) - 1) / 2.0)"


_ASSOC = _WINDOWS.rstrip() + """, o AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, ((month(o_orderdate) - 1) // 4) + 1 AS season, CAST(count(*) AS DOUBLE) AS fc FROM orders WHERE o_totalprice > 200000 GROUP BY ALL),
j AS (SELECT season, win, index, year, mean, fc FROM wv JOIN o USING (year, season) WHERE mean IS NOT NULL)
"""


def _assoc(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 200000").groupBy(F.year("o_orderdate").alias("year"), (((F.month("o_orderdate") - 1) / 4).cast("int") + 1).alias("season")).agg(F.count("*").cast("double").alias("fc"))
    return _window_means(spark, sf).where("mean is not null").join(o, ["year", "season"])


_KEYS = ["season", "window", "index"]


@query("spearman_battery", sql("monthly", _ASSOC.rstrip() + f""", k AS (SELECT season, win, index, {_rk("mean", "season, win, index")} AS a, {_rk("fc", "season, win, index")} AS b FROM j), r AS (SELECT season, win, index, count(*) AS n, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 AND count(*) >= 5 THEN corr(a, b) END AS rho FROM k GROUP BY ALL)
SELECT CAST(season AS INTEGER) AS season, win AS "window", index, n, round(rho, 6) AS rho, round(CASE WHEN abs(rho) < 1 - 1e-12 THEN rho * sqrt((n - 2) / (1 - rho * rho)) END, 6) AS t FROM r"""))
def spearman_battery(spark, sf):
    return rounded(A.spearman(_assoc(spark, sf), _KEYS, "mean", "fc", least=5))


@query("partial_spearman_year", sql("monthly", _ASSOC.rstrip() + f""", k AS (SELECT season, win, index, {_rk("mean", "season, win, index")} AS a, {_rk("fc", "season, win, index")} AS b, {_rk("year", "season, win, index")} AS g FROM j), r AS (SELECT season, win, index, count(*) AS n, corr(a, b) AS xy, corr(a, g) AS xg, corr(b, g) AS yg FROM k GROUP BY ALL)
SELECT CAST(season AS INTEGER) AS season, win AS "window", index, n, round(CASE WHEN n >= 6 AND (1 - xg * xg) * (1 - yg * yg) > 1e-12 THEN (xy - xg * yg) / sqrt((1 - xg * xg) * (1 - yg * yg)) END, 6) AS rho FROM r"""))
def partial_spearman_year(spark, sf):
    return rounded(A.partial_spearman(_assoc(spark, sf), _KEYS, "mean", "fc", "year"))


@query("loyo_summary", sql("monthly", _ASSOC.rstrip() + f""", x AS (SELECT a.season, a.win, a.index, b.year AS out, a.mean, a.fc FROM j a JOIN j b ON a.season = b.season AND a.win = b.win AND a.index = b.index AND a.year <> b.year), k AS (SELECT season, win, index, out, {_rk("mean", "season, win, index, out")} AS a, {_rk("fc", "season, win, index, out")} AS b FROM x),
e AS (SELECT season, win, index, out, round(CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END, 12) + 0.0 AS rho FROM k GROUP BY ALL), kf AS (SELECT season, win, index, {_rk("mean", "season, win, index")} AS a, {_rk("fc", "season, win, index")} AS b FROM j), f AS (SELECT season, win, index, round(corr(a, b), 12) + 0.0 AS full_rho FROM kf GROUP BY ALL),
s AS (SELECT *, round(abs(rho - full_rho), 12) AS shift, sign(rho) = sign(full_rho) AS same FROM e JOIN f USING (season, win, index))
SELECT CAST(season AS INTEGER) AS season, win AS "window", index, round(any_value(full_rho), 6) AS rho, round(min(rho), 6) AS least, round(max(rho), 6) AS greatest, round(avg(rho), 6) AS mean, round(100.0 * avg(CAST(same AS INT)), 6) AS same_sign_percent, arg_max(out, (shift, -out)) AS influential FROM s GROUP BY ALL"""))
def loyo_summary(spark, sf):
    return rounded(A.leave_one_out(_assoc(spark, sf), _KEYS, "year", "mean", "fc"))


@query("spearman_bootstrap_ci")
def spearman_bootstrap_ci(spark, sf):
    return rounded(A.bootstrap_spearman(_assoc(spark, sf), _KEYS, "mean", "fc", 2000))


@query("lag_intercorrelation", sql("monthly", _WINDOWS.rstrip() + f""", p AS (SELECT a.index, a.win AS a, b.win AS b, a.mean AS x, b.mean AS y FROM wv a JOIN wv b ON a.year = b.year AND a.season = b.season AND a.index = b.index AND a.win < b.win WHERE a.mean IS NOT NULL AND b.mean IS NOT NULL), k AS (SELECT index, a, b, {_rk("x", "index, a, b")} AS p, {_rk("y", "index, a, b")} AS q FROM p)
SELECT index, a, b, count(*) AS n, round(corr(p, q), 6) AS rho FROM k GROUP BY ALL"""))
def lag_intercorrelation(spark, sf):
    wide = _window_means(spark, sf).groupBy("index", "year", "season").pivot("window", ["Lag30", "Lag60", "Lag90", "PreWinter"]).agg(F.first("mean"))
    return rounded(A.pair_matrix(wide, ["Lag30", "Lag60", "Lag90", "PreWinter"], ["index"]).select("index", "a", "b", "n", "rho"))


_COLS = ["x1", "x2", "x3", "x4", "pixels"]
_MATRIX = ", l AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM panel" for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]) + f"), k AS (SELECT a, b, {_rk('x', 'a, b')} AS p, {_rk('y', 'a, b')} AS q FROM l), r AS (SELECT a, b, count(*) AS n, corr(p, q) AS rho FROM k GROUP BY ALL)\n"


@query("high_correlation_pairs", sql("panel", _MATRIX + "SELECT a, b, n, round(rho, 6) AS rho, abs(rho) >= 0.5 AS flagged FROM r"))
def high_correlation_pairs(spark, sf):
    own = A.pair_matrix(panel(spark, sf), _COLS).select("a", "b", "n", "rho")
    return rounded(own.withColumn("flagged", F.abs("rho") >= 0.5))


@query("correlation_clusters", "WITH RECURSIVE " + sql("panel", _MATRIX.rstrip())[5:] + f""", e AS (SELECT a, b FROM r WHERE abs(rho) >= 0.5 UNION SELECT b, a FROM r WHERE abs(rho) >= 0.5), n AS (SELECT unnest({_COLS}) AS node), g(node, reach) AS (SELECT node, node FROM n UNION SELECT g.node, e.b FROM g JOIN e ON g.reach = e.a)
SELECT cluster, count(*) AS n, string_agg(node, ';' ORDER BY node) AS members FROM (SELECT node, min(reach) AS cluster FROM g GROUP BY node) GROUP BY cluster""")
def correlation_clusters(spark, sf):
    edges = A.pair_matrix(panel(spark, sf), _COLS).where("abs(rho) >= 0.5").select("a", "b")
    nodes = spark.createDataFrame([(c,) for c in _COLS], "node string")
    own = A.clusters(edges, nodes)
    return own.groupBy("cluster").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("node")), ";").alias("members"))


_KNN = """, d AS (SELECT a.grid_uid AS source, b.grid_uid AS neighbour, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance FROM pts a JOIN pts b ON a.grid_uid <> b.grid_uid),
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY distance, neighbour) AS rank FROM d) WHERE rank <= 8)
"""


@query("knn_edges", sql("pts", _KNN + "SELECT source, neighbour, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance FROM e"))
def knn_edges(spark, sf):
    return rounded(X.nearest(pts(spark, sf), 8))


@query("knn_graph_qa", sql("pts", _KNN + "SELECT count(*) AS n_edges, round(avg(CAST(EXISTS (SELECT 1 FROM e b WHERE b.source = a.neighbour AND b.neighbour = a.source) AS INT)), 6) AS reciprocal_share, round(min(distance), 6) AS least, round(avg(distance), 6) AS mean, round(max(distance), 6) AS greatest, count(DISTINCT source) AS n_sources, true AS all_have_k FROM e a"))
def knn_graph_qa(spark, sf):
    return rounded(X.graph_checks(X.nearest(pts(spark, sf), 8), 8))


@query("moran_i", sql("pts", _KNN.rstrip() + ", z AS (SELECT grid_uid, value - avg(value) OVER () AS z, var_pop(value) OVER () AS s2, count(*) OVER () AS n FROM pts) SELECT any_value(a.n) AS n, round(sum(a.z * b.z / 8) / sum(1.0 / 8) / any_value(a.s2), 6) AS moran, round(-1.0 / (any_value(a.n) - 1), 6) AS expected FROM e JOIN z a ON a.grid_uid = source JOIN z b ON b.grid_uid = neighbour"))
def moran_i(spark, sf):
    own = pts(spark, sf)
    return rounded(X.moran(own, X.nearest(own, 8), "value"))


@query("moran_permutation")
def moran_permutation(spark, sf):
    own = pts(spark, sf)
    return rounded(X.moran_permutation(own, X.nearest(own, 8), "value", 9999))


#: Steps of the paths: standardised slopes between the panel's covariates and its rate, by season.
_STEPS = [("temp", "dry"), ("dry", "fire"), ("temp", "fire"), ("dry", "fuel"), ("fuel", "fire")]
_STEP_SQL = " UNION ALL ".join(f"SELECT CAST(season AS VARCHAR) AS model, '{a}' AS a, '{b}' AS b, corr({b}, {a}) AS c FROM q GROUP BY season" for a, b in _STEPS)


@query("effect_decomposition", sql("panel", f""", q AS (SELECT season, x1 AS temp, x2 AS dry, x3 AS fuel, CAST(fire_count AS DOUBLE) / pixels AS fire FROM panel), p AS ({_STEP_SQL}),
r AS (SELECT model, 1 AS steps, c AS effect FROM p WHERE a = 'temp' AND b = 'fire'
  UNION ALL SELECT x.model, 2, x.c * y.c FROM p x JOIN p y ON x.model = y.model AND x.b = y.a WHERE x.a = 'temp' AND y.b = 'fire'
  UNION ALL SELECT x.model, 3, x.c * y.c * z.c FROM p x JOIN p y ON x.model = y.model AND x.b = y.a JOIN p z ON y.model = z.model AND y.b = z.a WHERE x.a = 'temp' AND z.b = 'fire')
SELECT model, round(sum(CASE WHEN steps = 1 THEN effect ELSE 0 END), 6) AS direct, round(sum(CASE WHEN steps > 1 THEN effect ELSE 0 END), 6) AS indirect, round(sum(effect), 6) AS total FROM r GROUP BY model"""))
def effect_decomposition(spark, sf):
    own = panel(spark, sf).select("season", F.col("x1").alias("temp"), F.col("x2").alias("dry"), F.col("x3").alias("fuel"), (F.col("fire_count") / F.col("pixels")).alias("fire"))
    found = own.groupBy(F.col("season").cast("string").alias("model")).agg(*(S.correlation(F.col(a), F.col(b)).alias(f"c{k}") for k, (a, b) in enumerate(_STEPS)))
    paths = found.select("model", F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("coefficient")) for k, (a, b) in enumerate(_STEPS)))))
    return rounded(L.total_effects(L.effects(paths, "temp", "fire")))


@query("indicator_screen")
def indicator_screen(spark, sf):
    """The covariates of each season that are left once inflation, correlation and condition are within bounds."""
    own = panel(spark, sf).withColumns({"x5": F.col("x5").cast("double"), "pixels": F.col("pixels").cast("double"), "x6": F.col("x1") + 0.05 * F.col("x4")})
    names = ["x1", "x2", "x3", "x4", "x5", "x6", "pixels"]
    kept = [(k, f) for k in (1, 2, 3) for f in L.screen(own.where(F.col("season") == k), names)]
    return spark.createDataFrame(kept, "season int, feature string")


@query("sessions_by_type", "WITH l AS (SELECT event_type, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT min(ts) AS start, max(ts) + INTERVAL 20 MINUTE AS \"end\", event_type, count(*) AS n FROM s GROUP BY event_type, k")
def sessions_by_type(spark, sf):
    return C.sessions(table(spark, sf, "events"), ["event_type"], "ts", "20 minutes")


@query("sliding_windows", "SELECT w AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY * k for k in [0, 1, 2]]) AS w FROM events) GROUP BY ALL")
def sliding_windows(spark, sf):
    return rounded(C.sliding(table(spark, sf, "events"), ["event_type"], "ts", "3 days", "1 day", "value"), 4)


@query("stream_tumbling_equals_batch", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling_equals_batch(spark, sf):
    stream = W.event_stream(spark, sf, "events.parquet")
    return rounded(W.run_to_end(W.windowed(stream, "tumbling", ["event_type"], "1 day")), 4)


@query("vif_condition")
def vif_condition(spark, sf):
    return rounded(L.collinearity(panel(spark, sf), ["x1", "x2", "x3", "x4", "x5"]))


@query("glm_poisson_offset")
def glm_poisson_offset(spark, sf):
    return rounded(L.poisson_rate(panel(spark, sf), ["x1", "x2", "x3"], "fire_count", "pixels"))


@query("hurdle_rf_oof")
def hurdle_rf_oof(spark, sf):
    own = panel(spark, sf).withColumn("fold", F.col("year") % 3)
    return rounded(L.hurdle_forest(own, ["x1", "x2", "x3", "x4", "pixels"], "fire_count", "fold").select("grid_uid", "year", "season", "fold", "fire_count", "p", "severity", "predicted"))


@query("kmeans_blocks")
def kmeans_blocks(spark, sf):
    return L.blocks(pts(spark, sf), "x", "y", 5).groupBy("block").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"))


@query("permutation_importance")
def permutation_importance(spark, sf):
    return rounded(L.permutation_importance(panel(spark, sf), ["x1", "x2", "x3", "x4", "pixels"], {"x1": ["x1"], "pixels": ["pixels"], "rates": ["x2", "x3"]}, "fire_count"))


@query("first_component_score")
def first_component_score(spark, sf):
    return rounded(L.first_component(panel(spark, sf), ["x1", "x4", "pixels"], "x1", ["season"]).select("grid_uid", "year", "season", "score"))


@query("fai_spline")
def fai_spline(spark, sf):
    """The daily index by a cyclic spline with 30 knots, and whether a step is a local peak of the curve."""
    own = _fai(spark, sf).select("doy", "fai")
    curve = SM.cyclic_spline(own, "doy", "fai", 366)
    peaks = C.local_peaks(curve.select("doy", "smooth"), "doy", "smooth", 366).select("doy", F.lit(True).alias("peak"))
    return rounded(curve.join(F.broadcast(peaks), "doy", "left").withColumn("peak", F.coalesce("peak", F.lit(False))))
