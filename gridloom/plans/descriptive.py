"""Queries: grouped summaries, complete grids, trends, panel audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import scalar as S
from gridloom.operators import panel as P
from gridloom.operators import trend as T
from gridloom.plans.relations import doy, ev, panel, region_class, sql
from gridloom.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def rounded(df, digits: int = 6):
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


_SERIES = """, level AS (SELECT year, 'annual' AS band, frp FROM ev WHERE frp > 200 UNION ALL SELECT year, CAST(season AS VARCHAR), frp FROM ev WHERE frp > 200),
s AS (SELECT year, band, count(*) AS n, sum(frp) AS total, avg(frp) AS mean, median(frp) AS median, quantile_cont(frp, 0.95) AS p95 FROM level GROUP BY ALL),
grid AS (SELECT DISTINCT y.year, b.band FROM (SELECT DISTINCT year FROM ev) y, (VALUES ('annual'), ('1'), ('2'), ('3')) AS b(band)),
series AS (SELECT year, band, coalesce(n, 0) AS n, coalesce(total, 0.0) AS total, mean, median, p95 FROM grid LEFT JOIN s USING (year, band))
"""


def _series(spark, sf):
    own = ev(spark, sf)
    strong = own.where("frp > 200").withColumn("band", F.col("season").cast("string"))
    summary = P.value_summary(P.with_total_level(strong, "band", "annual"), ["year", "band"], "frp")
    years, bands = own.select("year").distinct(), spark.createDataFrame([(b,) for b in ("annual", "1", "2", "3")], "band string")
    return P.complete(summary, [years, bands], ["year", "band"], ["n", "total"])


@query("frp_seasonal_series", sql("ev", _SERIES + "SELECT year, band, n, round(total, 6) AS total, round(mean, 6) AS mean, round(median, 6) AS median, round(p95, 6) AS p95 FROM series"))
def frp_seasonal_series(spark, sf):
    return rounded(_series(spark, sf))


_PAIRS = """, pair AS (SELECT a.band, (b.median - a.median) / (b.year - a.year) AS slope, sign(round(b.median, 12) - round(a.median, 12)) AS sg FROM series a JOIN series b ON a.band = b.band AND a.year < b.year AND a.median IS NOT NULL AND b.median IS NOT NULL)"""


@query("frp_trend_sen", sql("ev", _SERIES.rstrip() + _PAIRS + """, sl AS (SELECT band, median(slope) AS slope FROM pair GROUP BY band)
SELECT band, round(any_value(slope), 6) AS slope, round(median(median - slope * year), 6) AS intercept, count(median) AS n FROM series JOIN sl USING (band) GROUP BY band"""))
def frp_trend_sen(spark, sf):
    return rounded(T.sen_slope(_series(spark, sf), ["band"], "year", "median"))


#: The same polynomial of erfc in SQL.
def erfc_sql(x: str) -> str:
    t = f"(1 / (1 + 0.5 * abs({x})))"
    horner = f"({S._ERFC[0]})"
    for c in S._ERFC[1:]:
        horner = f"({horner} * {t} + ({c}))"
    return f"({t} * exp(-({x}) * ({x}) + {horner}))"


_KENDALL = """, tie AS (SELECT band, sum(m) AS n, sum(m * (m - 1) / 2.0) AS tp, sum(m * (m - 1) * (2 * m + 5)) AS tv FROM (SELECT band, round(median, 12) AS v, count(*) AS m FROM series WHERE median IS NOT NULL GROUP BY ALL) GROUP BY band),
k AS (SELECT band, n, coalesce(s, 0) AS s, n * (n - 1) / 2.0 AS np, tp, (n * (n - 1) * (2 * n + 5) - tv) / 18.0 AS v FROM tie LEFT JOIN (SELECT band, sum(sg) AS s FROM pair GROUP BY band) USING (band)),
kz AS (SELECT *, s / sqrt(np * (np - tp)) AS tau_b, s / np AS tau_a, CASE WHEN v > 0 THEN s / sqrt(v) ELSE 0 END AS z FROM k)"""


@query(
    "frp_trend_fdr",
    sql(
        "ev",
        _SERIES.rstrip()
        + _PAIRS
        + _KENDALL
        + f""", kp AS (SELECT *, CASE WHEN z = 0 THEN 1.0 ELSE {erfc_sql("(abs(z) / sqrt(2))")} END AS p FROM kz WHERE n >= 3),
kq AS (SELECT *, least(1.0, min(p * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS q FROM (SELECT *, row_number() OVER (ORDER BY p, band) AS r, count(*) OVER () AS m FROM kp)
  UNION ALL BY NAME SELECT band FROM kz WHERE n < 3)
SELECT band, round(tau_b, 6) AS tau_b, round(z, 6) AS z, round(p, 6) AS p, round(q, 6) AS q,
  CASE WHEN q IS NULL OR tau_b IS NULL THEN 'undetermined' WHEN q < 0.05 AND tau_b > 0 THEN 'increase' WHEN q < 0.05 AND tau_b < 0 THEN 'decrease' ELSE 'no trend' END AS trend FROM kq""",
    ),
)
def frp_trend_fdr(spark, sf):
    own = T.step_up(T.kendall(_series(spark, sf), ["band"], "year", "median"), [], "p", ["band"])
    return rounded(own.select("band", "tau_b", "z", "p", "q", S.trend_label(F.col("tau_b"), F.col("q")).alias("trend")))


@query("complete_grid_doy", sql("doy", "SELECT doy, fire_count, round(burned_area, 2) AS burned_area FROM doy"))
def complete_grid_doy(spark, sf):
    return rounded(doy(spark, sf), 2)


@query(
    "complete_grid_month_country",
    """WITH o AS (SELECT CAST(month(o_orderdate) AS INTEGER) AS month, o_orderpriority AS country, count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_totalprice > 280000 GROUP BY ALL)
SELECT m.month, c.country, coalesce(n, 0) AS n, round(coalesce(total, 0.0), 2) AS total FROM (SELECT CAST(i AS INTEGER) AS month FROM range(1, 13) AS r(i)) m CROSS JOIN (SELECT DISTINCT o_orderpriority AS country FROM orders) c LEFT JOIN o USING (month, country)""",
)
def complete_grid_month_country(spark, sf):
    orders = table(spark, sf, "orders").select(F.month("o_orderdate").alias("month"), F.col("o_orderpriority").alias("country"), "o_totalprice")
    own = orders.where("o_totalprice > 280000").groupBy("month", "country").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    months = spark.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return rounded(P.complete(own, [months, orders.select("country").distinct()], ["month", "country"], ["n", "total"]), 2)


_TOTALS = """, t AS (SELECT year, season, country, CAST(sum(fire_count) AS BIGINT) AS fc, CAST(sum(burned_count) AS BIGINT) AS ba, CAST(sum(pixels) AS BIGINT) AS pixels FROM panel GROUP BY ALL)
"""


def _totals(spark, sf):
    return panel(spark, sf).groupBy("year", "season", "country").agg(F.sum("fire_count").alias("fc"), F.sum("burned_count").alias("ba"), F.sum("pixels").alias("pixels"))


@query(
    "country_season_totals_shares",
    sql("panel", _TOTALS + "SELECT year, season, country, fc, ba, pixels, round(CASE WHEN sum(fc) OVER w > 0 THEN 100.0 * fc / sum(fc) OVER w END, 6) AS fc_share, round(CASE WHEN sum(ba) OVER w > 0 THEN 100.0 * ba / sum(ba) OVER w END, 6) AS ba_share, round(CAST(fc AS DOUBLE) / pixels, 6) AS rate FROM t WINDOW w AS (PARTITION BY year, season)"),
)
def country_season_totals_shares(spark, sf):
    return rounded(P.shares(_totals(spark, sf), ["year", "season"], ["fc", "ba"]).withColumn("rate", S.ratio(F.col("fc"), F.col("pixels"))))


@query(
    "country_season_trend",
    sql(
        "panel",
        _TOTALS.rstrip()
        + f""", series AS (SELECT season || '|' || country AS band, year, CAST(fc AS DOUBLE) / pixels AS median FROM t){_PAIRS}{_KENDALL}, zc AS (SELECT *, CASE WHEN v > 0 THEN (s - sign(s)) / sqrt(v) ELSE 0 END AS zz FROM kz),
kp AS (SELECT *, CASE WHEN zz = 0 THEN 1.0 ELSE {erfc_sql("(abs(zz) / sqrt(2))")} END AS p FROM zc),
kq AS (SELECT *, least(1.0, min(p * m / r) OVER (PARTITION BY f ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS q FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY p, band) AS r, count(*) OVER (PARTITION BY f) AS m FROM (SELECT *, split_part(band, '|', 1) AS f FROM kp)))
SELECT band, CAST(n AS BIGINT) AS n, CAST(s AS DOUBLE) AS s, round(tau_a, 6) AS tau_a, round(zz, 6) AS z, round(p, 6) AS p, round(q, 6) AS q FROM kq""",
    ),
)
def country_season_trend(spark, sf):
    own = _totals(spark, sf).select(F.concat(F.col("season").cast("string"), F.lit("|"), "country").alias("band"), "year", S.ratio(F.col("fc"), F.col("pixels")).alias("rate"))
    own = T.kendall(own, ["band"], "year", "rate", continuity=True).withColumn("family", F.split_part("band", F.lit("|"), F.lit(1)))
    return rounded(T.step_up(own, ["family"], "p", ["band"]).select("band", F.col("n").cast("long"), "s", "tau_a", "z", "p", "q"))


@query("trend_excluding_peaks", sql("ev", _SERIES.rstrip() + ", x AS (SELECT band, year, n FROM series WHERE year NOT IN (3, 8)) SELECT band, count(*) AS n_years, round(regr_slope(n, year), 6) AS slope FROM x GROUP BY band"))
def trend_excluding_peaks(spark, sf):
    own = _series(spark, sf).where(~F.col("year").isin(3, 8))
    return rounded(own.groupBy("band").agg(F.count("*").alias("n_years"), T.ols_slope("year", "n").alias("slope")))


_REGION = """, x AS (SELECT country, year, CAST(sum(n) AS BIGINT) AS cells, CAST(coalesce(sum(n) FILTER (WHERE hs_bin > 0), 0) AS BIGINT) AS hot, CAST(coalesce(sum(n) FILTER (WHERE hs_bin = 3), 0) AS BIGINT) AS hot99 FROM region_class GROUP BY ALL)
"""


@query(
    "hotspot_recurrence",
    sql(
        "region_class",
        _REGION.rstrip()
        + """, r AS (SELECT country, year - row_number() OVER (PARTITION BY country ORDER BY year) AS i, year FROM x WHERE hot99 > 0), rl AS (SELECT country, i, min(year) AS a, max(year) AS b, count(*) AS l FROM r GROUP BY ALL),
rt AS (SELECT country, max(l) AS longest_run, string_agg(a || '-' || b, ';' ORDER BY a || '-' || b) AS runs FROM (SELECT *, max(l) OVER (PARTITION BY country) AS m FROM rl) WHERE l = m GROUP BY country),
y AS (SELECT country, count(*) AS n_years, CAST(count_if(hot > 0) AS BIGINT) AS hot_years, CAST(count_if(hot99 > 0) AS BIGINT) AS years_99, min(year) FILTER (WHERE hot > 0) AS first_hot, max(year) FILTER (WHERE hot > 0) AS last_hot, round(avg(100.0 * hot / cells), 6) AS mean_extent, round(max(100.0 * hot / cells), 6) AS peak_extent FROM x GROUP BY country),
pk AS (SELECT country, string_agg(CAST(year AS VARCHAR), ';' ORDER BY year) AS peak_years FROM (SELECT country, year, hot, cells, max(CAST(hot AS DOUBLE) / cells) OVER (PARTITION BY country) AS m FROM x) WHERE CAST(hot AS DOUBLE) / cells = m GROUP BY country)
SELECT country, n_years, hot_years, years_99, first_hot, last_hot, mean_extent, peak_extent, peak_years, longest_run, runs FROM y LEFT JOIN pk USING (country) LEFT JOIN rt USING (country)""",
    ),
)
def hotspot_recurrence(spark, sf):
    when = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    x = region_class(spark, sf).groupBy("country", "year").agg(F.sum("n").alias("cells"), when(F.col("hs_bin") > 0).alias("hot"), when(F.col("hs_bin") == 3).alias("hot99"))
    x = x.withColumn("extent", F.col("hot") / F.col("cells"))
    hot = F.when(F.col("hot") > 0, F.col("year"))
    y = x.groupBy("country").agg(F.count("*").alias("n_years"), F.count_if(F.col("hot") > 0).alias("hot_years"), F.count_if(F.col("hot99") > 0).alias("years_99"), F.min(hot).alias("first_hot"), F.max(hot).alias("last_hot"), F.avg(100 * F.col("extent")).alias("mean_extent"), (100 * F.max("extent")).alias("peak_extent"), F.max("extent").alias("_top"))
    peaks = x.join(y.select("country", "_top"), "country").where("extent = _top").groupBy("country").agg(F.array_join(F.array_sort(F.collect_list(F.col("year").cast("string"))), ";").alias("peak_years"))
    longest = T.longest_runs(x, ["country"], "year", F.col("hot99") > 0).withColumnRenamed("longest", "longest_run")
    return rounded(y.drop("_top").join(peaks, "country", "left").join(longest, "country", "left"))


@query(
    "ehsa_country_table",
    sql("region_class", """, c AS (SELECT hs_bin, country, CAST(sum(n) AS BIGINT) AS n FROM region_class GROUP BY ALL), tot AS (SELECT country, sum(n) AS t FROM c GROUP BY country),
l AS (SELECT CAST(hs_bin AS VARCHAR) AS category, country, n FROM c UNION ALL SELECT 'Total', country, CAST(sum(n) AS BIGINT) FROM c GROUP BY country)
SELECT category, country, n, round(100.0 * n / t, 6) AS percent, format('{:,}', n) || ' (' || format('{:.1f}', floor(1000.0 * n / t + 0.5) / 10) || '%)' AS cell FROM l JOIN tot USING (country) WHERE n > 0"""),
)
def ehsa_country_table(spark, sf):
    own = region_class(spark, sf).select(F.col("hs_bin").cast("string").alias("category"), "country", "n")
    cells = P.with_total_level(own, "category", "Total").groupBy("category", "country").agg(F.sum("n").alias("n"))
    total = cells.where("category = 'Total'").select("country", F.col("n").alias("t"))
    share = 100 * F.col("n") / F.col("t")
    text = F.concat(F.format_number("n", 0), F.lit(" ("), F.format_number(F.floor(10 * share + 0.5) / 10, 1), F.lit("%)"))
    return rounded(cells.join(total, "country").where("n > 0").select("category", "country", "n", share.alias("percent"), text.alias("cell")))


@query("panel_anomalies", "SELECT o_orderkey, 'o_totalprice' AS response, o_totalprice AS value, 'not an integer' AS issue FROM orders WHERE abs(o_totalprice - round_even(o_totalprice, 0)) > 1e-9 UNION ALL SELECT o_orderkey, 'balance', c_acctbal, CASE WHEN c_acctbal < 0 THEN 'negative' ELSE 'not an integer' END FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0 OR abs(c_acctbal - round_even(c_acctbal, 0)) > 1e-9")
def panel_anomalies(spark, sf):
    own = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.expr("o_custkey = c_custkey"))
    return P.anomalies(own.withColumn("balance", F.col("c_acctbal")), ["o_orderkey"], ["o_totalprice", "balance"])


@query("panel_duplicates", "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def panel_duplicates(spark, sf):
    return P.duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"])


@query("panel_expectations", sql("panel", "SELECT count_if(country NOT IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST')) = 0 AS country_in_domain, count_if(season NOT IN (1, 2, 3)) = 0 AS season_in_domain, true AS row_count_ok, count(*) = count(DISTINCT (grid_uid, year, season)) AS keys_unique FROM panel"))
def panel_expectations(spark, sf):
    return P.expectations(panel(spark, sf), ["grid_uid", "year", "season"], {"country": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"], "season": [1, 2, 3]})


@query(
    "count_distribution_audit",
    sql(
        "panel",
        """, l AS (SELECT season, country, fire_count AS x FROM panel UNION ALL SELECT 0, 'All', fire_count FROM panel)
SELECT season, country, count(x) AS n, round(100.0 * count_if(x = 0) / count(x), 6) AS zero_percent, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(skewness(x), 6) AS skewness, round(kurtosis(x), 6) AS kurtosis, min(x) AS least, round(median(x), 6) AS median,
 round(quantile_cont(CAST(x AS DOUBLE), 0.9), 6) AS q90, round(quantile_cont(CAST(x AS DOUBLE), 0.95), 6) AS q95, round(quantile_cont(CAST(x AS DOUBLE), 0.99), 6) AS q99, max(x) AS greatest, round(avg(x) FILTER (WHERE x > 0), 6) AS positive_mean, round(median(x) FILTER (WHERE x > 0), 6) AS positive_median, round(var_samp(x) / avg(x), 6) AS dispersion
FROM l GROUP BY ALL""",
    ),
)
def count_distribution_audit(spark, sf):
    own = panel(spark, sf).select("season", "country", "fire_count")
    both = own.select(F.inline(F.array(F.struct("season", "country", "fire_count"), F.struct(F.lit(0).alias("season"), F.lit("All").alias("country"), F.col("fire_count")))))
    return rounded(P.distribution(both, ["season", "country"], "fire_count"))


@query(
    "poisson_diagnostics",
    sql(
        "panel",
        """, r AS (SELECT season, CAST(sum(fire_count) AS DOUBLE) / sum(pixels) AS rate FROM panel GROUP BY season), m AS (SELECT season, fire_count AS y, rate, rate * pixels AS mu FROM panel JOIN r USING (season))
SELECT season, round(any_value(rate), 6) AS rate, round(sum((y - mu) * (y - mu) / mu) / (count(*) - 1), 6) AS pearson_over_df, round(avg(CAST(y = 0 AS INT)), 6) AS observed_zero, round(avg(exp(-mu)), 6) AS expected_zero FROM m GROUP BY season""",
    ),
)
def poisson_diagnostics(spark, sf):
    return rounded(P.poisson_fit(panel(spark, sf), ["season"], "fire_count", "pixels"))


@query("poisson_loglik", sql("panel", """, r AS (SELECT season, CAST(sum(fire_count) AS DOUBLE) / sum(pixels) AS rate FROM panel GROUP BY season)
SELECT season, round(sum(fire_count * ln(rate * pixels) - rate * pixels - lgamma(fire_count + 1)), 4) AS loglik FROM panel JOIN r USING (season) GROUP BY season"""))
def poisson_loglik(spark, sf):
    own = panel(spark, sf)
    rate = own.groupBy("season").agg(S.ratio(F.sum("fire_count"), F.sum("pixels")).alias("rate"))
    mu = F.col("rate") * F.col("pixels")
    return rounded(own.join(rate, "season").groupBy("season").agg(F.sum(F.col("fire_count") * F.ln(mu) - mu - S.lgamma(F.col("fire_count") + 1)).alias("loglik")), 4)


_MISSING = """, h AS (SELECT season, country, CASE WHEN pixels % 3 = 0 THEN NULL ELSE x1 END AS x1, x5 FROM panel), l AS (SELECT season, country, 'x1' AS variable, x1 AS value FROM h UNION ALL SELECT season, country, 'x5', x5 FROM h)
"""


@query("missingness", sql("panel", _MISSING + "SELECT season, country, variable, count(*) AS n, count(*) - count(value) AS n_missing, round(100.0 * (count(*) - count(value)) / count(*), 6) AS missing_percent, count(DISTINCT value) AS n_unique FROM l WHERE variable = 'x5' OR true GROUP BY ALL"))
def missingness(spark, sf):
    own = panel(spark, sf).withColumn("x1", F.when(F.col("pixels") % 3 != 0, F.round("x1", 9)))
    return rounded(P.missingness(own, ["season", "country"], ["x1", "x5"]))


ORACLE_SQL["missingness"] = ORACLE_SQL["missingness"].replace("ELSE x1 END", "ELSE round(x1, 9) END")


@query(
    "column_inventory",
    sql(
        "panel",
        """, l AS (SELECT 'pixels' AS variable, CAST(pixels AS DOUBLE) AS x FROM panel UNION ALL SELECT 'fire_count', fire_count FROM panel UNION ALL SELECT 'burned_count', burned_count FROM panel UNION ALL SELECT 'x5', x5 FROM panel)
SELECT variable, count(*) AS n, count(*) - count(x) AS n_missing, count(DISTINCT x) AS n_unique, round(min(x), 6) AS least, round(quantile_cont(x, 0.25), 6) AS q25, round(median(x), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q75, round(max(x), 6) AS greatest, round(avg(x), 6) AS mean, round(skewness(x), 6) AS skewness,
 round(CAST(count_if(x = 0) AS DOUBLE) / count(x), 6) AS zero_rate, round(CAST(count_if(x < 0) AS DOUBLE) / count(x), 6) AS negative_rate, CASE WHEN count(DISTINCT x) <= 1 THEN 'constant' WHEN var_pop(x) <= 1e-12 THEN 'near-zero variance' ELSE '' END AS exclusion,
 CASE WHEN abs(skewness(x)) >= 2 AND min(x) >= 0 THEN 'log1p' WHEN abs(skewness(x)) >= 2 THEN 'power' ELSE 'none' END AS transformation FROM l GROUP BY variable""",
    ),
)
def column_inventory(spark, sf):
    return rounded(P.inventory(panel(spark, sf), ["pixels", "fire_count", "burned_count", "x5"]))


@query("season_zscore", sql("panel", ", m AS (SELECT season, avg(x1) AS m1, stddev_samp(x1) AS s1, avg(x5) AS m5, stddev_samp(x5) AS s5 FROM panel GROUP BY season) SELECT grid_uid, year, season, round((x1 - m1) / s1, 6) AS x1_z, round((x5 - m5) / s5, 6) AS x5_z FROM panel JOIN m USING (season)"))
def season_zscore(spark, sf):
    return rounded(P.zscore(panel(spark, sf), ["season"], ["x1", "x5"]).select("grid_uid", "year", "season", "x1_z", "x5_z"))


@query("onehot_design", sql("panel", "SELECT grid_uid, year, season, CAST(country = 'AMERICA' AS INT) AS country_AMERICA, CAST(country = 'ASIA' AS INT) AS country_ASIA, round(ln(1 + pixels), 6) AS log_pixels FROM panel"))
def onehot_design(spark, sf):
    own = P.one_hot(panel(spark, sf), "country", ["AMERICA", "ASIA"])
    return rounded(own.select("grid_uid", "year", "season", "country_AMERICA", "country_ASIA", S.log1p_guarded(F.col("pixels")).alias("log_pixels")))


@query("time_support", sql("panel", """, y AS (SELECT grid_uid, season, list_sort(list(DISTINCT year)) AS l FROM panel GROUP BY ALL)
SELECT grid_uid, season, CAST(len(l) AS INT) AS n_years, array_to_string(l, ';') AS years, array_to_string(list_filter([1995, 1996, 1997, 1998, 1999, 2000, 2001], lambda v: NOT list_contains(l, v)), ';') AS missing_years, len(l) = 7 AS complete FROM y"""))
def time_support(spark, sf):
    return P.time_support(panel(spark, sf), ["grid_uid", "season"], "year", 1995, 2001)


@query("within_unit_constancy", sql("panel", ", l AS (SELECT grid_uid, 'x5' AS variable, coalesce(CAST(x5 AS VARCHAR), '') AS value FROM panel UNION ALL SELECT grid_uid, 'pixels', CAST(pixels AS VARCHAR) FROM panel) SELECT grid_uid, variable, count(DISTINCT value) AS n_values FROM l GROUP BY ALL HAVING count(DISTINCT value) > 1"))
def within_unit_constancy(spark, sf):
    return P.constant_within(panel(spark, sf), "grid_uid", ["x5", "pixels"])


@query("component_contribution", sql("panel", ", t AS (SELECT season, sum(fire_count) AS a, sum(burned_count) AS b, count_if(fire_count > 0 AND burned_count = 0) AS oa, count_if(burned_count > 0 AND fire_count = 0) AS ob, count_if(fire_count > 0 AND burned_count > 0) AS c FROM panel GROUP BY season) SELECT season, CAST(a AS BIGINT) AS a_sum, CAST(b AS BIGINT) AS b_sum, CAST(oa AS BIGINT) AS only_a, CAST(ob AS BIGINT) AS only_b, CAST(c AS BIGINT) AS both, round(100.0 * a / (a + b), 6) AS a_share FROM t"))
def component_contribution(spark, sf):
    return rounded(P.contribution(panel(spark, sf), ["season"], "fire_count", "burned_count"))


@query("range_separation", sql("panel", """, t AS (SELECT season, min(x1) FILTER (WHERE fire_count > 0) AS pos_min, max(x1) FILTER (WHERE fire_count > 0) AS pos_max, min(x1) FILTER (WHERE fire_count = 0) AS zero_min, max(x1) FILTER (WHERE fire_count = 0) AS zero_max FROM panel GROUP BY season)
SELECT season, round(pos_min, 6) AS pos_min, round(pos_max, 6) AS pos_max, round(zero_min, 6) AS zero_min, round(zero_max, 6) AS zero_max, round(greatest(0.0, least(pos_max, zero_max) - greatest(pos_min, zero_min)) / (greatest(pos_max, zero_max) - least(pos_min, zero_min)), 6) AS overlap, pos_min > zero_max OR zero_min > pos_max AS separated FROM t"""))
def range_separation(spark, sf):
    return rounded(P.separation(panel(spark, sf), ["season"], "x1", "fire_count"))


@query("content_signature", """
WITH r AS (SELECT md5(concat_ws('|', o_custkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), o_orderkey, o_orderpriority, o_orderstatus, CAST(o_totalprice AS DECIMAL(18, 2)))) AS h FROM orders),
s AS (SELECT count(*) AS n_rows, sum(CAST(CAST('0x' || substr(h, 1, 15) AS BIGINT) AS HUGEINT)) AS a, sum(CAST(CAST('0x' || substr(h, 17, 15) AS BIGINT) AS HUGEINT)) AS b FROM r)
SELECT n_rows, md5(concat_ws(':', n_rows, a, b)) AS signature FROM s""")
def content_signature(spark, sf):
    own = table(spark, sf, "orders").withColumns({"o_totalprice": F.col("o_totalprice").cast("decimal(18,2)"), "o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")})
    return P.content_signature(own)
