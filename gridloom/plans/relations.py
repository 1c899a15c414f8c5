"""Panel-like relations built from the input tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalar import ratio
from gridloom.sources.tables import table


def ev(spark: SparkSession, sf: str) -> DataFrame:
    """Detections: fire_id, country, year (day of month), season (a third of the day), frp (the value)."""
    h = F.hour("ts")
    return table(spark, sf, "events").select(F.col("event_id").alias("fire_id"), F.col("event_type").alias("country"), F.dayofmonth("ts").alias("year"), F.when(h < 8, 1).when(h < 16, 2).otherwise(3).alias("season"), F.col("value").alias("frp"))


def doy(spark: SparkSession, sf: str) -> DataFrame:
    """Day-of-year curves 1..366 of order counts and totals, 0 where there is none."""
    own = table(spark, sf, "orders").groupBy(F.dayofyear("o_orderdate").alias("doy")).agg(F.count("*").alias("fire_count"), F.sum("o_totalprice").alias("burned_area"))
    return spark.range(1, 367).select(F.col("id").cast("int").alias("doy")).join(own, "doy", "left").select("doy", F.coalesce("fire_count", F.lit(0)).alias("fire_count"), F.coalesce("burned_area", F.lit(0.0)).alias("burned_area"))


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier x year x season panel: exposure, two counts and five covariates.

    Line items are summed by the supplier's number before they meet the suppliers: a task's sums then have three short keys, and
    one row for each group goes through the joins. A supplier that is there k times counts k times, its means stay.
    """
    t = lambda n: table(spark, sf, n)
    season = ((F.month("l_shipdate") - 1) / 4).cast("int") + 1
    own = t("lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("year"), season.alias("season"))
    own = own.agg(
        F.count("*").alias("pixels"),
        F.count_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45)).alias("fire_count"),
        F.count_if((F.col("l_discount") >= 0.09) & (F.col("l_tax") >= 0.07)).alias("burned_count"),
        F.avg("l_quantity").alias("x1"),
        F.avg("l_discount").alias("x2"),
        F.avg("l_tax").alias("x3"),
        F.avg("l_extendedprice").alias("x4"),
    )
    own = own.join(t("supplier"), F.expr("l_suppkey = s_suppkey")).join(t("nation"), F.expr("s_nationkey = n_nationkey")).join(t("region"), F.expr("n_regionkey = r_regionkey"))
    return own.groupBy(F.col("l_suppkey").alias("grid_uid"), F.col("r_name").alias("country"), "year", "season").agg(
        *(F.sum(c).alias(c) for c in ("pixels", "fire_count", "burned_count")),
        *(F.max(c).alias(c) for c in ("x1", "x2", "x3", "x4")),
        F.max("s_acctbal").alias("x5"),
    )


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly index by order priority in units of 10,000, with a sentinel in the first month of each."""
    own = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("index"), F.trunc("o_orderdate", "month").alias("month")).agg((F.avg("o_totalprice") / 10000).alias("value"))
    return own.withColumn("value", F.when(F.col("month") == F.lit("1995-01-01").cast("date"), -999.0).otherwise(F.col("value")))


def oof(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold predictions of three rate models for the panel's fire counts: model, fold, observed, predicted, p."""
    own = panel(spark, sf).select("grid_uid", "country", "year", "season", (F.col("year") % 5 + 1).alias("fold"), F.col("pixels").alias("exposure"), F.col("fire_count").alias("observed"))

    def rates(keys: list[str], name: str) -> DataFrame:
        cell = own.groupBy(*keys, "fold").agg(F.sum("observed").alias("y"), F.sum("exposure").alias("e"), F.count_if(F.col("observed") > 0).alias("k"), F.count("*").alias("n"))
        whole = cell.groupBy(*keys).agg(*(F.sum(c).alias(f"all_{c}") for c in "yekn"))
        out = cell.join(whole, keys)
        return out.select(*keys, "fold", ratio(F.expr("all_y - y"), F.expr("all_e - e")).alias(f"rate_{name}"), ratio(F.expr("all_k - k"), F.expr("all_n - n")).alias(f"p_{name}"))

    wide = own.join(rates(["season"], "season"), ["season", "fold"]).join(rates(["season", "country"], "country"), ["season", "country", "fold"]).join(rates(["season", "grid_uid"], "grid"), ["season", "grid_uid", "fold"])
    cells = F.array(
        *(
            F.struct(F.lit(m).alias("model"), F.coalesce(f"rate_{m}", "rate_country", "rate_season").alias("rate"), F.coalesce(f"p_{m}", "p_country", "p_season").alias("p"))
            for m in ("season", "country", "grid")
        )
    )
    keep = ["grid_uid", "country", "year", "season", "fold", "exposure", "observed"]
    return wide.select(*keep, F.inline(cells)).select("model", *keep, (F.col("rate") * F.col("exposure")).alias("predicted"), "p")


def pts(spark: SparkSession, sf: str) -> DataFrame:
    """Points in a plane with a value and a region."""
    e = lambda k: F.element_at("embedding", k).cast("double")
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("grid_uid"), e(1).alias("x"), e(2).alias("y"), e(3).alias("value"), F.col("label").alias("region"))


def region_class(spark: SparkSession, sf: str) -> DataFrame:
    """Regions by year in four classes of the grids' fire rate, by its place in the year's quartiles."""
    own = panel(spark, sf).groupBy("country", "year", "grid_uid").agg((F.sum("fire_count") / F.sum("pixels")).alias("rate"))
    cut = own.groupBy("year").agg(*(F.percentile("rate", F.lit(q)).alias(f"c{k}") for k, q in enumerate((0.25, 0.5, 0.75), 1)))
    hs = F.when(F.col("rate") > F.col("c3"), 3).when(F.col("rate") > F.col("c2"), 2).when(F.col("rate") > F.col("c1"), 1).otherwise(0)
    return own.join(cut, "year").groupBy("country", "year", hs.alias("hs_bin")).agg(F.count("*").alias("n"))


_PANEL = """panel AS (
  SELECT l_suppkey AS grid_uid, r_name AS country, CAST(year(l_shipdate) AS INTEGER) AS year, CAST((month(l_shipdate) - 1) // 4 + 1 AS INTEGER) AS season,
    count(*) AS pixels, CAST(count_if(l_returnflag = 'R' AND l_quantity >= 45) AS BIGINT) AS fire_count, CAST(count_if(l_discount >= 0.09 AND l_tax >= 0.07) AS BIGINT) AS burned_count,
    avg(l_quantity) AS x1, avg(l_discount) AS x2, avg(l_tax) AS x3, avg(l_extendedprice) AS x4, max(s_acctbal) AS x5
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL)"""


def _rate(keys: str, name: str) -> str:
    return f"""rate_{name} AS (
  SELECT {keys}, fold, CASE WHEN ae - e > 0 THEN CAST(ay - y AS DOUBLE) / (ae - e) END AS rate, CASE WHEN an - n > 0 THEN CAST(ak - k AS DOUBLE) / (an - n) END AS p
  FROM (SELECT *, sum(y) OVER w AS ay, sum(e) OVER w AS ae, sum(k) OVER w AS ak, sum(n) OVER w AS an
        FROM (SELECT {keys}, fold, sum(observed) AS y, sum(exposure) AS e, count_if(observed > 0) AS k, count(*) AS n FROM base GROUP BY ALL) WINDOW w AS (PARTITION BY {keys})))"""


#: SQL of the relations: each text is a list of common table expressions.
SQL = {
    "ev": """ev AS (SELECT event_id AS fire_id, event_type AS country, CAST(day(ts) AS INTEGER) AS year, CASE WHEN hour(ts) < 8 THEN 1 WHEN hour(ts) < 16 THEN 2 ELSE 3 END AS season, value AS frp FROM events)""",
    "doy": """doy AS (
  SELECT CAST(d AS INTEGER) AS doy, coalesce(fire_count, 0) AS fire_count, coalesce(burned_area, 0.0) AS burned_area FROM range(1, 367) AS r(d)
  LEFT JOIN (SELECT dayofyear(o_orderdate) AS o, count(*) AS fire_count, sum(o_totalprice) AS burned_area FROM orders GROUP BY 1) ON o = d)""",
    "panel": _PANEL,
    "monthly": """monthly AS (
  SELECT o_orderpriority AS index, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CASE WHEN CAST(date_trunc('month', o_orderdate) AS DATE) = DATE '1995-01-01' THEN -999.0 ELSE avg(o_totalprice) / 10000 END AS value
  FROM orders GROUP BY 1, 2)""",
    "oof": f"""{_PANEL}, base AS (SELECT grid_uid, country, year, season, year % 5 + 1 AS fold, pixels AS exposure, fire_count AS observed FROM panel),
{_rate("season", "season")}, {_rate("season, country", "country")}, {_rate("season, grid_uid", "grid")},
oof AS (
  SELECT model, grid_uid, country, year, season, fold, exposure, observed, rate * exposure AS predicted, p FROM (
    SELECT 'season' AS model, b.*, s.rate, s.p FROM base b JOIN rate_season s USING (season, fold)
    UNION ALL SELECT 'country', b.*, coalesce(c.rate, s.rate), coalesce(c.p, s.p) FROM base b JOIN rate_season s USING (season, fold) JOIN rate_country c USING (season, country, fold)
    UNION ALL SELECT 'grid', b.*, coalesce(g.rate, c.rate, s.rate), coalesce(g.p, c.p, s.p) FROM base b JOIN rate_season s USING (season, fold) JOIN rate_country c USING (season, country, fold) JOIN rate_grid g USING (season, grid_uid, fold)))""",
    "pts": """pts AS (SELECT vec_id AS grid_uid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS value, label AS region FROM embeddings)""",
    "region_class": f"""{_PANEL}, grid_rate AS (SELECT country, year, grid_uid, CAST(sum(fire_count) AS DOUBLE) / sum(pixels) AS rate FROM panel GROUP BY ALL),
cut AS (SELECT year, quantile_cont(rate, 0.25) AS c1, quantile_cont(rate, 0.5) AS c2, quantile_cont(rate, 0.75) AS c3 FROM grid_rate GROUP BY year),
region_class AS (SELECT country, year, CASE WHEN rate > c3 THEN 3 WHEN rate > c2 THEN 2 WHEN rate > c1 THEN 1 ELSE 0 END AS hs_bin, count(*) AS n FROM grid_rate JOIN cut USING (year) GROUP BY ALL)""",
}


def sql(relation: str, body: str) -> str:
    """A query whose first common table expressions are the relation's; body may go on with ', name AS (...)'."""
    return f"WITH {SQL[relation]}{'' if body.lstrip().startswith(',') else ' '}{body}"
