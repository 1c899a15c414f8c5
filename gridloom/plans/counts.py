"""Queries: count regressions on the panel, their probabilities and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import counts as K
from gridloom.operators import panel as P
from gridloom.operators.models import blocks
from gridloom.plans.descriptive import rounded
from gridloom.plans.relations import panel, pts, sql
from gridloom.sources.scratch import checkpointed

QUERIES, ORACLE_SQL = {}, {}
_X = ["x1_z", "x5_z"]


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def _scaled(spark, sf):
    return P.zscore(panel(spark, sf), [], ["x1", "x5"], population=True).select("grid_uid", "year", "season", "fire_count", "pixels", *_X)


def _nb1_sql(y: str) -> str:
    return f"(lgamma({y} + m / 0.5) - lgamma(m / 0.5) - lgamma({y} + 1) - m / 0.5 * ln(1.5) + {y} * (ln(0.5) - ln(1.5)))"


@query("count_log_pmf", sql("panel", f""", t AS (SELECT CAST(sum(fire_count) AS DOUBLE) / sum(pixels) AS rate FROM panel), r AS (SELECT season, fire_count AS y, pixels * rate AS m FROM panel, t)
SELECT season, round(sum({_nb1_sql('y')}), 6) AS nb1, round(sum(lgamma(y + 2) - lgamma(2) - lgamma(y + 1) - 2 * ln(1 + 0.5 * m) + y * (ln(0.5 * m) - ln(1 + 0.5 * m))), 6) AS nb2,
  round(sum(CASE WHEN y > 0 THEN {_nb1_sql('y')} - ln(1 - exp(-m / 0.5 * ln(1.5))) END), 6) AS truncated, round(avg(exp(-m / 0.5 * ln(1.5))), 6) AS nb1_zero, round(avg(exp(-2 * ln(1 + 0.5 * m))), 6) AS nb2_zero,
  round(avg(0.7 * m / (1 - exp(-m / 0.5 * ln(1.5)))), 6) AS hurdle_expected FROM r GROUP BY season"""))
def count_log_pmf(spark, sf):
    """Log probabilities and zero probabilities of the families at a dispersion of 0.5 and the overall rate."""
    own = panel(spark, sf)
    rate = own.agg((F.sum("fire_count") / F.sum("pixels")).alias("rate"))
    own = own.crossJoin(F.broadcast(rate)).select("season", F.col("fire_count").cast("double").alias("y"), (F.col("pixels") * F.col("rate")).alias("m"))
    y, m, a = F.col("y"), F.col("m"), F.lit(0.5)
    nb1 = K.log_pmf(y, m, a)
    zero = K.zero_probability(m, a)
    return rounded(own.groupBy("season").agg(F.sum(nb1).alias("nb1"), F.sum(K.log_pmf(y, m, a, "nb2")).alias("nb2"), F.sum(F.when(y > 0, nb1 - F.ln(1 - zero))).alias("truncated"), F.avg(zero).alias("nb1_zero"), F.avg(K.zero_probability(m, a, "nb2")).alias("nb2_zero"), F.avg(K.hurdle_expected(m, a, F.lit(0.7))).alias("hurdle_expected")))


@query("nb1_rate")
def nb1_rate(spark, sf):
    return rounded(K.wald_table(spark, K.fit(_scaled(spark, sf), "nb1", _X, "fire_count", "pixels")), 4)


@query("truncated_nb1_rate")
def truncated_nb1_rate(spark, sf):
    """The count part of the hurdle: positive counts only."""
    return rounded(K.wald_table(spark, K.fit(_scaled(spark, sf), "ztnb1", _X, "fire_count", "pixels")), 4)


@query("zinb1_rate")
def zinb1_rate(spark, sf):
    return rounded(K.wald_table(spark, K.fit(_scaled(spark, sf), "zinb1", _X, "fire_count", "pixels")), 4)


@query("count_family_comparison")
def count_family_comparison(spark, sf):
    own = _scaled(spark, sf)
    return rounded(K.compare(spark, K.fit_families(own, ["nb1", "nb2", "zinb1"], _X, "fire_count", "pixels")), 3)


@query("two_way_wald")
def two_way_wald(spark, sf):
    """Wald tests of the NB1 rates with errors clustered by unit and by year, with one degree of freedom less than the fewer clusters."""
    own = checkpointed(_scaled(spark, sf))
    model = K.fit(own, "nb1", _X, "fire_count", "pixels")
    covariance, found = K.two_way_covariance(own, model, _X, "fire_count", "pixels", "grid_uid", "year")
    return rounded(K.wald_table(spark, model, covariance, min(found["grid_uid"], found["year"]) - 1), 4)


def _folds(spark, sf):
    """The scaled panel with temporal folds by year, and spatial ones by k-means blocks of the units' places."""
    own = _scaled(spark, sf)
    block = blocks(pts(spark, sf).where(F.col("x").isNotNull() & F.col("y").isNotNull()), "x", "y", 4).select("grid_uid", F.col("block").cast("long").alias("spatial"))
    return own.join(block, "grid_uid").withColumn("temporal", (F.col("year") % 3).cast("long"))


@query("oof_count_families")
def oof_count_families(spark, sf):
    """Mean log score, error and Brier score of NB1, hurdle and zero-inflated NB1 on rows that their fits did not see, by season and kind of fold."""
    own, out, kinds, families = checkpointed(_folds(spark, sf)), None, ("temporal", "spatial"), ("nb1", "hurdle", "zinb1")
    jobs = [j for kind in kinds for j in K.fold_jobs(families, [], kind)]
    fits = dict(zip(jobs, K.fit_jobs(own, jobs, _X, "fire_count", "pixels"), strict=True))
    for kind in kinds:
        mine = {j.family: f for j, f in fits.items() if j.fold == kind}
        for family in families:
            part = K.out_of_fold(own, family, _X, "fire_count", "pixels", [], kind, fits=mine).select(F.lit(kind).alias("folds"), F.lit(family).alias("family"), "season", "fire_count", "expected", "positive", "log_p")
            out = part if out is None else out.unionByName(part)
    miss, hit = F.col("expected") - F.col("fire_count"), F.col("positive") - (F.col("fire_count") > 0).cast("double")
    return rounded(out.groupBy("folds", "family", "season").agg(F.count("*").alias("n"), (-F.avg("log_p")).alias("log_loss"), F.sqrt(F.avg(miss * miss)).alias("rmse"), F.avg(hit * hit).alias("brier")), 4)
