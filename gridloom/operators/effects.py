"""Effects along the paths of fitted equations: products of coefficients, drawn from the coefficients' covariances.

Draws are hashes: a draw's normal numbers come from MD5 of seed, system, equation, term and number of the draw, so that
any engine repeats them, and draws are rows that Spark makes and sums where they are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(*parts: Column) -> Column:
    """A number above 0 and below 1 from texts: the first 52 bits of the MD5 of the joined parts."""
    head = F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 13), 16, 10).cast("double")
    return (head + 0.5) / float(2**52)


def normal(*parts: Column) -> Column:
    """A standard normal number from texts, by the polar form of two uniform ones."""
    return F.sqrt(-2 * F.ln(uniform(*parts, F.lit("r")))) * F.cos(2 * F.lit(float(np.pi)) * uniform(*parts, F.lit("a")))


def cholesky_like(v: np.ndarray) -> np.ndarray:
    """A lower factor of a covariance matrix; one that rounding has left below 0 in a direction is cut there at 0."""
    try:
        return np.linalg.cholesky(v)
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh((v + v.T) / 2)
        if values.min() < -1e-6 * max(values.max(), 1e-300):
            raise ValueError("not a covariance matrix") from None
        return np.linalg.qr((vectors * np.sqrt(np.maximum(values, 0))).T)[1].T


def coefficient_rows(spark: SparkSession, equations: list[tuple[str, str, list[str], np.ndarray, np.ndarray]]) -> DataFrame:
    """system, equation, term, estimate and factor (a row of the covariance's lower factor) of fits (system, equation, terms, estimates, covariance)."""
    rows = []
    for system, equation, terms, estimate, covariance in equations:
        low = cholesky_like(np.asarray(covariance))
        rows += [(system, equation, t, float(b), [float(x) for x in line]) for t, b, line in zip(terms, estimate, low, strict=True)]
    return spark.createDataFrame(rows, "system string, equation string, term string, estimate double, factor array<double>")


def drawn(coefficients: DataFrame, draws: int, seed: int = 2026) -> DataFrame:
    """system, equation, term, draw (0: the estimate itself) and value: estimate plus factor times the equation's normal numbers."""
    number = F.explode(F.sequence(F.lit(0), F.lit(draws))).alias("draw")
    own = coefficients.select("system", "equation", "term", "estimate", "factor", number)
    shift = F.aggregate(F.transform("factor", lambda l, i: l * normal(F.lit(seed), F.col("system"), F.col("equation"), i, F.col("draw"))), F.lit(0.0), lambda a, x: a + x)
    return own.select("system", "equation", "term", "draw", F.when(F.col("draw") == 0, F.col("estimate")).otherwise(F.col("estimate") + shift).alias("value"))


def along(draws: DataFrame, routes: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """system, route, draw and effect: the product of the coefficients (equation, term) of each route."""
    spark = draws.sparkSession
    steps = [(r, len(s), e, t) for r, s in routes.items() for e, t in s]
    plan = F.broadcast(spark.createDataFrame(steps, "route string, steps int, equation string, term string"))
    met = draws.join(plan, ["equation", "term"]).groupBy("system", "route", "draw").agg(F.collect_list("value").alias("v"), F.max("steps").alias("steps"))
    product = F.aggregate("v", F.lit(1.0), lambda a, x: a * x)
    return met.where(F.size("v") == F.col("steps")).select("system", "route", "draw", product.alias("effect"))


def with_totals(effects: DataFrame, direct: list[str]) -> DataFrame:
    """The routes, and for each draw direct, indirect and total: sums over the direct routes, the others, and all."""
    is_direct = F.col("route").isin(*direct)
    sums = effects.groupBy("system", "draw").agg(F.sum(F.when(is_direct, F.col("effect")).otherwise(0.0)).alias("direct"), F.sum(F.when(is_direct, 0.0).otherwise(F.col("effect"))).alias("indirect"), F.sum("effect").alias("total"))
    wide = sums.select("system", "draw", F.inline(F.array(*(F.struct(F.lit(c).alias("route"), F.col(c).alias("effect")) for c in ("direct", "indirect", "total")))))
    return effects.unionByName(wide.select("system", "route", "draw", "effect"))


def summary(effects: DataFrame) -> DataFrame:
    """For each system and route: the estimate (draw 0), mean, standard deviation, 2.5, 50 and 97.5 percentiles of the draws, two-sided p and response ratio.

    p is twice the lesser share of draws on one side of 0, each count raised by one.
    """
    n = F.count_if(F.col("draw") > 0)
    value = F.when(F.col("draw") > 0, F.col("effect"))
    least = F.least(F.count_if((F.col("draw") > 0) & (F.col("effect") <= 0)), F.count_if((F.col("draw") > 0) & (F.col("effect") >= 0)))
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q")
    own = effects.groupBy("system", "route").agg(F.max(F.when(F.col("draw") == 0, F.col("effect"))).alias("estimate"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), q, F.least(F.lit(1.0), 2 * (least + 1) / (n + 1)).alias("p"), n.alias("draws"))
    return own.select("system", "route", "estimate", "mean", "sd", F.get("q", 0).alias("low"), F.get("q", 1).alias("median"), F.get("q", 2).alias("high"), "p", F.exp("estimate").alias("response_ratio"), "draws")
