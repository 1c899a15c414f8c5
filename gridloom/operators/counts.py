"""Count regressions by maximum likelihood: NB1, NB2, zero-truncated NB1, hurdle and zero-inflated NB1, with offset.

Probabilities and scores of rows are columns; fits are those of count_fits, with the observed information.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalar import digamma, expit, lgamma, log1mexp, normal_two_sided, ratio, t_two_sided
from gridloom.operators.count_fits import Fit, Job, clipped, fit_jobs, fit_many, linear, parameters
from gridloom.sources.scratch import checkpointed


def _gamma_ratio(y: Column, r: Column) -> Column:
    """ln of gamma(y + r) / gamma(r), by one step of the recurrence where r is small."""
    return F.when(y > 0, lgamma(y + r) - lgamma(r + 1) + F.ln(r)).otherwise(0.0)


def nb1_terms(y: Column, mean: Column, alpha: Column) -> dict[str, Column]:
    """Log probability, its derivatives by ln(mean) and ln(alpha), and ln P(0) with its own: variance is (1 + alpha) mean."""
    r = mean / alpha
    low = F.log1p(alpha)
    psi = F.when(y > 0, digamma(y + r) - digamma(r)).otherwise(0.0)
    by_r = psi - low
    return {
        "ll": _gamma_ratio(y, r) - lgamma(y + 1) - r * low + y * (F.ln(alpha) - low),
        "d_mean": by_r * r,
        "d_alpha": -by_r * r - r * alpha / (1 + alpha) + y / (1 + alpha),
        "ln0": -r * low,
        "ln0_mean": -r * low,
        "ln0_alpha": r * low - r * alpha / (1 + alpha),
    }


def nb2_terms(y: Column, mean: Column, alpha: Column) -> dict[str, Column]:
    """The same for a variance of mean + alpha mean^2."""
    r = 1 / alpha
    low = F.log1p(alpha * mean)
    psi = F.when(y > 0, digamma(y + r) - digamma(r)).otherwise(0.0)
    return {
        "ll": _gamma_ratio(y, r) - lgamma(y + 1) - r * low + F.when(y > 0, y * (F.ln(alpha * mean) - low)).otherwise(0.0),
        "d_mean": (y - mean) / (1 + alpha * mean),
        "d_alpha": -psi * r + r * low + (y - mean) / (1 + alpha * mean),
        "ln0": -r * low,
        "ln0_mean": -mean / (1 + alpha * mean),
        "ln0_alpha": r * low - mean / (1 + alpha * mean),
    }


def log_pmf(y: Column, mean: Column, alpha: Column, kind: str = "nb1") -> Column:
    return (nb1_terms if kind == "nb1" else nb2_terms)(y, mean, alpha)["ll"]


def zero_probability(mean: Column, alpha: Column, kind: str = "nb1") -> Column:
    return F.exp((nb1_terms if kind == "nb1" else nb2_terms)(F.lit(0.0), mean, alpha)["ln0"])


def _linear(theta: np.ndarray, features: list[str]) -> Column:
    out = F.lit(float(theta[0]))
    for b, c in zip(theta[1:], features, strict=True):
        out = out + F.lit(float(b)) * F.col(c)
    return out


def scores(df: DataFrame, family: str, features: list[str], zero_features: list[str], theta: np.ndarray) -> DataFrame:
    """df (_y, _off) with _ll and the score of each row by parameter: _s0, _s1, ...

    Parameters: intercept and features of ln(mean), ln(alpha), and (zinb1) intercept and features of the logit of an
    extra zero.
    """
    k = len(features) + 1
    y = F.col("_y")
    own = df.withColumns({"_mean": F.exp(_linear(theta[:k], features) + F.col("_off")), "_alpha": F.lit(float(np.exp(theta[k])))})
    t = (nb2_terms if family == "nb2" else nb1_terms)(y, F.col("_mean"), F.col("_alpha"))
    ll, d_mean, d_alpha, d_zero = t["ll"], t["d_mean"], t["d_alpha"], None
    if family == "ztnb1":
        odds = 1 / F.expm1(-t["ln0"])  # P(0) / (1 - P(0))
        ll, d_mean, d_alpha = ll - log1mexp(-t["ln0"]), d_mean + odds * t["ln0_mean"], d_alpha + odds * t["ln0_alpha"]
    elif family == "zinb1":
        eta = _linear(theta[k + 1 :], zero_features)
        pi = expit(eta)
        p0 = F.exp(t["ln0"])
        whole = pi + (1 - pi) * p0
        share = (1 - pi) * p0 / whole
        none = y == 0
        ll = F.when(none, F.ln(whole)).otherwise(F.ln(1 - pi) + ll)
        d_mean = F.when(none, share * t["ln0_mean"]).otherwise(d_mean)
        d_alpha = F.when(none, share * t["ln0_alpha"]).otherwise(d_alpha)
        d_zero = F.when(none, pi * (1 - pi) * (1 - p0) / whole).otherwise(-pi)
    own = own.withColumns({"_ll": ll, "_dm": d_mean, "_da": d_alpha, **({"_dz": d_zero} if d_zero is not None else {})})
    parts = [F.col("_dm"), *(F.col("_dm") * F.col(c) for c in features), F.col("_da")]
    parts += [F.col("_dz"), *(F.col("_dz") * F.col(c) for c in zero_features)] if d_zero is not None else []
    return own.withColumns({f"_s{i}": p for i, p in enumerate(parts)})


def _sums(scored: DataFrame, n: int) -> tuple[float, np.ndarray, np.ndarray, int]:
    s = [F.col(f"_s{i}") for i in range(n)]
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    row = scored.agg(F.sum("_ll"), *(F.sum(c) for c in s), *(F.sum(s[i] * s[j]) for i, j in pairs), F.count("*")).first()
    values = np.array([np.nan if v is None else float(v) for v in row])
    outer = np.zeros((n, n))
    for (i, j), v in zip(pairs, values[1 + n : -1], strict=True):
        outer[i, j] = outer[j, i] = v
    return values[0], values[1 : 1 + n], outer, int(row[-1])


def prepared(df: DataFrame, features: list[str], y: str, exposure: str, positive_only: bool = False) -> DataFrame:
    """Rows that can enter a fit: _y, _off (log exposure) and the features as doubles; incomplete rows are left out."""
    own = df.select(F.col(y).cast("double").alias("_y"), F.ln(F.col(exposure).cast("double")).alias("_off"), *(F.col(c).cast("double") for c in features)).where(F.col(exposure) > 0)
    own = own.dropna()
    return own.where("_y > 0") if positive_only else own


def fit(df: DataFrame, family: str, features: list[str], y: str, exposure: str, zero_features: list[str] | None = None) -> Fit:
    """Maximum likelihood of nb1, nb2, ztnb1 (positive counts only) or zinb1 from three starts; features should be of about unit scale."""
    return fit_many(df, family, features, y, exposure, zero_features=zero_features)[0]


def fit_families(df: DataFrame, families: list[str], features: list[str], y: str, exposure: str, zero_features: list[str] | None = None) -> list[Fit]:
    """fit() of several families on the same rows, in common passes."""
    return [f[0] for f in fit_jobs(df, [Job(f) for f in families], features, y, exposure, zero_features)]


def wald_table(spark, model: Fit, covariance: np.ndarray | None = None, df: int | None = None) -> DataFrame:
    """term, estimate, se, z, p, interval and exp(estimate) of each parameter, with the likelihood, AIC and rows of the fit.

    With df, tails and intervals are Student's with that many degrees of freedom (for clusters: their number less 1). A variance
    that is not above 0 has no error: se and what follows are NULL.
    """
    v = model.covariance if covariance is None else covariance
    rows = [(model.family, t, float(b), float(np.sqrt(s)) if s > 0 else None, model.loglik, model.aic, model.rows, model.settled and model.identified) for t, b, s in zip(model.names, model.estimate, np.diag(v), strict=True)]
    own = spark.createDataFrame(rows, "family string, term string, estimate double, se double, loglik double, aic double, n long, valid boolean")
    z = ratio(F.col("estimate"), F.col("se"))
    wide = 1.959963984540054 if df is None else t_quantile(0.975, df)
    p = normal_two_sided(z) if df is None else t_two_sided(z, F.lit(df))
    return own.withColumns({"z": z, "p": p, "low": F.col("estimate") - wide * F.col("se"), "high": F.col("estimate") + wide * F.col("se"), "ratio": F.exp("estimate")})


def t_quantile(q: float, df: int) -> float:
    """The quantile of Student's t for whole degrees of freedom, by bisection of its distribution function."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        angle = math.atan(mid / math.sqrt(df))
        total, term = 0.0, math.cos(angle) if df % 2 else 1.0
        for k in range(1 if df % 2 else 0, df - 1, 2):
            total += term
            term *= (k + 1) / (k + 2) * math.cos(angle) ** 2
        inside = (2 / math.pi) * (angle + math.sin(angle) * total) if df % 2 else math.sin(angle) * total
        low, high = (mid, high) if (1 + inside) / 2 < q else (low, mid)
    return (low + high) / 2


def two_way_covariance(df: DataFrame, model: Fit, features: list[str], y: str, exposure: str, first: str, second: str, zero_features: list[str] | None = None) -> tuple[np.ndarray, dict]:
    """(covariance robust to two kinds of clusters, numbers of clusters and clipped directions).

    The bread is the inverse of the observed information. Scores are summed by cluster of each kind and of both; each kind's cross
    products have the factor G / (G - 1) * (n - 1) / (n - k), those of both are taken away, and what is below 0 in a
    direction is clipped. Only parameters' numbers reach the driver.
    """
    n, zero = len(model.names), list(zero_features or [])
    own = df.select(F.col(first).alias("_c1"), F.col(second).alias("_c2"), F.col(y).cast("double").alias("_y"), F.ln(F.col(exposure).cast("double")).alias("_off"), *(F.col(c).cast("double") for c in sorted({*features, *zero}))).where(F.col(exposure) > 0).dropna()
    own = own.where("_y > 0") if model.family == "ztnb1" else own
    scored = scores(own, model.family, features, zero, model.estimate).select("_c1", "_c2", *(f"_s{i}" for i in range(n)))
    scored = checkpointed(scored.groupBy("_c1", "_c2").agg(*(F.sum(f"_s{i}").alias(f"_s{i}") for i in range(n))))  # each kind's sums follow from those of both
    meat, found = np.zeros((n, n)), {}
    for keys, name, sign in ((["_c1"], first, 1), (["_c2"], second, 1), (["_c1", "_c2"], "both", -1)):
        summed = scored.groupBy(*keys).agg(*(F.sum(f"_s{i}").alias(f"_s{i}") for i in range(n))).withColumn("_ll", F.lit(0.0))
        _, _, outer, groups = _sums(summed, n)
        if groups < 2:
            raise ValueError(f"{name}: at least two clusters are needed")
        found[name] = groups
        meat += sign * outer * groups / (groups - 1) * (model.rows - 1) / (model.rows - n)
    covariance, found["clipped"] = clipped(model.covariance @ meat @ model.covariance)
    return covariance, found


def compare(spark, fits: list[Fit]) -> DataFrame:
    """family, parameters, log likelihood, AIC, its distance to the least, and rows."""
    best = min(f.aic for f in fits)
    rows = [(f.family, len(f.names), f.loglik, f.aic, f.aic - best, f.rows, f.gradient) for f in fits]
    return spark.createDataFrame(rows, "family string, n_parameters int, loglik double, aic double, delta_aic double, n long, score double")


def hurdle_expected(mean: Column, alpha: Column, positive: Column) -> Column:
    """Expected count of a hurdle: P(y > 0) times the mean of the zero-truncated NB1."""
    return positive * mean / -F.expm1(nb1_terms(F.lit(0.0), mean, alpha)["ln0"])


def fold_jobs(families: list[str], keys: list[str], fold: str) -> list[Job]:
    """The jobs whose fits out_of_fold() takes for families; a hurdle has two."""
    parts = dict.fromkeys(p for f in families for p in (("ztnb1", "occurrence") if f == "hurdle" else (f,)))
    return [Job(p, tuple(keys), fold) for p in parts]


def out_of_fold(df: DataFrame, family: str, features: list[str], y: str, exposure: str, keys: list[str], fold: str, zero_features: list[str] | None = None, fits: dict[str, list[Fit]] | None = None) -> DataFrame:
    """df with expected, positive (chance of a count above 0) and log_p of each complete row, by fits on the other folds of its keys.

    family: nb1, nb2, zinb1, or hurdle (occurrence times zero-truncated NB1). All folds and keys are fitted at once; the fits are a
    small table that rows meet by key and fold. fits: those of fold_jobs() by family, where several calls share their passes.
    """
    spark, zero = df.sparkSession, list(zero_features or [])
    key = F.concat_ws("|", *(F.col(c).cast("string") for c in keys)) if keys else F.lit("")
    own = df.where(F.col(exposure) > 0).dropna(subset=[y, *features, *zero, fold]).withColumns({"_k": key, "_f": F.col(fold).cast("long")})
    count, k = ("ztnb1" if family == "hurdle" else family), len(features) + 1
    if fits is None:
        jobs = fold_jobs([family], keys, fold)
        fits = dict(zip((j.family for j in jobs), fit_jobs(df, jobs, features, y, exposure, zero), strict=True))
    own = own.join(F.broadcast(parameters(spark, fits[count], "_b")), ["_k", "_f"])
    mean, alpha, n = F.exp(linear("_b", features) + F.ln(F.col(exposure).cast("double"))), F.exp(F.get("_b", k)), F.col(y).cast("double")
    t = (nb2_terms if family == "nb2" else nb1_terms)(n, F.col("_m"), F.col("_a"))
    if family == "hurdle":
        own = own.join(F.broadcast(parameters(spark, fits["occurrence"], "_o")), ["_k", "_f"])
        p = expit(linear("_o", features))
        own = own.withColumns({"_m": mean, "_a": alpha, "positive": p})
        out = {"expected": hurdle_expected(F.col("_m"), F.col("_a"), F.col("positive")), "log_p": F.when(n == 0, F.ln(1 - F.col("positive"))).otherwise(F.ln("positive") + t["ll"] - log1mexp(-t["ln0"]))}
    else:
        pi = expit(linear("_b", zero, k + 1)) if family == "zinb1" else F.lit(0.0)
        own = own.withColumns({"_m": mean, "_a": alpha, "_z": pi})
        whole = F.col("_z") + (1 - F.col("_z")) * F.exp(t["ln0"])
        out = {"expected": (1 - F.col("_z")) * F.col("_m"), "positive": 1 - whole, "log_p": F.when(n == 0, F.ln(whole)).otherwise(F.ln(1 - F.col("_z")) + t["ll"])}
    return own.withColumns(out).drop("_k", "_f", "_b", "_o", "_m", "_a", "_z")
