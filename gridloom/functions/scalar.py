"""Scalar column expressions that Spark lacks or that need guards."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """NaN and infinities as NULL."""
    inf = F.lit(float("inf"))
    return F.when(~F.isnan(x) & (x != inf) & (x != -inf), x)


def ratio(a: Column, b: Column, positive: bool = True) -> Column:
    """a / b in doubles; NULL if b is NULL, 0, or (positive) below 0."""
    b = b.cast("double")
    return F.when(b > 0 if positive else b != 0, a.cast("double") / b)


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def integer_like(x: Column, tolerance: float = 1e-9) -> Column:
    return F.abs(x - F.rint(x)) <= tolerance


def log1p_guarded(x: Column) -> Column:
    """log1p, NULL below 0."""
    return F.when(x >= 0, F.log1p(x))


def logit(p: Column, eps: float = 1e-6) -> Column:
    p = clip(p, eps, 1 - eps)
    return F.ln(p) - F.log1p(-p)


def expit(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def logaddexp(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def log1mexp(x: Column) -> Column:
    """ln(1 - exp(-x)) for x > 0."""
    return F.when(x > 0, F.when(x < 0.6931471805599453, F.ln(-F.expm1(-x))).otherwise(F.log1p(-F.exp(-x))))


def polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    """Horner form, highest power first."""
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


#: Rational Chebyshev fit of erfc, fractional error below 1.2e-7 everywhere.
_ERFC = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)


def erfc(x: Column) -> Column:
    """Complementary error function; relative error below 1.2e-7."""
    z = F.abs(x)
    t = 1 / (1 + 0.5 * z)
    tail = t * F.exp(-z * z + polynomial(t, _ERFC))
    return F.when(x >= 0, tail).otherwise(2 - tail)


def normal_two_sided(z: Column) -> Column:
    return erfc(F.abs(z) / F.lit(2.0**0.5))


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided tail of Student's t for whole degrees of freedom: the finite cosine series, beyond 2,000 a normal form.

    The normal form (Wallace) has an absolute error below 1e-7 there.
    """
    x, v = F.abs(t), df.cast("double")
    c2 = v / (v + x * x)
    sine, cosine, angle = F.sqrt(1 - c2), F.sqrt(c2), F.atan(x / F.sqrt(v))
    odd = F.pmod(df.cast("long"), F.lit(2)) == 1
    terms = F.when(odd, F.floor((v - 3) / 2)).otherwise(F.floor((v - 2) / 2)).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc: Column, k: Column) -> Column:
        factor = F.when(odd, (2 * k) / (2 * k + 1.0)).otherwise((2 * k - 1) / (2.0 * k)) * c2
        return F.struct((acc["term"] * factor).alias("term"), (acc["total"] + acc["term"] * factor).alias("total"))

    ks = F.when((terms >= 1) & (v <= 2000), F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    series = F.aggregate(ks, start, step)["total"]
    inside = F.when(odd, (angle + F.when(v > 1, sine * cosine * series).otherwise(0.0)) * (2 / math.pi)).otherwise(sine * series)
    far = normal_two_sided(F.sqrt(v * F.log1p(x * x / v)) * (8 * v + 1) / (8 * v + 3))
    return F.when(v >= 1, F.when(v > 2000, far).otherwise(F.greatest(F.lit(0.0), 1 - inside)))


def correlation_p(r: Column, df: Column) -> Column:
    """Two-sided p of a correlation with df degrees of freedom; 0 at +-1, NULL without any."""
    t = r * F.sqrt(df / (1 - r * r))
    return F.when(df >= 1, F.when(F.abs(r) >= 1 - 1e-12, 0.0).otherwise(t_two_sided(t, df)))


#: Lanczos coefficients for g = 7, n = 9.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def lgamma(x: Column) -> Column:
    """ln of the gamma function for x >= 0.5; NULL below."""
    y = x - 1
    total = reduce(lambda acc, k: acc + F.lit(_LANCZOS[k]) / (y + k), range(1, 9), F.lit(_LANCZOS[0]))
    t = y + 7.5
    return F.when(x >= 0.5, 0.9189385332046727 + (y + 0.5) * F.ln(t) - t + F.ln(total))


def digamma(x: Column) -> Column:
    """Derivative of lgamma for x > 0, by the recurrence up to x + 6 and the asymptotic series."""
    shift = reduce(lambda acc, k: acc + 1 / (x + k), range(1, 6), 1 / x)
    y = x + 6
    f = 1 / (y * y)
    return F.when(x > 0, F.ln(y) - 0.5 / y - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132)))) - shift)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of a group, NULL if a side is constant (corr() raises there under ANSI rules)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 1e-14, F.covar_pop(a, b) / spread)


def circular_distance(a: Column, b: Column, n: int) -> Column:
    d = F.abs(a - b)
    return F.least(d, n - d)


def doy_date(year: Column, doy: Column) -> Column:
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (doy - 1).cast("int"))


def doy_label(doy: Column) -> Column:
    """Month and day in a common year; days beyond 365 are the last one."""
    return F.date_format(F.date_add(F.lit("2001-01-01").cast("date"), (F.least(doy, F.lit(365)) - 1).cast("int")), "MMM d")


def truth(text: Column) -> Column:
    """Boolean of a text: true, 1, yes, y against false, 0, no, n and the empty text; others NULL."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "1", "yes", "y"), True).when(low.isin("false", "0", "no", "n", ""), False)


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9]+", "_")


def split_list(text: Column, by: str = ";") -> Column:
    """Distinct trimmed parts in their first order."""
    return F.array_distinct(F.filter(F.transform(F.split(text, by), F.trim), lambda s: s != ""))


def trend_label(tau: Column, p: Column, alpha: float = 0.05) -> Column:
    return F.when(tau.isNull() | p.isNull(), "undetermined").when((p < alpha) & (tau > 0), "increase").when((p < alpha) & (tau < 0), "decrease").otherwise("no trend")


def percent_improvement(candidate: Column, reference: Column) -> Column:
    return F.when(reference != 0, 100 * (reference - candidate) / F.abs(reference))


def close(a: Column, b: Column, absolute: float = 1e-9, relative: float = 0.0) -> Column:
    return F.abs(a - b) <= absolute + relative * F.abs(b)


def geometric_mean(a: Column, b: Column) -> Column:
    return F.when((a >= 0) & (b >= 0), F.sqrt(a * b))


def text_seed(*parts: Column) -> Column:
    """A seed from texts: the first 8 bytes of the SHA-256 of the joined parts, little-endian, modulo 2**32 - 1."""
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    swapped = F.concat(*(F.substring(digest, 2 * k + 1, 2) for k in range(7, -1, -1)))
    return F.pmod(F.conv(swapped, 16, 10).cast("decimal(20,0)"), F.lit(2**32 - 1)).cast("long")
