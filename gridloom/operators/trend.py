"""Trends: pairwise slopes and signs, Kendall and Mann-Kendall tests, step-up false discovery rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalar import normal_two_sided, ratio


def pairs(df: DataFrame, keys: list[str], t: str, y: str) -> DataFrame:
    """All pairs of a group's points with t1 < t2. The keys are an equi-join; a group is a short series."""
    own = df.where(F.col(t).isNotNull() & F.col(y).isNotNull())
    a = own.select(*keys, F.col(t).alias("t1"), F.col(y).cast("double").alias("y1"))
    b = own.select(*keys, F.col(t).alias("t2"), F.col(y).cast("double").alias("y2"))
    return a.join(b, keys).where("t1 < t2")


def sen_slope(df: DataFrame, keys: list[str], t: str, y: str) -> DataFrame:
    """Median of the pairwise slopes, and the median intercept of a line with it."""
    slope = pairs(df, keys, t, y).groupBy(*keys).agg(F.median((F.col("y2") - F.col("y1")) / (F.col("t2") - F.col("t1"))).alias("slope"))
    line = df.join(slope, keys).groupBy(*keys).agg(F.first("slope").alias("slope"), F.median(F.col(y) - F.col("slope") * F.col(t)).alias("intercept"), F.count(y).alias("n"))
    return line


def tie_terms(df: DataFrame, keys: list[str], y: str) -> DataFrame:
    """Sums over groups of equal values (to 12 decimals) that correct the variance and tau-b."""
    m = F.col("m").cast("double")
    ties = df.where(F.col(y).isNotNull()).groupBy(*keys, F.round(y, 12).alias("v")).agg(F.count("*").alias("m"))
    return ties.groupBy(*keys).agg(
        F.sum("m").alias("n"),
        F.sum(m * (m - 1) / 2).alias("tie_pairs"),
        F.sum(m * (m - 1) * (2 * m + 5)).alias("tie_variance"),
    )


def kendall(df: DataFrame, keys: list[str], t: str, y: str, continuity: bool = False, least: int = 3) -> DataFrame:
    """n, s, tau_a, tau_b, z and two-sided normal p of y against distinct times.

    The variance is corrected for ties of y; with continuity, |s| is reduced by one. Series that are shorter
    than `least` have NULL statistics; constant ones have z 0 and p 1."""
    sign = F.signum(F.round("y2", 12) - F.round("y1", 12))
    s = pairs(df, keys, t, y).groupBy(*keys).agg(F.sum(sign).alias("s"))
    own = tie_terms(df, keys, y).join(s, keys, "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    n = F.col("n").cast("double")
    all_pairs = n * (n - 1) / 2
    variance = (n * (n - 1) * (2 * n + 5) - F.col("tie_variance")) / 18
    top = F.col("s") - F.signum("s") if continuity else F.col("s")
    z = F.when(variance > 0, top / F.sqrt(variance)).otherwise(0.0)
    ok = F.col("n") >= least
    return own.select(
        *keys,
        "n",
        F.when(ok, F.col("s")).alias("s"),
        F.when(ok, F.col("s") / all_pairs).alias("tau_a"),
        F.when(ok, ratio(F.col("s"), F.sqrt(all_pairs * (all_pairs - F.col("tie_pairs"))))).alias("tau_b"),
        F.when(ok, z).alias("z"),
        F.when(ok, F.when(z == 0, 1.0).otherwise(normal_two_sided(z))).alias("p"),
    )


def exact_p(n: Column, s: Column) -> Column:
    """Exact two-sided p of Kendall's s for n distinct values of short series, from the counts of orders by inversions.

    The counts for k values are running sums over k neighbours of those for k - 1; they are kept as shares of all orders.
    """
    one = F.array(F.lit(1.0))

    def longer(acc: Column, k: Column) -> Column:
        def at(j: Column) -> Column:
            low = F.greatest(F.lit(0), j - k + 1)
            return F.aggregate(F.slice(acc, low + 1, F.least(j + 1, F.size(acc)) - low), F.lit(0.0), lambda a, x: a + x) / k

        return F.transform(F.sequence(F.lit(0), F.size(acc) + k - 2), at)

    shares = F.aggregate(F.when(n >= 2, F.sequence(F.lit(2), n.cast("int"))).otherwise(F.array().cast("array<int>")), one, longer)
    every = n * (n - 1) / 2
    few = F.least((every - s) / 2, (every + s) / 2).cast("int")
    tail = F.aggregate(F.slice(shares, 1, few + 1), F.lit(0.0), lambda a, x: a + x)
    return F.least(F.lit(1.0), 2 * tail)


def kendall_small(df: DataFrame, keys: list[str], t: str, y: str, most: int = 33) -> DataFrame:
    """n, s, tau_b, p and whether p is exact: it is for series of up to `most` points without equal values, else normal."""
    own = kendall(df, keys, t, y).select(*keys, F.col("n").cast("int"), "s", "tau_b", F.col("p").alias("normal_p"))
    distinct = df.where(F.col(y).isNotNull()).groupBy(*keys).agg(F.count_distinct(F.round(y, 12)).alias("_d"))
    own = own.join(distinct, keys)
    exact = (F.col("_d") == F.col("n")) & (F.col("n") <= most) & (F.col("n") >= 3)
    return own.select(*keys, "n", "s", "tau_b", F.when(exact, exact_p(F.col("n"), F.col("s"))).otherwise(F.col("normal_p")).alias("p"), exact.alias("exact"))


def step_up(df: DataFrame, family: list[str], p: str, order: list[str], name: str = "q") -> DataFrame:
    """Benjamini-Hochberg q values within each family; NULL p stay NULL and don't count.

    A family is a set of tests, not of rows: its window is small."""
    w = Window.partitionBy(*family)
    ranked = df.withColumns({"_k": F.when(F.col(p).isNotNull(), F.row_number().over(w.orderBy(F.col(p).asc_nulls_last(), *order))), "_m": F.count(p).over(w)})
    raw = F.col(p) * F.col("_m") / F.col("_k")
    least = F.min(raw).over(w.orderBy(F.col(p).desc_nulls_first(), *(F.col(o).desc() for o in order)).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), least))).drop("_k", "_m")


def ols_slope(t: str, y: str) -> Column:
    return F.regr_slope(F.col(y).cast("double"), F.col(t).cast("double"))


def runs(df: DataFrame, keys: list[str], t: str, active: Column) -> DataFrame:
    """Islands of consecutive active times: first, last and length of each."""
    own = df.where(active).select(*keys, F.col(t).cast("long").alias("t")).distinct()
    island = F.col("t") - F.row_number().over(Window.partitionBy(*keys).orderBy("t"))
    return own.withColumn("island", island).groupBy(*keys, "island").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("length")).drop("island")


def longest_runs(df: DataFrame, keys: list[str], t: str, active: Column) -> DataFrame:
    """Length of the longest run of each group and all the runs that have it."""
    own = runs(df, keys, t, active)
    top = own.withColumn("_top", F.max("length").over(Window.partitionBy(*keys))).where("length = _top")
    text = F.concat(F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string"))
    return top.groupBy(*keys).agg(F.max("length").alias("longest"), F.array_join(F.array_sort(F.collect_list(text)), ";").alias("runs"))
