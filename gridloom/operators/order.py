"""Totals, numbers and quantiles along an order, without all rows of a group in one task.

Values are dealt to ranges of the order; a range is summed where it is, and only the ranges' totals meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.sources.scratch import checkpointed

RANGES = 64


def _ranges(df: DataFrame, order: str, ranges: int) -> DataFrame:
    """df with _range: the number of cuts of the order below the value. Equal values share a range; NULL goes to the first.

    The cuts come from one approximate quantile sketch of all rows, which only decides how even the ranges are.
    """
    cuts = df.agg(F.percentile_approx(F.col(order).cast("double"), F.array(*(F.lit(k / ranges) for k in range(1, ranges))), F.lit(2000)).alias("_cuts"))
    at = F.size(F.filter(F.array_distinct("_cuts"), lambda c: c < F.col(order).cast("double")))
    return df.crossJoin(F.broadcast(cuts)).withColumn("_range", F.coalesce(at, F.lit(0))).drop("_cuts")


def running_totals(df: DataFrame, keys: list[str], order: str, values: list[str], ranges: int = RANGES) -> DataFrame:
    """df with before_<v> for each value v: its sum over the rows of the group with a smaller order.

    df has one row for each group and distinct order, as a count by value has: a range holds distinct values only.
    It is read three times, so it should be written out (checkpointed) if it is dear.
    """
    own = _ranges(df, order, ranges)
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parts = own.groupBy(*keys, "_range").agg(*(F.sum(v).alias(f"_p_{v}") for v in values))
    below = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_range").alias("_at"), *(F.coalesce(F.sum(f"_p_{v}").over(below), F.lit(0)).alias(f"_b_{v}") for v in values))
    met = F.col("_range") == F.col("_at")
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = own.withColumns({f"_i_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}).join(parts, met)
    out = out.withColumns({f"before_{v}": F.col(f"_i_{v}") + F.col(f"_b_{v}") for v in values})
    return out.drop("_range", "_at", *(f"_k_{k}" for k in keys), *(f"_{x}_{v}" for x in "ib" for v in values))


def numbered(df: DataFrame, keys: list[str], hash_: Column, ties: list[str], name: str, bits: int = 8) -> DataFrame:
    """df with name: 0 to n - 1 in each group by the order of a 64-bit hash, read without its sign.

    A hash is even over its values, so its first bits are the ranges.
    """
    own = df.withColumn("_h", hash_).withColumn("_range", F.shiftrightunsigned("_h", 64 - bits).cast("int"))
    parts = own.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    below = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "_range", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_range").orderBy("_h", *ties)
    return own.withColumn("_i", F.row_number().over(inside) - 1).join(parts, [*keys, "_range"]).withColumn(name, F.col("_i") + F.col("_before")).drop("_h", "_range", "_i", "_before")


def exact_quantiles(df: DataFrame, keys: list[str], x: str, qs: list[float]) -> DataFrame:
    """n and quantiles (an array like qs) of x in each group, exact, interpolated between order statistics.

    Equal values are counted first; then each quantile reads the one or two values at its place.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("_x")).agg(F.count("*").alias("_n"))
    counts = checkpointed(counts)
    own = running_totals(counts, keys, "_x", ["_n"])
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    own = own.join(total, keys) if keys else own.crossJoin(F.broadcast(total))
    places = F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(float(q)) * (F.col("_all") - 1)).alias("h")) for i, q in enumerate(qs)))
    own = own.select(*keys, "_x", "_all", "before__n", "_n", F.explode(places).alias("_p"))
    low, part = F.floor("_p.h"), F.col("_p.h") - F.floor("_p.h")
    end = F.col("before__n") + F.col("_n")
    is_low = (F.col("before__n") <= low) & (low < end)
    high = F.least(low + 1, F.col("_all") - 1)
    is_high = (F.col("before__n") <= high) & (high < end)
    own = own.where(is_low | is_high).groupBy(*keys, "_p.i").agg(F.max("_all").alias("n"), F.max(F.when(is_low, F.col("_x"))).alias("a"), F.max(F.when(is_high, F.col("_x"))).alias("b"), F.max(part).alias("t"))
    value = F.struct("i", (F.col("a") + F.col("t") * (F.col("b") - F.col("a"))).alias("q"))
    return own.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(value)), lambda s: s["q"]).alias("quantiles"))
