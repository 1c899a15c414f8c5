"""Calendar windows, interval joins and their weights, curve peaks and threshold intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalar import circular_distance, ratio


def months_of(windows: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """windows with a row for each month that they touch and the days that lie in it.

    The months are made from the window, so that a join by month is an equi-join and not one by range."""
    month = F.explode(F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month")))
    out = windows.withColumn("month", month)
    days = F.date_diff(F.least(F.col(end), F.last_day("month")), F.greatest(F.col(start), F.col("month"))) + 1
    return out.withColumn("days", days)


def window_mean(windows: DataFrame, series: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Day-weighted mean of a monthly series over each window, of the months that have a value, and the days covered."""
    own = months_of(windows).join(series, "month")
    v = F.when(F.col("value").isNotNull(), F.col("days"))
    return own.groupBy(*by, *keys).agg(ratio(F.sum(F.col("value") * F.col("days")), F.sum(v)).alias("mean"), F.sum(v).alias("days"))


def lag_windows(years: DataFrame, season_start: Column, lags: tuple[int, ...] = (30, 60, 90)) -> DataFrame:
    """window, start and end: the days before a season's first day, and the winter before it (1 December to 12 February)."""
    end = F.date_sub(season_start, 1)
    cells = [F.struct(F.lit(f"Lag{n}").alias("window"), F.date_sub(season_start, n).alias("start"), end.alias("end")) for n in lags]
    cells.append(F.struct(F.lit("PreWinter").alias("window"), F.make_date(F.col("year") - 1, F.lit(12), F.lit(1)).alias("start"), F.make_date(F.col("year"), F.lit(2), F.lit(12)).alias("end")))
    return years.select("*", F.inline(F.array(*cells)))


def in_interval(points: DataFrame, intervals: DataFrame, x: str, label: str, default: str) -> DataFrame:
    """Label of the interval (first, last: a short dimension) that holds x, else the default."""
    out = points.join(intervals.select(F.col("first").alias("_a"), F.col("last").alias("_b"), label), (F.col(x) >= F.col("_a")) & (F.col(x) <= F.col("_b")), "left")
    return out.withColumn(label, F.coalesce(label, F.lit(default))).drop("_a", "_b")


def activity_index(df: DataFrame, parts: list[str]) -> DataFrame:
    """Mean of the parts, each over its maximum."""
    top = df.agg(*(F.max(c).alias(f"_t_{c}") for c in parts))
    mean = sum((ratio(F.col(c), F.col(f"_t_{c}")) for c in parts), F.lit(0.0)) / len(parts)
    return df.crossJoin(F.broadcast(top)).withColumn("index", mean).drop(*(f"_t_{c}" for c in parts))


def circular_smooth(df: DataFrame, t: str, x: str, n: int, half_width: int) -> DataFrame:
    """Circular moving average of 2 * half_width + 1 steps; every step of 1..n must be there."""
    near = df.select(F.explode(F.sequence(F.col(t) - half_width, F.col(t) + half_width)).alias("_t"), F.col(x).alias("_x"))
    mean = near.groupBy((F.pmod(F.col("_t") - 1, F.lit(n)) + 1).alias(t)).agg(F.avg("_x").alias("smooth"))
    return df.join(mean, t)


def local_peaks(df: DataFrame, t: str, x: str, n: int) -> DataFrame:
    """Steps of a circular curve 1..n that are above both neighbours."""
    side = lambda d: df.select((F.pmod(F.col(t) + d - 1, F.lit(n)) + 1).alias(t), F.col(x).alias("_after" if d < 0 else "_before"))
    return df.join(side(1), t).join(side(-1), t).where((F.col(x) > F.col("_before")) & (F.col(x) > F.col("_after"))).drop("_before", "_after")


def separate_peaks(peaks: DataFrame, t: str, x: str, n: int, distance: int, top: int) -> DataFrame:
    """The highest peaks that are `distance` apart at least on the circle: greedy, as an array fold over one curve's peaks."""
    cells = peaks.agg(F.array_sort(F.collect_list(F.struct((-F.col(x)).alias("k"), F.col(t).alias("t")))).alias("p"))
    step = lambda acc, s: F.when(F.exists(acc, lambda a: circular_distance(a["t"], s["t"], n) < distance), acc).otherwise(F.concat(acc, F.array(s)))
    kept = F.aggregate("p", F.slice("p", 1, 0), step)
    return cells.select(F.posexplode(F.slice(kept, 1, top)).alias("rank", "c")).select((F.col("rank") + 1).alias("rank"), F.col("c.t").alias(t), (-F.col("c.k")).alias(x))


def tumbling(df: DataFrame, keys: list[str], ts: str, width: str, value: str) -> DataFrame:
    """Counts and sums in tumbling windows; the same call serves streams with a watermark."""
    return df.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sliding(df: DataFrame, keys: list[str], ts: str, width: str, slide: str, value: str) -> DataFrame:
    return df.groupBy(F.window(ts, width, slide).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(df: DataFrame, keys: list[str], ts: str, gap: str) -> DataFrame:
    return df.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def ordered_text(df: DataFrame, keys: list[str], order: str, text: Column, by: str = ";") -> DataFrame:
    """Texts of a short group joined in order."""
    cells = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("s"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(cells, lambda c: c["s"]), by).alias("text"))


def running_rank(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group by a full order."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)
