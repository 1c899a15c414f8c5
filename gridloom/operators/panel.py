"""Panel aggregation: grouped summaries, complete grids, shares, moments, missingness, checks, scaling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalar import integer_like, ratio
from gridloom.operators.order import exact_quantiles


def quantile(x: str, q: float) -> Column:
    """Exact quantile with linear interpolation between order statistics."""
    return F.percentile(F.col(x).cast("double"), F.lit(q))


def value_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, total, mean, median and p95 of value in each group."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.median(value).alias("median"), quantile(value, 0.95).alias("p95"))


def with_total_level(df: DataFrame, level: str, label) -> DataFrame:
    """Each row once with its level and once with the total level, for summaries of all levels and their union in one scan."""
    return df.withColumn(level, F.explode(F.array(F.col(level), F.lit(label).cast(df.schema[level].dataType))))


def complete(df: DataFrame, dimensions: list[DataFrame], keys: list[str], zeros: list[str]) -> DataFrame:
    """df on the full grid of the dimension tables (small ones), its measures 0 where a cell has no row."""
    grid = reduce(lambda a, b: a.crossJoin(b), dimensions)
    out = grid.join(df, keys, "left")
    return out.withColumns({z: F.coalesce(F.col(z), F.lit(0).cast(df.schema[z].dataType)) for z in zeros})


def shares(df: DataFrame, period: list[str], measures: list[str]) -> DataFrame:
    """Percent of each period's total, NULL where that is 0."""
    w = Window.partitionBy(*period)
    return df.withColumns({f"{m}_share": 100 * ratio(F.col(m), F.sum(m).over(w)) for m in measures})


def moments(x: str) -> dict[str, Column]:
    """Bias-corrected skewness and excess kurtosis, sample SD; NULL where a group is too small or constant."""
    n = F.count(x).cast("double")
    sd = F.stddev_samp(x)
    g1, g2 = F.skewness(x), F.kurtosis(x)
    return {
        "sd": sd,
        "skewness": F.when((n > 2) & (sd > 0), g1 * F.sqrt(n * (n - 1)) / (n - 2)),
        "kurtosis": F.when((n > 3) & (sd > 0), ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))),
    }


def distribution(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Distribution table of a count by group."""
    positive = F.when(F.col(x) > 0, F.col(x))
    m = moments(x)
    return df.groupBy(*keys).agg(
        F.count(x).alias("n"),
        (100 * ratio(F.count_if(F.col(x) == 0), F.count(x))).alias("zero_percent"),
        F.avg(x).alias("mean"),
        *(c.alias(k) for k, c in m.items()),
        F.min(x).alias("least"),
        F.median(x).alias("median"),
        *(quantile(x, q).alias(f"q{int(100 * q)}") for q in (0.9, 0.95, 0.99)),
        F.max(x).alias("greatest"),
        F.avg(positive).alias("positive_mean"),
        F.median(positive).alias("positive_median"),
        ratio(F.var_samp(x), F.avg(x)).alias("dispersion"),
    )


def poisson_fit(df: DataFrame, keys: list[str], y: str, exposure: str) -> DataFrame:
    """Intercept-only Poisson model with exposure: rate, Pearson chi-square over df, expected zero share."""
    total = df.groupBy(*keys).agg(ratio(F.sum(y), F.sum(exposure)).alias("rate"))
    mu = F.col("rate") * F.col(exposure)
    own = df.join(total, keys)
    return own.groupBy(*keys).agg(
        F.first("rate").alias("rate"),
        ratio(F.sum(ratio((F.col(y) - mu) * (F.col(y) - mu), mu)), F.count("*") - 1).alias("pearson_over_df"),
        F.avg((F.col(y) == 0).cast("double")).alias("observed_zero"),
        F.avg(F.exp(-mu)).alias("expected_zero"),
    )


def missingness(df: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """n_missing, percent missing and distinct values of every variable by group, in one aggregation."""
    cells = F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in variables))
    long = df.select(*keys, F.inline(cells))
    n = F.count("*")
    return long.groupBy(*keys, "variable").agg(n.alias("n"), (n - F.count("value")).alias("n_missing"), (100 * ratio(n - F.count("value"), n)).alias("missing_percent"), F.count_distinct("value").alias("n_unique"))


def inventory(df: DataFrame, variables: list[str], near_zero: float = 1e-12) -> DataFrame:
    """A profile of each numeric column and why it might be left out."""
    cells = F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in variables))
    long = df.select(F.inline(cells))
    out = long.groupBy("variable").agg(
        F.count("*").alias("n"), (F.count("*") - F.count("x")).alias("n_missing"), F.count_distinct("x").alias("n_unique"), F.min("x").alias("least"), F.max("x").alias("greatest"),
        F.avg("x").alias("mean"), moments("x")["skewness"].alias("skewness"), ratio(F.count_if(F.col("x") == 0), F.count("x")).alias("zero_rate"), ratio(F.count_if(F.col("x") < 0), F.count("x")).alias("negative_rate"), F.var_pop("x").alias("_v"),
    )
    at = exact_quantiles(long, ["variable"], "x", [0.25, 0.5, 0.75]).select("variable", *(F.get("quantiles", k).alias(c) for k, c in enumerate(("q25", "median", "q75"))))
    out = out.join(at, "variable", "left")
    reason = F.when(F.col("n_missing") == F.col("n"), "all missing").when(F.col("n_unique") <= 1, "constant").when(F.col("_v") <= near_zero, "near-zero variance").otherwise("")
    advice = F.when((F.abs("skewness") >= 2) & (F.col("least") >= 0), "log1p").when(F.abs("skewness") >= 2, "power").otherwise("none")
    return out.withColumns({"exclusion": reason, "transformation": advice}).drop("_v")


def anomalies(df: DataFrame, keys: list[str], responses: list[str]) -> DataFrame:
    """One row for each response that is missing, negative or not an integer."""
    issue = lambda c: F.when(F.col(c).isNull(), "missing").when(F.col(c) < 0, "negative").when(~integer_like(F.col(c)), "not an integer")
    cells = F.array(*(F.struct(F.lit(c).alias("response"), F.col(c).cast("double").alias("value"), issue(c).alias("issue")) for c in responses))
    return df.select(*keys, F.inline(F.filter(cells, lambda s: s["issue"].isNotNull())))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def expectations(df: DataFrame, keys: list[str], domains: dict[str, list], n_rows: int | None = None) -> DataFrame:
    """One row of booleans: keys are unique, and each column stays in its domain, and the row count is as locked."""
    tests = [F.count_if(~F.coalesce(F.col(c).isin(values), F.lit(False))) == 0 for c, values in domains.items()]
    whole = df.agg(*(t.alias(f"{c}_in_domain") for c, t in zip(domains, tests, strict=True)), (F.count("*") == (n_rows if n_rows is not None else F.count("*"))).alias("row_count_ok"))
    unique = df.groupBy(*keys).agg(F.count("*").alias("n")).agg((F.coalesce(F.max("n"), F.lit(0)) <= 1).alias("keys_unique"))
    return whole.crossJoin(unique)


def require(checks: DataFrame) -> None:
    """Raise, naming the checks of a one-row table of booleans that don't hold."""
    row = checks.first().asDict()
    if bad := [k for k, ok in row.items() if ok is not True]:
        raise ValueError(f"failed: {', '.join(bad)}")


def constant_within(df: DataFrame, unit: str, variables: list[str]) -> DataFrame:
    """Units in which a variable that should be constant has several values (NULL counts as one)."""
    cells = F.array(*(F.struct(F.lit(v).alias("variable"), F.coalesce(F.col(v).cast("string"), F.lit("\0")).alias("value")) for v in variables))
    return df.select(unit, F.inline(cells)).groupBy(unit, "variable").agg(F.count_distinct("value").alias("n_values")).where("n_values > 1")


def time_support(df: DataFrame, unit: list[str], time: str, first: int, last: int) -> DataFrame:
    """Years that each unit has and lacks, and whether it has all."""
    every = F.sequence(F.lit(first), F.lit(last))
    out = df.groupBy(*unit).agg(F.array_sort(F.collect_set(F.col(time).cast("int"))).alias("_y"))
    gone = F.array_except(every, "_y")
    return out.select(*unit, F.size("_y").alias("n_years"), F.array_join(F.col("_y").cast("array<string>"), ";").alias("years"), F.array_join(gone.cast("array<string>"), ";").alias("missing_years"), (F.size(gone) == 0).alias("complete"))


def zscore(df: DataFrame, groups: list[str], variables: list[str], population: bool = False) -> DataFrame:
    """Standard scores by group from the rows in which all variables are there; constant variables give NULL."""
    whole = reduce(lambda a, b: a & b, (F.col(v).isNotNull() for v in variables))
    sd = F.stddev_pop if population else F.stddev_samp
    own = df.where(whole).groupBy(*groups).agg(*(F.avg(v).alias(f"_m_{v}") for v in variables), *(sd(v).alias(f"_s_{v}") for v in variables))
    out = df.join(own, groups, "left") if groups else df.crossJoin(F.broadcast(own))
    return out.withColumns({f"{v}_z": ratio(F.col(v) - F.col(f"_m_{v}"), F.col(f"_s_{v}")) for v in variables}).drop(*(f"_{k}_{v}" for k in "ms" for v in variables))


def zscore_held_out(df: DataFrame, fold: str, x: str) -> DataFrame:
    """df with x standardised, in each fold, by mean and population SD of the rows of all other folds.

    The moments of the others follow from those of each fold and of all: no row is copied.
    """
    part = df.where(F.col(x).isNotNull()).groupBy(fold).agg(F.count(x).alias("n"), F.avg(x).alias("m"), (F.var_pop(x) * F.count(x)).alias("s"))
    whole = part.agg(F.sum("n").alias("all_n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("all_m"))
    apart = F.col("m") - F.col("all_m")
    own = part.crossJoin(F.broadcast(whole)).withColumn("d", F.col("n") * apart * apart + F.col("s"))
    own = own.crossJoin(F.broadcast(own.agg(F.sum("d").alias("all_d"))))
    k = F.col("all_n") - F.col("n")
    mean = ratio(F.col("all_n") * F.col("all_m") - F.col("n") * F.col("m"), k)
    # squared deviations from the grand mean, moved to the mean of the others
    spread = F.sqrt(F.greatest(F.lit(0.0), ratio(F.col("all_d") - F.col("d"), k) - (mean - F.col("all_m")) * (mean - F.col("all_m"))))
    own = own.select(fold, mean.alias("_mean"), spread.alias("_sd"))
    return df.join(own, fold).withColumn(f"{x}_z", ratio(F.col(x) - F.col("_mean"), F.col("_sd"))).drop("_mean", "_sd")


def one_hot(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """A 0/1 column for each level given (leave out the reference)."""
    return df.withColumns({f"{column}_{re_name(level)}": F.coalesce((F.col(column) == level).cast("int"), F.lit(0)) for level in levels})


def re_name(text: str) -> str:
    return "".join(c if c.isalnum() else "_" for c in text)


def contribution(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Sums and shares of two components and how often one, the other or both are positive."""
    p, q = F.col(a) > 0, F.col(b) > 0
    out = df.groupBy(*keys).agg(F.sum(a).alias("a_sum"), F.sum(b).alias("b_sum"), F.count_if(p & ~q).alias("only_a"), F.count_if(q & ~p).alias("only_b"), F.count_if(p & q).alias("both"))
    return out.withColumn("a_share", 100 * ratio(F.col("a_sum"), F.col("a_sum") + F.col("b_sum")))


def separation(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Ranges of x where y is positive and where it is 0, and whether they part the two."""
    yes, no = F.when(F.col(y) > 0, F.col(x)), F.when(F.col(y) == 0, F.col(x))
    out = df.groupBy(*keys).agg(F.min(yes).alias("pos_min"), F.max(yes).alias("pos_max"), F.min(no).alias("zero_min"), F.max(no).alias("zero_max"))
    overlap = F.greatest(F.lit(0.0), F.least("pos_max", "zero_max") - F.greatest("pos_min", "zero_min"))
    span = F.greatest("pos_max", "zero_max") - F.least("pos_min", "zero_min")
    return out.withColumns({"overlap": ratio(overlap, span), "separated": (F.col("pos_min") > F.col("zero_max")) | (F.col("zero_min") > F.col("pos_max"))})


def content_signature(df: DataFrame) -> DataFrame:
    """n_rows and a signature of a table's rows whatever their order: sums of the two halves of each row's MD5.

    Rows are digested where they are and only sums move, so memory does not grow with the table. Columns go by name.
    """
    row = F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in sorted(df.columns))))
    half = lambda at: F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)"))
    parts = df.agg(F.count("*").alias("n_rows"), F.coalesce(half(1), F.lit(0)).cast("string").alias("a"), F.coalesce(half(17), F.lit(0)).cast("string").alias("b"))
    return parts.select("n_rows", F.md5(F.concat_ws(":", F.col("n_rows").cast("string"), "a", "b")).alias("signature"))
