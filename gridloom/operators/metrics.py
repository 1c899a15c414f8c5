"""Prediction metrics, rankings, calibration and model comparison, as aggregations by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalar import clip, correlation, percent_improvement, ratio
from gridloom.operators.order import exact_quantiles, running_totals
from gridloom.sources.scratch import checkpointed


def error_metrics(y: str = "observed", f: str = "predicted") -> dict[str, Column]:
    """RMSE, MAE, median absolute error, bias, R2, totals and their ratio."""
    e = F.col(f) - F.col(y)
    n = F.count(e)
    sse = F.sum(e * e)
    sst = F.var_pop(y) * n
    return {
        "n": n,
        "rmse": F.sqrt(F.avg(e * e)),
        "mae": F.avg(F.abs(e)),
        "median_ae": F.median(F.abs(e)),
        "bias": F.avg(e),
        "r2": F.when(sst > 1e-12, 1 - sse / sst),
        "total_observed": F.sum(y),
        "total_predicted": F.sum(f),
        "total_ratio": ratio(F.sum(f), F.sum(y)),
    }


def occurrence_metrics(p: str = "p", y: str = "observed") -> dict[str, Column]:
    """Brier score, that of the constant share, skill, and log loss of P(y > 0)."""
    o = (F.col(y) > 0).cast("double")
    q = clip(F.col(p), 1e-6, 1 - 1e-6)
    brier, null = F.avg((F.col(p) - o) * (F.col(p) - o)), F.var_pop(o)
    return {"brier": brier, "brier_null": null, "brier_skill": F.when(null > 0, 1 - brier / null), "log_loss": -F.avg(o * F.ln(q) + (1 - o) * F.ln(1 - q))}


def metric_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """All metrics of each group in one aggregation."""
    return df.groupBy(*keys).agg(*(c.alias(k) for k, c in {**error_metrics(), **occurrence_metrics()}.items()))


def fold_summary(folds: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean, SD and standard error over folds of each metric, long."""
    long = folds.select(*keys, F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics))))
    n, sd = F.count("v"), F.stddev_samp("v")
    return long.groupBy(*keys, "metric").agg(F.avg("v").alias("mean"), sd.alias("sd"), (sd / F.sqrt(n.cast("double"))).alias("se"), n.alias("n_folds"))


def score_counts(df: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """Positives and negatives at each distinct score: what ROC and PR need, in one partial aggregation."""
    return df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))


def roc_auc(df: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """Tie-aware area under the ROC curve; NULL with one class only."""
    own = running_totals(checkpointed(score_counts(df, keys, score, positive)), keys, score, ["neg"])
    won = F.sum(F.col("pos") * (F.col("before_neg") + 0.5 * F.col("neg")))
    return own.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), won.alias("won")).select(*keys, "n_pos", "n_neg", ratio(F.col("won"), F.col("n_pos") * F.col("n_neg")).alias("auc"))


def average_precision(df: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """Step sum of precision over the rises of recall, thresholds from the top."""
    counts = score_counts(df, keys, score, positive).withColumn("from_top", -F.col(score))
    own = running_totals(checkpointed(counts), keys, "from_top", ["pos", "neg"])
    own = own.withColumns({"tp": F.col("before_pos") + F.col("pos"), "fp": F.col("before_neg") + F.col("neg")})
    return own.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("s")).select(*keys, "n_pos", ratio(F.col("s"), F.col("n_pos")).alias("average_precision"))


def quantile_bins(df: DataFrame, keys: list[str], x: str, bins: int) -> DataFrame:
    """df with bin: right-closed intervals between the distinct linear quantiles of x in each group."""
    cuts = exact_quantiles(df, keys, x, [k / bins for k in range(1, bins)]).select(*keys, F.array_distinct("quantiles").alias("_cuts"))
    own = df.join(cuts, keys) if keys else df.crossJoin(F.broadcast(cuts))
    return own.withColumn("bin", F.size(F.filter("_cuts", lambda c: c < F.col(x))) + 1).drop("_cuts")


def calibration(df: DataFrame, keys: list[str], p: str = "p", y: str = "observed", bins: int = 10) -> DataFrame:
    own = quantile_bins(df.where(F.col(p).isNotNull()), keys, p, bins)
    o = (F.col(y) > 0).cast("double")
    return own.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.min(p).alias("p_min"), F.avg(p).alias("p_mean"), F.max(p).alias("p_max"), F.avg(o).alias("observed_share"), (F.avg(o) - F.avg(p)).alias("gap"))


def expected_error(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Expected calibration error: gaps weighted by bin size."""
    return bins.groupBy(*keys).agg((F.sum(F.col("n") * F.abs("gap")) / F.sum("n")).alias("ece"))


def extremes(df: DataFrame, keys: list[str], q: float = 0.9, y: str = "observed", f: str = "predicted") -> DataFrame:
    """Metrics on the rows at or above the quantile q of the positive observations of each group."""
    cut = df.where(F.col(y) > 0).groupBy(*keys).agg(F.percentile(F.col(y).cast("double"), F.lit(q)).alias("threshold"))
    own = df.join(cut, keys).where(F.col(y) >= F.col("threshold"))
    m = error_metrics(y, f)
    return own.groupBy(*keys).agg(F.first("threshold").alias("threshold"), *(m[k].alias(k) for k in ("n", "rmse", "mae", "bias", "total_ratio")))


def top_overlap(df: DataFrame, keys: list[str], n: int, order: list[str], y: str = "observed", f: str = "predicted") -> DataFrame:
    """Share of the n greatest observations that are among the n greatest predictions; order breaks ties."""
    w = Window.partitionBy(*keys)
    own = df.select(*keys, F.row_number().over(w.orderBy(F.col(y).desc(), *order)).alias("ry"), F.row_number().over(w.orderBy(F.col(f).desc(), *order)).alias("rf"))
    return own.groupBy(*keys).agg((F.count_if((F.col("ry") <= n) & (F.col("rf") <= n)) / F.lit(float(n))).alias("overlap"))


def ranks(df: DataFrame, group: list[str], metric: str, lower_is_better: Column, digits: int = 12) -> DataFrame:
    """Competition rank (NULL unranked) and average rank of metric within a group, on rounded values."""
    v = F.round(metric, digits)
    key = F.when(lower_is_better, v).otherwise(-v)
    w = Window.partitionBy(*group)
    least = F.rank().over(w.orderBy(key.asc_nulls_last()))
    same = F.count("*").over(Window.partitionBy(*group, v))
    return df.withColumns({"rank_min": F.when(v.isNotNull(), least), "rank_average": F.when(v.isNotNull(), least + (same - 1) / 2.0)})


def wins(ranked: DataFrame, keys: list[str]) -> DataFrame:
    return ranked.groupBy(*keys).agg(F.count_if(F.col("rank_min") == 1).alias("wins"), F.sum("rank_average").alias("rank_sum"), F.count("rank_min").alias("n_ranked"))


def paired(df: DataFrame, keys: list[str], member: str, metric: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """candidate, reference, their metric, difference and percent improvement for fixed pairs of members."""
    spark = df.sparkSession
    pair = F.broadcast(spark.createDataFrame(pairs, "candidate string, reference string"))
    a = df.select(*keys, F.col(member).alias("candidate"), F.col(metric).alias("candidate_value"))
    b = df.select(*keys, F.col(member).alias("reference"), F.col(metric).alias("reference_value"))
    out = a.join(pair, "candidate").join(b, [*keys, "reference"])
    return out.withColumns({"difference": F.col("candidate_value") - F.col("reference_value"), "improvement": percent_improvement(F.col("candidate_value"), F.col("reference_value"))})


def cluster_sums(df: DataFrame, keys: list[str], y: str = "observed", f: str = "predicted", p: str = "p") -> DataFrame:
    """Sufficient statistics of each cluster for resampled metrics."""
    e, o = F.col(f) - F.col(y), (F.col(y) > 0).cast("double")
    q = clip(F.col(p), 1e-6, 1 - 1e-6)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(-(o * F.ln(q) + (1 - o) * F.ln(1 - q))).alias("nll"), F.sum((F.col(p) - o) * (F.col(p) - o)).alias("brier"), F.sum(e * e).alias("se"), F.sum(F.abs(e)).alias("ae"), F.sum(y).alias("observed"), F.sum(f).alias("predicted"))


def icc(df: DataFrame, keys: list[str], cluster: list[str], x: str) -> DataFrame:
    """One-way intraclass correlation with n0 for unequal clusters, signed and cut to [0, 1], and the design effect."""
    own = df.where(F.col(x).isNotNull()).groupBy(*keys, *cluster).agg(F.count(x).alias("n"), F.avg(x).alias("m"), (F.var_pop(x) * F.count(x)).alias("w"))
    g = own.groupBy(*keys).agg(F.count("*").alias("k"), F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum("w").alias("ssw"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), F.lit(2)) / F.sum("n")).alias("ssb"))
    msb, msw = ratio(F.col("ssb"), F.col("k") - 1), ratio(F.col("ssw"), F.col("t") - F.col("k"))
    n0 = ratio(F.col("t") - F.col("n2") / F.col("t"), F.col("k") - 1)
    own = g.withColumns({"msb": msb, "msw": msw, "n0": n0})
    r = ratio(F.col("msb") - F.col("msw"), F.col("msb") + (F.col("n0") - 1) * F.col("msw"), positive=False)
    return own.select(*keys, F.col("k").alias("clusters"), F.col("t").alias("n"), r.alias("icc"), clip(r, 0.0, 1.0).alias("icc_cut"), (1 + (F.col("n0") - 1) * clip(r, 0.0, 1.0)).alias("design_effect"))


def lag_one(df: DataFrame, keys: list[str], unit: list[str], t: str, x: str) -> DataFrame:
    """Correlation of x with its value a time step before, over contiguous pairs within units."""
    w = Window.partitionBy(*keys, *unit).orderBy(t)
    own = df.select(*keys, F.col(x).alias("x"), F.lag(x).over(w).alias("b"), (F.col(t) - F.lag(t).over(w)).alias("step")).where("step = 1 and x is not null and b is not null")
    return own.groupBy(*keys).agg(F.count("*").alias("n_pairs"), correlation(F.col("x"), F.col("b")).alias("pearson"))


def unit_residuals(df: DataFrame, keys: list[str], t: str = "year", y: str = "observed", f: str = "predicted", e: str = "exposure") -> DataFrame:
    """Residual statistics of each unit."""
    r = F.col(y) - F.col(f)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_distinct(t).alias("n_years"), F.min(t).alias("first_year"), F.max(t).alias("last_year"), F.sum(y).alias("observed"), F.sum(f).alias("predicted"), F.sum(e).alias("exposure"),
        F.sum(r).alias("residual_sum"), F.avg(r).alias("residual_mean"), F.median(r).alias("residual_median"), F.stddev_samp(r).alias("residual_sd"), F.avg(F.abs(r)).alias("mae"), F.sqrt(F.avg(r * r)).alias("rmse"), ratio(F.sum(r), F.sum(e)).alias("rate_residual"),
    )


def gates(df: DataFrame, group: list[str], loss: str, absolute: float, relative: float, order: list[str]) -> DataFrame:
    """Difference to the least loss of the group, equivalence to it, and the simplest equivalent member by order."""
    w = Window.partitionBy(*group)
    own = df.withColumn("delta", F.col(loss) - F.min(loss).over(w))
    own = own.withColumn("equivalent", (F.col("delta") <= absolute) & (F.col("delta") <= relative * F.abs(F.min(loss).over(w))))
    first = F.row_number().over(w.orderBy(F.col("equivalent").desc(), *order))
    return own.withColumn("selected", first == 1)


def one_standard_error(folds: DataFrame, group: list[str], member: str, fold: str, loss: str, baseline: str) -> DataFrame:
    """Fold differences to the baseline member: mean, standard error, worst fold, better folds, non-inferiority."""
    base = folds.where(F.col(member) == baseline).select(*group, fold, F.col(loss).alias("_b"))
    d = F.col(loss) - F.col("_b")
    out = folds.where(F.col(member) != baseline).join(base, [*group, fold]).groupBy(*group, member).agg(F.avg(d).alias("mean_difference"), (F.stddev_samp(d) / F.sqrt(F.count(d).cast("double"))).alias("se"), F.max(d).alias("worst"), F.count_if(d < 0).alias("better_folds"), F.count(d).alias("n_folds"))
    return out.withColumn("non_inferior", F.col("mean_difference") <= F.col("se"))


def percentile_interval(draws: DataFrame, keys: list[str], value: str, level: float = 0.95) -> DataFrame:
    """Percentile interval of resampled differences, the share below 0, and whether its sign is settled."""
    tail = (1 - level) / 2
    out = draws.groupBy(*keys).agg(F.percentile(value, F.lit(tail)).alias("low"), F.percentile(value, F.lit(1 - tail)).alias("high"), F.avg((F.col(value) < 0).cast("double")).alias("probability_better"), F.count("*").alias("draws"))
    return out.withColumn("conclusion", F.when(F.col("high") < 0, "better").when(F.col("low") > 0, "worse").otherwise("open"))


def cluster_bootstrap(sums: DataFrame, keys: list[str], strata: list[str], cluster: str, draws: int, seed: int = 2026) -> DataFrame:
    """draw and resampled metrics by keys: clusters are drawn with replacement within strata, the same for all members.

    A cluster's multiplicity in a draw is a Poisson count from a hash of seed, draw and cluster, the large-sample form of
    the multinomial that needs no shuffle of the clusters and that every member (model) sees alike. Only the sums of
    clusters are resampled, never rows."""
    u = (F.xxhash64(F.lit(seed), "draw", *strata, cluster).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    total, term, k = None, 1.0, 0
    cumulative = []
    while k < 18:  # a double tells no further step of the distribution apart
        term = term / k if k else 0.36787944117144233
        total = term if total is None else total + term
        cumulative.append(total)
        k += 1
    weight = F.lit(0)
    for c in cumulative:
        weight = weight + (u > c).cast("int")
    own = sums.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", weight)
    s = lambda c: F.sum(F.col("w") * F.col(c))
    return own.groupBy(*keys, "draw").agg(F.sqrt(ratio(s("se"), s("n"))).alias("rmse"), ratio(s("ae"), s("n")).alias("mae"), ratio(s("brier"), s("n")).alias("brier"), ratio(s("nll"), s("n")).alias("log_loss"), ratio(s("predicted") - s("observed"), s("n")).alias("bias"))


def bootstrap_spread(draws: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """metric, mean and standard error of resampled metrics, long."""
    long = draws.select(*keys, F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))))
    return long.groupBy(*keys, "metric").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("cluster_se"))


def independent_errors(df: DataFrame, keys: list[str], y: str = "observed", f: str = "predicted", p: str = "p") -> DataFrame:
    """metric and its standard error if rows were independent: means by their SD, RMSE by the delta method."""
    e, o = F.col(f) - F.col(y), (F.col(y) > 0).cast("double")
    root = F.sqrt(F.count("*").cast("double"))
    own = df.groupBy(*keys).agg(ratio(F.stddev_samp(e * e), 2 * F.sqrt(F.avg(e * e)) * root).alias("rmse"), (F.stddev_samp(F.abs(e)) / root).alias("mae"), (F.stddev_samp((F.col(p) - o) * (F.col(p) - o)) / root).alias("brier"), (F.stddev_samp(e) / root).alias("bias"))
    return own.select(*keys, F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("row_se")) for m in ("rmse", "mae", "brier", "bias")))))
