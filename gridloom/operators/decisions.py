"""Derived prediction columns, audits and decision tables of model comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalar import clean, clip, logit, ratio


def normalised(df: DataFrame, model: str = "model", scheme: str = "temporal") -> DataFrame:
    """Predictions of any model in one schema: rates, residuals of count, rate and occurrence, mean given a positive count."""
    y, f, e, p = (F.col(c) for c in ("observed", "predicted", "exposure", "p"))
    keys = ["grid_uid", "country", "year", "season", "fold"]
    return df.select(
        F.col(model).alias("model_role"), F.lit(scheme).alias("scheme"), *keys, "exposure", "observed", "predicted", "p",
        ratio(y, e).alias("observed_rate"), ratio(f, e).alias("predicted_rate"),
        (y - f).alias("residual"), (ratio(y, e) - ratio(f, e)).alias("rate_residual"), ((y > 0).cast("double") - p).alias("occurrence_residual"),
        conditional_mean(f, p).alias("mean_if_positive"),
    )


def conditional_mean(expected: Column, p: Column) -> Column:
    """E[y | y > 0] = E[y] / P(y > 0); NULL unless finite."""
    return clean(ratio(expected, p))


def poisson_positive(mean: Column) -> Column:
    """1 - exp(-mean), stable for small means."""
    return -F.expm1(-mean)


def residual_families(df: DataFrame) -> DataFrame:
    """df with residuals of occurrence, rate and count, of log magnitude (positives only), log loss, Brier, squared and absolute error."""
    y, f, e = F.col("observed").cast("double"), F.col("predicted"), F.col("exposure")
    o, q = (F.col("observed") > 0).cast("double"), clip(F.col("p"), 1e-6, 1 - 1e-6)
    return df.withColumns({
        "r_occurrence": o - F.col("p"),
        "r_rate": (y - f) / e,
        "r_count": y - f,
        "r_magnitude": F.when((y > 0) & (f > 0), F.ln(y) - F.ln(f)),
        "nll": -(o * F.ln(q) + (1 - o) * F.ln(1 - q)),
        "brier": (o - F.col("p")) * (o - F.col("p")),
        "se": (y - f) * (y - f),
        "ae": F.abs(y - f),
    })


def rate_multiple(df: DataFrame, keys: list[str]) -> DataFrame:
    """Greatest predicted rate over the greatest observed one; 1 if both are 0, infinite if only the observed one is."""
    own = df.groupBy(*keys).agg(F.max(ratio(F.col("observed"), F.col("exposure"))).alias("greatest_observed"), F.max(ratio(F.col("predicted"), F.col("exposure"))).alias("greatest_predicted"))
    a, b = F.col("greatest_predicted"), F.col("greatest_observed")
    return own.withColumn("multiple", F.when(b > 0, a / b).when(a == 0, 1.0).when(b == 0, float("inf")))


def prediction_audit(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of predictions that are missing, not finite or negative, of probabilities outside [0, 1], and a verdict."""
    f, p = F.col("predicted"), F.col("p")
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(f.isNull()).alias("n_missing"),
        F.count_if(f.isNotNull() & clean(f).isNull()).alias("n_not_finite"),
        F.count_if(f < 0).alias("n_negative"),
        F.count_if(~F.coalesce(p.between(0, 1), F.lit(False))).alias("n_bad_probability"),
    )
    return out.withColumn("valid", F.col("n_missing") + F.col("n_not_finite") + F.col("n_negative") + F.col("n_bad_probability") == 0)


def tradeoff(df: DataFrame, error: str, dependence: str, tolerance: float = 0.0) -> DataFrame:
    """df with what a candidate does to error and to spatial dependence (differences, below 0 is better), and what follows."""
    def side(c: str) -> Column:
        return F.when(F.col(c) < -tolerance, "better").when(F.col(c) > tolerance, "worse").otherwise("same")

    own = df.withColumns({"error_side": side(error), "dependence_side": side(dependence)})
    a, b = F.col("error_side"), F.col("dependence_side")
    category = F.when((a == "better") & (b != "worse"), "gain").when((a == "better") & (b == "worse"), "trade-off").when((a == "worse") & (b == "better"), "trade-off").when((a == "worse"), "loss").when(b == "better", "gain").when(b == "worse", "loss").otherwise("no change")
    advice = F.when(F.col("category") == "gain", "use the candidate").when(F.col("category") == "loss", "keep the reference").when(F.col("category") == "trade-off", "report both").otherwise("either")
    return own.withColumn("category", category).withColumn("recommendation", advice)


def winners(df: DataFrame, group: list[str], member: str, value: str, tolerance: float, lower_is_better: bool = True) -> DataFrame:
    """The member with the best value of each group; those within the tolerance of it are joined by ;."""
    best = (F.min if lower_is_better else F.max)(value).over(Window.partitionBy(*group))
    own = df.where(F.col(value).isNotNull()).withColumn("_best", best).where(F.abs(F.col(value) - F.col("_best")) <= tolerance)
    return own.groupBy(*group).agg(F.array_join(F.array_sort(F.collect_set(member)), ";").alias("winner"), F.first("_best").alias("best"), F.count("*").alias("n_winners"))


def relative_to_greatest(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """df with the value in percent of its group's greatest: the greatest values are few, rows don't move."""
    return df.join(df.groupBy(*group).agg(F.max(value).alias("_top")), group).withColumn("relative", 100 * ratio(F.col(value), F.col("_top"))).drop("_top")


def sign_changes(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """How often the nonzero values of a short series change their sign along the order."""
    own = df.where(F.col(value) != 0).withColumn("_s", F.signum(value))
    own = own.withColumn("_change", (F.col("_s") != F.lag("_s").over(Window.partitionBy(*group).orderBy(order))).cast("int"))
    return own.groupBy(*group).agg(F.count("*").alias("n_nonzero"), F.coalesce(F.sum("_change"), F.lit(0)).alias("n_changes"))


def dependence_signal(df: DataFrame, unit_icc: str = "icc", lag: str = "lag1", inflation: str = "design_effect") -> DataFrame:
    """df with a trigger for each kind of dependence and their number as a decision."""
    flags = {"icc_signal": F.col(unit_icc) >= 0.05, "lag_signal": F.abs(lag) >= 0.1, "inflation_signal": F.sqrt(inflation) >= 1.1}
    own = df.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in flags.items()})
    n = sum((F.col(k).cast("int") for k in flags), F.lit(0))
    return own.withColumn("decision", F.when(n >= 2, "clustered inference").when(n == 1, "report both").otherwise("independent rows"))


def occurrence_calibration(df: DataFrame, keys: list[str], p: str = "p", y: str = "observed", rounds: int = 25) -> DataFrame:
    """Logistic calibration of y > 0 on logit(p): slope and intercept of each group by Newton steps, NULL where they don't settle.

    Rows enter as counts of positives and negatives at each distinct p (to 9 digits), written out once; each step is
    one aggregation of them, and only a handful of sums for each group comes to the driver.
    """
    own = df.where(F.col(p).isNotNull()).groupBy(*keys, F.round(p, 9).alias("_p")).agg(F.count_if(F.col(y) > 0).alias("_pos"), F.count("*").alias("_n"))
    own = own.select(*keys, logit(F.col("_p")).alias("_x"), F.col("_pos").cast("double"), F.col("_n").cast("double")).cache()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.select(*keys).schema)
    now = {tuple(r): (0.0, 1.0, False) for r in own.select(*keys).distinct().collect()}
    spark = df.sparkSession
    for _ in range(rounds):
        table = spark.createDataFrame([(*k, a, b) for k, (a, b, done) in now.items() if not done], f"{schema}, _a double, _b double")
        fit = own.join(F.broadcast(table), keys)
        m = 1 / (1 + F.exp(-(F.col("_a") + F.col("_b") * F.col("_x"))))
        g, w = F.col("_pos") - F.col("_n") * m, F.col("_n") * m * (1 - m)
        sums = fit.groupBy(*keys).agg(F.sum(g), F.sum(g * F.col("_x")), F.sum(w), F.sum(w * F.col("_x")), F.sum(w * F.col("_x") * F.col("_x"))).collect()
        for r in sums:
            k, (g0, g1, h00, h01, h11) = tuple(r)[: len(keys)], tuple(r)[len(keys) :]
            a, b, _ = now[k]
            det = h00 * h11 - h01 * h01
            if det <= 1e-12 * max(h00 * h11, 1e-300):
                now[k] = None, None, True
                continue
            da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
            now[k] = a + da, b + db, abs(da) + abs(db) < 1e-9
        if all(done for _, _, done in now.values()):
            break
    own.unpersist()
    rows = [(*k, a, b) if done else (*k, None, None) for k, (a, b, done) in now.items()]
    return spark.createDataFrame(rows, f"{schema}, intercept double, slope double")
