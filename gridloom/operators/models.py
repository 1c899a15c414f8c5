"""Fitted models on ML pipelines: Poisson rates with offset, hurdle forests, blocks, components, importance; effect algebra."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, RandomForestRegressor
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalar import clip, erfc, ratio
from gridloom.functions.scalar import correlation as pearson
from gridloom.operators.order import numbered
from gridloom.sources.scratch import checkpointed


def assembled(df: DataFrame, features: list[str], name: str = "features") -> DataFrame:
    """Rows with all features, as a vector; rows without one are left out."""
    return VectorAssembler(inputCols=features, outputCol=name, handleInvalid="skip").transform(df)


def poisson_rate(df: DataFrame, features: list[str], y: str, exposure: str) -> DataFrame:
    """term, estimate, se, z, p, low, high and rate ratio of a Poisson regression with log exposure as offset."""
    own = assembled(df.where(F.col(exposure) > 0).withColumns({"_off": F.ln(F.col(exposure).cast("double")), "_y": F.col(y).cast("double")}), features)
    model = GeneralizedLinearRegression(family="poisson", link="log", labelCol="_y", offsetCol="_off", maxIter=50, tol=1e-10).fit(own)
    s = model.summary
    rows = list(zip([*features, "(intercept)"], [*map(float, model.coefficients), float(model.intercept)], map(float, s.coefficientStandardErrors), strict=True))
    table = df.sparkSession.createDataFrame(rows, "term string, estimate double, se double").withColumn("z", ratio(F.col("estimate"), F.col("se")))
    return table.withColumns({"p": erfc(F.abs("z") / F.lit(2.0**0.5)), "low": F.col("estimate") - 1.959963984540054 * F.col("se"), "high": F.col("estimate") + 1.959963984540054 * F.col("se"), "rate_ratio": F.exp("estimate")})


def hurdle_forest(df: DataFrame, features: list[str], y: str, fold: str, trees: int = 60, depth: int = 8, leaf: int = 5, least_positives: int = 20, seed: int = 2026) -> DataFrame:
    """df with p, severity and predicted, each fold predicted by forests fitted on the others: p * E[y | y > 0], at least 0."""
    own = assembled(df.withColumns({"_y": F.col(y).cast("double"), "_o": (F.col(y) > 0).cast("double")}), features).cache()
    out = None
    for k in sorted(r[0] for r in own.select(fold).distinct().collect()):
        fit, test = own.where(F.col(fold) != k), own.where(F.col(fold) == k)
        kinds = fit.agg(F.sum("_o"), F.count("*")).first()
        if not kinds[1] or (kinds[0] or 0) < least_positives or kinds[0] == kinds[1]:
            raise ValueError(f"fold {k}: too few positives or zeros to fit a hurdle")
        common = {"featuresCol": "features", "numTrees": trees, "maxDepth": depth, "minInstancesPerNode": leaf, "featureSubsetStrategy": "sqrt", "subsamplingRate": 0.7, "seed": seed, "cacheNodeIds": True}
        yes = RandomForestClassifier(labelCol="_o", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c", **common).fit(fit)
        size = RandomForestRegressor(labelCol="_y", predictionCol="severity", **common).fit(fit.where("_o = 1"))
        part = size.transform(yes.transform(test)).withColumn("p", F.get(vector_to_array("_p"), 1))
        part = part.withColumn("predicted", F.greatest(F.lit(0.0), F.col("p") * F.col("severity")))
        out = part if out is None else out.unionByName(part)
    return out.drop("features", "_y", "_o", "_p", "_r", "_c")


def blocks(df: DataFrame, x: str, y: str, k: int, seed: int = 2026) -> DataFrame:
    """df with block 1..k: k-means on standardised coordinates, numbered from west to east."""
    own = assembled(df, [x, y], "_raw")
    own = StandardScaler(inputCol="_raw", outputCol="_std", withMean=True, withStd=True).fit(own).transform(own)
    own = KMeans(k=k, seed=seed, featuresCol="_std", predictionCol="_label", maxIter=50).fit(own).transform(own)
    west = own.groupBy("_label").agg(F.avg(x).alias("_w"))
    number = west.select("_label", F.row_number().over(Window.orderBy("_w")).alias("block"))
    return own.join(F.broadcast(number), "_label").drop("_raw", "_std", "_label")


def rbf_features(df: DataFrame, x: str, y: str, centres: list[tuple[float, float]]) -> DataFrame:
    """df with a Gaussian of the distance to each centre; the width is 1.5 times the median nearest-centre distance."""
    c = np.array(centres, float)
    d = np.sqrt(((c[:, None] - c[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    s = 1.5 * float(np.median(d.min(1)))
    d2 = lambda a, b: (F.col(x) - a) * (F.col(x) - a) + (F.col(y) - b) * (F.col(y) - b)
    return df.withColumns({f"rbf_{i}": F.exp(-d2(float(a), float(b)) / (2 * s * s)) for i, (a, b) in enumerate(centres, 1)})


def correlation(df: DataFrame, features: list[str], method: str = "pearson") -> np.ndarray:
    """Correlation matrix of complete rows; only p x p numbers come to the driver."""
    return Correlation.corr(assembled(df, features), "features", method).head()[0].toArray()


def collinearity(df: DataFrame, features: list[str], method: str = "pearson") -> DataFrame:
    """Variance inflation of each feature and the condition number of their correlation matrix."""
    r = correlation(df, features, method)
    vif = np.diag(np.linalg.pinv(r))
    eigen = np.linalg.eigvalsh(r)
    cond = float(np.sqrt(eigen.max() / max(eigen.min(), 1e-300)))
    return df.sparkSession.createDataFrame([(f, float(v), cond) for f, v in zip(features, vif, strict=True)], "feature string, vif double, condition double")


def screen(df: DataFrame, features: list[str], max_vif: float = 5.0, max_rho: float = 0.8, max_condition: float = 100.0) -> list[str]:
    """Features left after dropping the worst until inflation, correlation and condition are all within bounds."""
    r, names = correlation(df, features), list(features)
    while len(names) > 1:
        vif = np.diag(np.linalg.pinv(r))
        eigen = np.linalg.eigvalsh(r)
        off = np.abs(r - np.eye(len(names)))
        if vif.max() <= max_vif and off.max() <= max_rho and np.sqrt(eigen.max() / max(eigen.min(), 1e-300)) <= max_condition:
            break
        worst = int(np.argmax(vif))
        names.pop(worst)
        r = np.delete(np.delete(r, worst, 0), worst, 1)
    return names


def first_component(df: DataFrame, features: list[str], anchor: str, groups: list[str]) -> DataFrame:
    """df with score: the first principal component of the features, turned to go with the anchor, standardised by group."""
    own = assembled(df, features, "_v")
    own = StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=True).fit(own).transform(own)
    model = PCA(k=1, inputCol="_z", outputCol="_pc").fit(own)
    own = model.transform(own).withColumn("_s", F.get(vector_to_array("_pc"), 0))
    sign = own.agg(F.when(pearson(F.col("_s"), F.col(anchor)) < 0, -1.0).otherwise(1.0).alias("_sign"))
    own = own.crossJoin(F.broadcast(sign)).withColumn("_s", F.col("_s") * F.col("_sign"))
    scale = own.groupBy(*groups).agg(F.avg("_s").alias("_m"), F.stddev_samp("_s").alias("_d"))
    return own.join(scale, groups).withColumn("score", ratio(F.col("_s") - F.col("_m"), F.col("_d"))).drop("_v", "_z", "_pc", "_s", "_sign", "_m", "_d")


def permutation_importance(df: DataFrame, features: list[str], groups: dict[str, list[str]], y: str, repeats: int = 3, seed: int = 2026) -> DataFrame:
    """Rise of the log loss of an occurrence model when a group of columns is shuffled together, over repeats.

    A shuffle deals the columns' values by row order of a hash: the rows are numbered twice and joined on the number,
    each time by ranges of the hash, so no task sees the whole table. The rows are stored with their own number, and a
    repeat's numbers serve all groups: one join deals the columns of each."""
    own = df.withColumns({"_o": (F.col(y) > 0).cast("double"), "_id": F.xxhash64(*df.columns)}).select("_id", "_o", *features)
    own = checkpointed(numbered(own, [], F.col("_id"), ["_id"], "_n"))
    model = LogisticRegression(labelCol="_o", probabilityCol="_p", maxIter=50).fit(assembled(own, features))

    def loss(d: DataFrame):
        q = clip(F.get(vector_to_array("_p"), 1), 1e-6, 1 - 1e-6)
        return model.transform(assembled(d, features)).agg((-F.avg(F.col("_o") * F.ln(q) + (1 - F.col("_o")) * F.ln(1 - q))).alias("loss"))

    base = checkpointed(loss(own))
    moved = list(dict.fromkeys(c for columns in groups.values() for c in columns))
    out = None
    for k in range(repeats):
        shuffled = numbered(own.select("_id", *(F.col(c).alias(f"_d_{c}") for c in moved)), [], F.xxhash64(F.lit(seed), F.lit(k), "_id"), ["_id"], "_n").drop("_id")
        rows = checkpointed(own.drop("_id").join(shuffled, "_n"))
        for name, columns in groups.items():
            dealt = rows.select("_o", *((F.col(f"_d_{c}") if c in columns else F.col(c)).alias(c) for c in features))
            part = loss(dealt).select(F.lit(name).alias("feature"), F.lit(k).alias("repeat"), "loss")
            out = part if out is None else out.unionByName(part)
    delta = out.crossJoin(base.withColumnRenamed("loss", "base")).withColumn("delta", F.col("loss") - F.col("base"))
    return delta.groupBy("feature").agg(F.avg("delta").alias("mean"), F.stddev_samp("delta").alias("sd"), F.avg((F.col("delta") > 0).cast("double")).alias("share_positive"))


def effects(paths: DataFrame, source: str, target: str, longest: int = 4) -> DataFrame:
    """route, steps and effect of each path from source to target (paths: model, a, b, coefficient), products along it.

    The graph of a path model is a small fixed table; routes grow a step at a time up to `longest` steps."""
    now = paths.where(F.col("a") == source).select("model", F.array("a", "b").alias("route"), F.col("b").alias("at"), F.col("coefficient").alias("effect"))
    out = None
    step = paths.select("model", F.col("a").alias("at"), F.col("b").alias("to"), "coefficient")
    for _ in range(longest):
        ended = now.where(F.col("at") == target)
        out = ended if out is None else out.unionByName(ended)
        now = now.where(F.col("at") != target).join(F.broadcast(step), ["model", "at"]).where(~F.array_contains("route", F.col("to"))).select("model", F.array_append("route", F.col("to")).alias("route"), F.col("to").alias("at"), (F.col("effect") * F.col("coefficient")).alias("effect"))
    return out.select("model", F.array_join("route", ">").alias("route"), (F.size("route") - 1).alias("steps"), "effect")


def total_effects(routes: DataFrame) -> DataFrame:
    direct = F.sum(F.when(F.col("steps") == 1, F.col("effect")).otherwise(0.0))
    return routes.groupBy("model").agg(direct.alias("direct"), (F.sum("effect") - direct).alias("indirect"), F.sum("effect").alias("total"))
