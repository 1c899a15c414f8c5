"""Grids of hurdle forests: every configuration of both stages on every fold, all pairs scored, winners by rank sums.

The stages are fitted apart: a fold needs as many fits as there are configurations of either, and a pair is a product of their
predictions. Fits run side by side over one stored table of vectors, and a fold's rows are scored by all its models in one pass.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalar import clip, correlation, ratio
from gridloom.operators.association import value_ranks
from gridloom.operators.metrics import average_precision, roc_auc
from gridloom.operators.models import assembled
from gridloom.sources.scratch import checkpointed


@dataclass(frozen=True)
class Config:
    """Least rows of a leaf, features tried at a split (sqrt, all, or a share as text), share of rows of a tree, and whether the two
    classes weigh alike."""

    name: str
    leaf: int = 5
    features: str = "sqrt"
    rows: float = 0.7
    balanced: bool = False


def _model(stage: str, c: Config, trees: int, depth: int, seed: int):
    common = {"featuresCol": "_v", "numTrees": trees, "maxDepth": depth, "minInstancesPerNode": c.leaf, "featureSubsetStrategy": c.features, "subsamplingRate": c.rows, "seed": seed, "cacheNodeIds": True, "predictionCol": f"_{stage}_{c.name}"}
    if stage == "severity":
        return RandomForestRegressor(labelCol="_y", **common)
    weight = {"weightCol": "_w"} if c.balanced else {}
    return RandomForestClassifier(labelCol="_o", probabilityCol=f"_p_{c.name}", rawPredictionCol=f"_r_{c.name}", **weight, **common)


def grid_predictions(df: DataFrame, features: list[str], y: str, fold: str, occurrence: list[Config], severity: list[Config], trees: int = 60, depth: int = 8, least_positives: int = 20, seed: int = 2026, at_once: int = 4) -> DataFrame:
    """df's complete rows with p and severity: arrays like the configurations, predicted by forests that saw the other folds only.

    Folds are a fixed few. A fold whose others have under least_positives positive rows, or no zero, is refused by ValueError, as are
    configurations of one name. An empty table has no fold and is refused too.
    """
    for configs in (occurrence, severity):
        if not configs or len({c.name for c in configs}) < len(configs):
            raise ValueError("each stage needs configurations of different names")
    own = assembled(df.dropna(subset=[y, fold, *features]).withColumns({"_y": F.col(y).cast("double"), "_o": (F.col(y) > 0).cast("double"), "_f": F.col(fold).cast("string")}), features, "_v")
    own = checkpointed(own)
    cells = own.groupBy("_f").agg(F.sum("_o").alias("yes"), F.count("*").alias("n")).collect()
    if len(cells) < 2:
        raise ValueError("at least two folds are needed")
    fits: dict[str, DataFrame] = {}
    for held in sorted(c["_f"] for c in cells):
        yes, n = (sum(c[k] for c in cells if c["_f"] != held) for k in ("yes", "n"))
        if yes < least_positives or yes == n:
            raise ValueError(f"fold {held}: too few positives or zeros to fit a hurdle")
        fits[held] = own.where(F.col("_f") != held).withColumn("_w", F.when(F.col("_o") > 0, n / (2 * yes)).otherwise(n / (2 * (n - yes))))
    jobs = [(held, stage, c) for held in fits for stage, configs in (("occurrence", occurrence), ("severity", severity)) for c in configs]

    def run(job):
        held, stage, c = job
        rows = fits[held] if stage == "occurrence" else fits[held].where("_o = 1")
        return _model(stage, c, trees, depth, seed).fit(rows)

    with ThreadPoolExecutor(at_once) as pool:
        fitted = dict(zip([(h, s, c.name) for h, s, c in jobs], pool.map(inheritable_thread_target(own.sparkSession)(run), jobs), strict=True))
    out = None
    for held in fits:
        part = own.where(F.col("_f") == held)
        for c in occurrence:
            part = fitted[held, "occurrence", c.name].transform(part).withColumn(f"_q_{c.name}", F.get(vector_to_array(f"_p_{c.name}"), 1)).drop(f"_p_{c.name}", f"_r_{c.name}", f"_occurrence_{c.name}")
        for c in severity:
            part = fitted[held, "severity", c.name].transform(part)
        part = part.select(*df.columns, F.array(*(F.col(f"_q_{c.name}") for c in occurrence)).alias("p"), F.array(*(F.col(f"_severity_{c.name}") for c in severity)).alias("severity"))
        out = part if out is None else out.unionByName(part)
    return out


#: Metrics of a stage of which more is better; of all others less is.
HIGHER = ("auc", "average_precision", "spearman", "r2")


def _errors(df: DataFrame, keys: list[str], y: Column, f: Column, r2: bool = False) -> DataFrame:
    e = f - y
    more = {"r2": 1 - ratio(F.avg(e * e), F.var_pop(y))} if r2 else {}
    cells = {"rmse": F.sqrt(F.avg(e * e)), "mae": F.avg(F.abs(e)), "abs_bias": F.abs(F.avg(e)), **more}
    return df.groupBy(*keys).agg(*(c.alias(n) for n, c in cells.items()))


def _spearman(df: DataFrame, keys: list[str], y: str, f: str) -> DataFrame:
    both = value_ranks(value_ranks(df, keys, y, "_ry"), keys, f, "_rf")
    return both.groupBy(*keys).agg(correlation(F.col("_ry"), F.col("_rf")).alias("spearman"))


def _together(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, keys, "left")
    return out


def grid_metrics(predictions: DataFrame, y: str, fold: str, occurrence: list[Config], severity: list[Config]) -> DataFrame:
    """stage, config, fold, metric and value: occurrence by configuration, severity over positive rows, expected by pairs (a x b).

    A row is repeated for each configuration of its stage, and for each pair; areas and rank correlations go by counts of distinct
    values. A metric is NULL where a fold has one class, or no spread.
    """
    own = checkpointed(predictions.select(F.col(fold).cast("string").alias("fold"), F.col(y).cast("double").alias("y"), "p", "severity"))
    cells = lambda configs, source: F.array(*(F.struct(F.lit(c.name).alias("config"), F.get(source, i).alias("f")) for i, c in enumerate(configs)))
    pairs = F.array(*(F.struct(F.lit(f"{a.name} x {b.name}").alias("config"), (F.get("p", i) * F.get("severity", j)).alias("f")) for i, a in enumerate(occurrence) for j, b in enumerate(severity)))
    keys, yes = ["config", "fold"], F.col("y") > 0
    o = own.select("fold", "y", F.inline(cells(occurrence, "p")))
    s = own.where(yes).select("fold", "y", F.inline(cells(severity, "severity")))
    e = own.select("fold", "y", F.inline(pairs))
    hit, q = yes.cast("double"), clip(F.col("f"), 1e-6, 1 - 1e-6)
    chance = o.groupBy(*keys).agg(F.avg((F.col("f") - hit) * (F.col("f") - hit)).alias("brier"), (-F.avg(hit * F.ln(q) + (1 - hit) * F.ln(1 - q))).alias("log_loss"), F.abs(F.avg(F.col("f") - hit)).alias("abs_bias"))
    areas = lambda d: [roc_auc(d, keys, "f", yes).select(*keys, "auc"), average_precision(d, keys, "f", yes).select(*keys, "average_precision")]
    stages = {
        "occurrence": _together([chance, *areas(o)], keys),
        "severity": _together([_errors(s, keys, F.col("y"), F.col("f")), _spearman(s, keys, "y", "f")], keys),
        "expected": _together([_errors(e, keys, F.col("y"), F.col("f"), r2=True), _spearman(e, keys, "y", "f"), *areas(e)], keys),
    }
    out = None
    for stage, wide in stages.items():
        names = [c for c in wide.columns if c not in keys]
        part = wide.select(F.lit(stage).alias("stage"), *keys, F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names))))
        out = part if out is None else out.unionByName(part)
    return out


def rank_sums(long: DataFrame, groups: list[str], member: str, metric: str, value: str, higher: Iterable[str] = HIGHER, digits: int = 12) -> DataFrame:
    """groups, member, rank_sum and position: the mean ranks of the members in each metric added up, equal values sharing theirs.

    Values are rounded first. NULL ranks behind all values; members are compared in metrics that they have a row in.
    """
    key = F.round(F.when(F.col(metric).isin(*higher), -F.col(value)).otherwise(F.col(value)), digits)
    own = long.withColumn("_key", key)
    least = F.rank().over(Window.partitionBy(*groups, metric).orderBy(F.col("_key").asc_nulls_last()))
    same = F.count("*").over(Window.partitionBy(*groups, metric, "_key"))
    out = own.withColumn("_rank", least + (same - 1) / 2.0).groupBy(*groups, member).agg(F.sum("_rank").alias("rank_sum"))
    return out.withColumn("position", F.rank().over(Window.partitionBy(*groups).orderBy("rank_sum")))


def winners(metrics: DataFrame, occurrence: list[Config], severity: list[Config]) -> DataFrame:
    """stage, config, means of the metrics over folds as a map, rank_sum, position, and winner: the best, of equals the simplest.

    Simpler comes first in the order in which configurations are given; for pairs by the occurrence stage first.
    """
    mean = metrics.groupBy("stage", "config", "metric").agg(F.avg("value").alias("value"))
    wide = mean.groupBy("stage", "config").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("means"))
    order = [*(("occurrence", c.name) for c in occurrence), *(("severity", c.name) for c in severity), *(("expected", f"{a.name} x {b.name}") for a in occurrence for b in severity)]
    place = F.broadcast(metrics.sparkSession.createDataFrame([(s, c, i) for i, (s, c) in enumerate(order)], "stage string, config string, place int"))
    own = rank_sums(mean, ["stage"], "config", "metric", "value").join(wide, ["stage", "config"]).join(place, ["stage", "config"])
    first = F.row_number().over(Window.partitionBy("stage").orderBy("rank_sum", "place"))
    return own.withColumn("winner", first == 1).drop("place")
