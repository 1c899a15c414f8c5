"""Forests of Spark's ML library explained: Shapley values and path attributions of each row, their summaries and curves.

A fitted forest is read back as a table of nodes. A leaf is reached by rows within an interval of each feature on its path; the
cover of its path says how many training rows go on at each split. Both attributions follow from the leaves alone, so
rows are explained where they are, in Arrow batches, with the nodes (trees x 2 ** depth at most) sent to the tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.scalar import correlation, ratio
from gridloom.operators.forest_fits import fit_forests
from gridloom.operators.models import assembled
from gridloom.operators.order import exact_quantiles, numbered, running_totals
from gridloom.operators.shuffles import sent
from gridloom.sources.scratch import checkpointed, shared_dir

MOST_NODES = 1 << 20


@dataclass
class Leaf:
    """value, and for the distinct features of the path: their number, interval (low, high], share of rows that go on, and path change.

    table: Shapley values by feature and pattern of the features that hold a row, once they are asked for."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    change: np.ndarray
    table: np.ndarray | None = None


@dataclass
class Forest:
    """seen: rows explained so far; tables: (method, tree) to its table of cells, see attributions()."""

    trees: list[list[Leaf]]
    base: float
    n_features: int
    seen: int = 0
    tables: dict = field(default_factory=dict)

    def cuts(self, t: int | None = None) -> list[np.ndarray]:
        """By feature, ascending: the values at which a tree, or any tree, splits."""
        own: list[list[float]] = [[] for _ in range(self.n_features)]
        for leaf in (leaf for k, leaves in enumerate(self.trees) if t is None or k == t for leaf in leaves):
            for f, high in zip(leaf.features, leaf.high, strict=True):
                own[f].append(high)
        return [np.array(sorted({v for v in c if v < math.inf})) for c in own]


def nodes(model) -> DataFrame:
    """tree, node, value, cover, left, right, feature and threshold of a fitted forest, from the form that Spark stores.

    value is the mean of a regression node, the share of class 1 of a classification node; a leaf has no child (-1).
    """
    spark = SparkSession.active()
    path = f"{shared_dir(spark)}/forest-{model.uid}"
    model.write().overwrite().save(path)
    own = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    stats = F.col("impurityStats")
    total = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    is_class = isinstance(model, RandomForestClassificationModel)
    value = F.get(stats, 1) / total if is_class else F.col("prediction")
    cover = total if is_class else F.get(stats, 0)
    return own.select(F.col("treeID").alias("tree"), F.col("id").alias("node"), value.alias("value"), cover.alias("cover"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", 0).alias("threshold"))


def forest(model, n_features: int) -> Forest:
    """The leaves of a fitted forest; its size is that of the model, not of the data."""
    rows = nodes(model).limit(MOST_NODES + 1).collect()
    if len(rows) > MOST_NODES:
        raise ValueError(f"the forest has over {MOST_NODES} nodes")
    trees: dict[int, dict[int, tuple]] = {}
    for r in rows:
        trees.setdefault(r["tree"], {})[r["node"]] = r
    return from_nodes([trees[k] for k in sorted(trees)], n_features)


def from_nodes(trees: list[dict[int, dict]], n_features: int) -> Forest:
    """The leaves of trees of nodes (value, cover, left, right, feature, threshold), each with node 0 as root."""
    out, base = [], 0.0
    for tree in trees:
        leaves, open_ = [], [(0, {})]
        while open_:
            number, path = open_.pop()
            at = tree[number]
            if at["left"] < 0:
                order = sorted(path)
                cells = np.array([path[f] for f in order], float).reshape(-1, 4)
                leaves.append(Leaf(at["value"], np.array(order, int), *cells.T))
                continue
            f, cut = at["feature"], at["threshold"]
            for child, is_left in ((at["left"], True), (at["right"], False)):
                low, high, share, change = path.get(f, (-math.inf, math.inf, 1.0, 0.0))
                below = tree[child]
                bounds = (low, min(high, cut)) if is_left else (max(low, cut), high)
                open_.append((child, {**path, f: (*bounds, share * below["cover"] / at["cover"], change + below["value"] - at["value"])}))
        out.append(leaves)
        base += tree[0]["value"] / len(trees)
    return Forest(out, base, n_features)


def _leaf_values(leaf: Leaf, inside: np.ndarray) -> np.ndarray:
    """Shapley values of the leaf's features for patterns of which of them hold the row (rows of 0 and 1).

    A feature that is known multiplies the leaf's weight by 0 or 1, one that is not by its share. The sum over all sets
    of known features by size has the coefficients of a product of (share + inside * t) over the other features.
    """
    m = len(leaf.features)
    weight = np.array([math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)])
    out = np.zeros(inside.shape)
    for j in range(m):
        poly = np.zeros((len(inside), m))
        poly[:, 0] = 1
        for k in range(m):
            if k != j:
                shifted = np.zeros_like(poly)
                shifted[:, 1:] = poly[:, :-1] * inside[:, k : k + 1]
                poly = poly * leaf.share[k] + shifted
        out[:, j] = leaf.value * (inside[:, j] - leaf.share[j]) * (poly @ weight)
    return out


#: Leaves of paths with up to so many features have their values of all patterns in a table.
TABLED = 10


def _by_leaves(columns: list[np.ndarray], leaves: list[Leaf], method: str) -> np.ndarray:
    """Values by feature, and last the predictions, of one tree, in the shape that the columns have together."""
    out = np.zeros((len(columns) + 1, *np.broadcast_shapes(*(c.shape for c in columns))))
    for leaf in leaves:
        m = len(leaf.features)
        code = np.zeros((1,) * (out.ndim - 1), np.intp)
        for k, f in enumerate(leaf.features):
            code = code + (((columns[f] > leaf.low[k]) & (columns[f] <= leaf.high[k])).astype(np.intp) << k)
        here = code == (1 << m) - 1
        out[-1] += np.where(here, leaf.value, 0.0)
        if method == "path":
            for k, f in enumerate(leaf.features):
                out[f] += np.where(here, leaf.change[k], 0.0)
        elif m:
            known, which = (np.arange(1 << m), code) if m <= TABLED else np.unique(code.ravel(), return_inverse=True)
            if leaf.table is None or m > TABLED:
                leaf.table = np.ascontiguousarray(_leaf_values(leaf, ((known[:, None] >> np.arange(m)) & 1).astype(float)).T)
            for values, f in zip(leaf.table, leaf.features, strict=True):
                out[f] += values[which.reshape(code.shape)]
    return out


#: A tree's splits cut the features into cells; trees of up to so many cells have a table of them.
CELLS = 1 << 17


def _table(own: Forest, t: int, method: str) -> tuple[list[np.ndarray | None], np.ndarray | None]:
    """By feature what each bin of the forest's cuts adds to the number of the tree's cell, and the values of each cell.

    A cell of the table takes about a quarter of a row's time, so there is none before a quarter as many rows have been seen, or for very many."""
    if (method, t) not in own.tables:
        cuts = own.cuts(t)
        n = math.prod(len(c) + 1 for c in cuts)
        if n > min(4 * own.seen, CELLS):
            return [], None
        ends = [np.append(c, math.inf) for c in cuts]
        cells = [c.reshape([-1 if k == f else 1 for k in range(len(ends))]) for f, c in enumerate(ends)]
        steps = [math.prod(len(c) for c in ends[f + 1 :]) for f in range(len(ends))]
        if ("cuts",) not in own.tables:
            own.tables[("cuts",)] = own.cuts()
        bins = [np.searchsorted(c, np.append(all_, math.inf)) * step if len(c) else None for c, all_, step in zip(cuts, own.tables[("cuts",)], steps, strict=True)]
        own.tables[method, t] = bins, _by_leaves(cells, own.trees[t], method).reshape(len(ends) + 1, -1)
    return own.tables[method, t]


def attributions(x: np.ndarray, own: Forest, method: str = "shapley") -> tuple[np.ndarray, np.ndarray]:
    """(values by row and feature, predictions): base plus a row's values is its prediction.

    shapley: over all orders of the features, where an unknown feature sends a row on by the training rows' shares.
    path: the change of the node's value at each split on the row's own path, given to the feature that splits.
    Once a task has seen as many rows as a tree has cells, rows are looked up by their cell.
    """
    columns = np.ascontiguousarray(x.T)
    own.seen += len(x)
    out, bins = np.zeros((len(columns) + 1, len(x))), None
    for t, leaves in enumerate(own.trees):
        steps, table = _table(own, t, method)
        if table is None:
            out += _by_leaves(list(columns), leaves, method)
            continue
        bins = bins or [np.searchsorted(c, v) for c, v in zip(own.tables[("cuts",)], columns, strict=True)]
        cell = np.zeros(len(x), np.int64)
        for s, b in zip(steps, bins, strict=True):
            if s is not None:
                cell += s[b]
        for f, values in enumerate(table):
            out[f] += values[cell]
    return np.ascontiguousarray(out[:-1].T) / len(own.trees), out[-1] / len(own.trees)


def explained(df: DataFrame, own: Forest, features: list[str], keep: list[str], method: str = "shapley") -> DataFrame:
    """keep, x (the features), phi (their values), base and predicted for each row that has all features."""
    return _explained(df, [(None, None, own)], None, None, features, keep, method).drop("stage")


def _explained(df: DataFrame, forests: list[tuple], y: str | None, fold: str | None, features: list[str], keep: list[str], method: str) -> DataFrame:
    """keep, x, phi, base, predicted and stage by forests (fold, stage, forest) in one reading of the rows.

    A forest explains the rows of its fold, all rows if that is None, and of those only the ones above 0 if the stage is severity."""
    folds = sorted({k for k, _, _ in forests if k is not None})
    number = F.array_position(F.array(*(F.lit(k) for k in folds)), F.col(fold)).cast("int") if folds else F.lit(0)
    above = (F.col(y) > 0) if y else F.lit(True)
    rows = df.dropna(subset=features).select(F.coalesce(number, F.lit(0)).alias("_fold"), F.coalesce(above, F.lit(False)).alias("_above"), *keep, F.array(*(F.col(c).cast("double") for c in features)).alias("x"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:]), "phi array<double>", "base double", "predicted double", "stage string"])
    width = len(features)

    def run(batches):
        for b in batches:
            at, is_above = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            kept = b.select(b.schema.names[2:])
            for k, stage, own in forests:
                mine = np.ones(len(at), bool) if k is None else at == folds.index(k) + 1
                part = kept.filter(pa.array(mine & is_above if stage == "severity" else mine))
                if not part.num_rows:
                    continue
                x = part.column(part.num_columns - 1).flatten().to_numpy().reshape(-1, width)
                phi, predicted = attributions(x, own, method)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, phi.size + 1, width, dtype=np.int32)), pa.array(phi.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(np.full(len(x), own.base)), pa.array(predicted), pa.array([stage] * len(x), pa.string())], [*part.schema.names, "phi", "base", "predicted", "stage"])

    return rows.mapInArrow(run, schema)


def fold_forests(df: DataFrame, features: list[str], y: str, fold: str, trees: int, depth: int, leaf: int, seed: int, kinds: tuple[str, ...]):
    """(fold, kind, model) of forests fitted on all other folds; kinds: occurrence, severity (rows above 0) and full.

    Folds are a fixed few, so their fits are a loop of Spark jobs.
    """
    own = assembled(df.withColumns({"_y": F.col(y).cast("double"), "_o": (F.col(y) > 0).cast("double")}), features).persist()
    try:
        for k in sorted(r[0] for r in own.select(fold).distinct().collect()):
            fit = own.where(F.col(fold) != k)
            common = {"featuresCol": "features", "numTrees": trees, "maxDepth": depth, "minInstancesPerNode": leaf, "featureSubsetStrategy": "sqrt", "subsamplingRate": 0.7, "seed": seed + k}
            if "occurrence" in kinds:
                yield k, "occurrence", RandomForestClassifier(labelCol="_o", **common).fit(fit)
            if "severity" in kinds:
                yield k, "severity", RandomForestRegressor(labelCol="_y", **common).fit(fit.where("_o = 1"))
            if "full" in kinds:
                yield k, "full", RandomForestRegressor(labelCol="_y", **common).fit(fit)
    finally:
        own.unpersist()


def explain_oof(df: DataFrame, features: list[str], y: str, fold: str, keep: list[str], trees: int = 40, depth: int = 6, leaf: int = 5, seed: int = 2026, method: str = "shapley") -> DataFrame:
    """stage, fold, keep, x, phi, base and predicted: each fold's rows explained by forests fitted on the others.

    Stage occurrence explains the chance of a value above 0 of all rows, severity the value of the rows above 0. The columns needed
    are stored; all forests are fitted in common passes, and one more reading explains the rows, in two tasks a core, since
    each task has the trees' tables to fill.
    """
    df = checkpointed(df.select(*dict.fromkeys([fold, *keep, y, *features])))
    fits = fit_forests(df, features, y, fold, ("occurrence", "severity"), trees, depth, leaf, seed)
    forests = [(k, kind, from_nodes(own, len(features))) for (k, kind), own in fits.items()]
    return _explained(df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism), forests, y, fold, features, [fold, *keep], method)


def forest_oof(df: DataFrame, features: list[str], y: str, fold: str, trees: int = 60, depth: int = 8, leaf: int = 5, seed: int = 2026) -> DataFrame:
    """df with predicted by one forest of the whole response, fitted on the other folds: the baseline of the hurdle."""
    df = checkpointed(df)
    out = None
    for k, _, model in fold_forests(df, features, y, fold, trees, depth, leaf, seed, ("full",)):
        part = model.setPredictionCol("_f").transform(assembled(df.where(F.col(fold) == k), features)).withColumn("predicted", F.greatest(F.lit(0.0), "_f")).drop("_f", "features")
        out = part if out is None else out.unionByName(part)
    return out


def hurdle_importance(df: DataFrame, features: list[str], groups: dict[str, list[str]], y: str, fold: str, repeats: int = 3, trees: int = 30, depth: int = 6, leaf: int = 5, seed: int = 2026) -> DataFrame:
    """group: mean rise, deviation and share above 0, over folds and repeats, of the squared error's root and of the log loss when a group's columns are dealt anew.

    Each fold's rows are predicted by the hurdle of forests that did not see them. They are numbered once; a keyed bijection of
    the numbers deals the columns, so a repeat is one join on the number.
    """
    df = checkpointed(df)
    models: dict[int, dict[str, object]] = {}
    for k, kind, model in fold_forests(df, features, y, fold, trees, depth, leaf, seed, ("occurrence", "severity")):
        models.setdefault(k, {})[kind] = model
    out = None
    for k, pair in models.items():
        own = df.where(F.col(fold) == k).dropna(subset=[*features, y]).select(F.col(y).cast("double").alias("_y"), *features)
        own = checkpointed(numbered(own, [], F.xxhash64(F.lit(seed), *own.columns), own.columns, "_n"))
        n = own.count()

        def scored(rows: DataFrame) -> DataFrame:
            said = pair["severity"].setPredictionCol("_s").transform(pair["occurrence"].setPredictionCol("_c").transform(assembled(rows, features)))
            p = F.get(vector_to_array("probability"), 1)
            q, hit = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6)), (F.col("_y") > 0).cast("double")
            return said.agg(F.sqrt(F.avg((p * F.col("_s") - F.col("_y")) ** 2)).alias("rmse"), (-F.avg(hit * F.ln(q) + (1 - hit) * F.ln(1 - q))).alias("log_loss"))

        base = scored(own).first()
        for g, (name, members) in enumerate(groups.items()):
            for r in range(repeats):
                dealt_columns = sent(own.select("_n", *members), "_n", n, seed + 1000 * r + 10 * g + k)
                part = scored(own.drop(*members).join(dealt_columns, "_n")).select(F.lit(name).alias("feature_group"), (F.col("rmse") - F.lit(base["rmse"])).alias("rmse"), (F.col("log_loss") - F.lit(base["log_loss"])).alias("log_loss"))
                out = part if out is None else out.unionByName(part)
    values = [a for c in ("rmse", "log_loss") for a in (F.avg(c).alias(f"{c}_rise"), F.stddev_samp(c).alias(f"{c}_sd"), F.avg((F.col(c) > 0).cast("double")).alias(f"{c}_above"))]
    return out.groupBy("feature_group").agg(F.count("*").alias("n"), *values)


def long_form(rows: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """keys, feature, x and phi: a row for each value."""
    cells = F.arrays_zip(F.array(*map(F.lit, features)).alias("feature"), F.col("x").alias("x"), F.col("phi").alias("phi"))
    return rows.select(*keys, F.inline(cells)).toDF(*keys, "feature", "x", "phi")


def direction(rho: Column, contrast: Column, least: float = 0.1) -> Column:
    """positive or negative where rank correlation and contrast of high and low values agree, else mixed; flat within `least`."""
    return F.when(rho.isNull() | contrast.isNull(), "undetermined").when(F.abs(rho) < least, "non-monotonic").when((rho > 0) & (contrast > 0), "positive").when((rho < 0) & (contrast < 0), "negative").otherwise("mixed")


def value_summary(cells: DataFrame, keys: list[str], low: float = 0.2, high: float = 0.8) -> DataFrame:
    """By keys and feature: n, mean and median size, mean, deviation, share above 0, rank correlation with x, mean where x is low and high, their contrast, direction, rank by mean size."""
    own = [*keys, "feature"]
    cells = checkpointed(cells)
    size = cells.withColumn("size", F.abs("phi"))
    base = size.groupBy(*own).agg(F.count("*").alias("n"), F.avg("size").alias("mean_abs"), F.avg("phi").alias("mean"), F.stddev_samp("phi").alias("sd"), F.avg((F.col("phi") > 0).cast("double")).alias("positive"))
    middle = exact_quantiles(size, own, "size", [0.5]).select(*own, F.get("quantiles", 0).alias("median_abs"))
    cuts = exact_quantiles(cells, own, "x", [low, high]).select(*own, F.get("quantiles", 0).alias("lo"), F.get("quantiles", 1).alias("hi"))
    ends = cells.join(cuts, own).groupBy(*own).agg(F.avg(F.when(F.col("x") <= F.col("lo"), F.col("phi"))).alias("low_mean"), F.avg(F.when(F.col("x") >= F.col("hi"), F.col("phi"))).alias("high_mean"))
    ranks = []
    for c in ("x", "phi"):
        counted = cells.groupBy(*own, c).agg(F.count("*").alias("k"))
        below = running_totals(checkpointed(counted), own, c, ["k"])
        ranks.append(below.select(*own, c, (F.col("before_k") + (F.col("k") + 1) / 2).alias(f"r_{c}")))
    rho = cells.join(ranks[0], [*own, "x"]).join(ranks[1], [*own, "phi"]).groupBy(*own).agg(correlation(F.col("r_x"), F.col("r_phi")).alias("rho"))
    out = base.join(middle, own).join(ends, own).join(rho, own).withColumn("contrast", F.col("high_mean") - F.col("low_mean"))
    return out.withColumns({"direction": direction(F.col("rho"), F.col("contrast")), "rank": F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("mean_abs")))})


def group_summary(rows: DataFrame, features: list[str], groups: dict[str, list[str]], keys: list[str]) -> DataFrame:
    """By keys and group of features: n, mean size, mean, deviation, share above 0 of the sums of the group's values, and rank."""
    at = {f: i for i, f in enumerate(features)}
    total = lambda members: sum((F.get("phi", at[m]) for m in members), F.lit(0.0))
    cells = rows.select(*keys, F.inline(F.array(*(F.struct(F.lit(g).alias("feature_group"), total(m).alias("v")) for g, m in groups.items()))))
    out = cells.groupBy(*keys, "feature_group").agg(F.count("*").alias("n"), F.avg(F.abs("v")).alias("mean_abs"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.avg((F.col("v") > 0).cast("double")).alias("positive"))
    return out.withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("mean_abs"))))


def binned(cells: DataFrame, keys: list[str], bins: int = 20) -> DataFrame:
    """By keys, feature and bin (of equal numbers of rows, equal bounds merged): n, mean x, mean and quartiles of phi."""
    own = [*keys, "feature"]
    cells = checkpointed(cells)
    cuts = exact_quantiles(cells, own, "x", [k / bins for k in range(1, bins)]).select(*own, F.array_distinct("quantiles").alias("cuts"))
    at = F.size(F.filter("cuts", lambda c: c < F.col("x")))
    met = cells.join(cuts, own).withColumn("bin", at + 1)
    means = met.groupBy(*own, "bin").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("phi").alias("phi"))
    quart = exact_quantiles(met, [*own, "bin"], "phi", [0.25, 0.75]).select(*own, "bin", F.get("quantiles", 0).alias("q25"), F.get("quantiles", 1).alias("q75"))
    return means.join(quart, [*own, "bin"])


def curve_metrics(curve: DataFrame, keys: list[str]) -> DataFrame:
    """By keys and feature, along the bins: their number, amplitude, amplitude by mean interquartile range, monotone share, zero crossings, rank correlation of bin and value.

    The monotone share is that of the steps that go the way of most of the total change, by size; a curve has few bins."""
    own = [*keys, "feature"]
    order = Window.partitionBy(*own).orderBy("bin")
    near = lambda c, k: F.lag(c, k).over(order)
    steps = curve.withColumns({"step": F.col("phi") - near("phi", 1), "crossed": ((F.signum("phi") != F.signum(near("phi", 1))) & (F.col("phi") != 0)).cast("int"), "rp": F.rank().over(Window.partitionBy(*own).orderBy("phi")), "rb": F.row_number().over(order)})
    up, down = F.sum(F.when(F.col("step") > 0, F.col("step")).otherwise(0.0)), F.sum(F.when(F.col("step") < 0, -F.col("step")).otherwise(0.0))
    out = steps.groupBy(*own).agg(F.count("*").alias("bins"), (F.max("phi") - F.min("phi")).alias("amplitude"), F.avg(F.col("q75") - F.col("q25")).alias("iqr"), ratio(F.greatest(up, down), up + down).alias("monotone"), F.coalesce(F.sum("crossed"), F.lit(0)).alias("crossings"), correlation(F.col("rb"), F.col("rp")).alias("rho"))
    return out.withColumn("amplitude_by_iqr", ratio(F.col("amplitude"), F.col("iqr"))).drop("iqr")


def consensus(tables: DataFrame, keys: list[str], judge: str, score: str) -> DataFrame:
    """By keys and feature: the number of judges, geometric mean of the feature's shares of each judge's greatest score, and rank by it.

    A score of 0 counts as a millionth of the greatest."""
    top = F.max(score).over(Window.partitionBy(*keys, judge))
    share = F.greatest(ratio(F.col(score), top), F.lit(1e-6))
    out = tables.withColumn("_s", share).groupBy(*keys, "feature").agg(F.count("_s").alias("judges"), F.exp(F.avg(F.ln("_s"))).alias("consensus"))
    return out.withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("consensus"))))
