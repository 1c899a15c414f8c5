"""Forests of several folds and stages fitted in common passes over packed rows: a pass for each level of the trees.

The parameters mean what they mean in Spark's ML library: 32 bins by quantiles, Poisson bootstrap weights, a new choice of
features (the root of their number, rounded up) at each node, the least weighted rows of a child, splits by the variance's fall
(for 0 and 1 half the fall of the Gini impurity), and leaves merged where both of a node's predict the same.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources.scratch import checkpointed

BINS = 32
KINDS = ("occurrence", "severity", "full")


@dataclass(frozen=True)
class Fit:
    """fold: the number of the fold left out among all folds; kind: occurrence (above 0 or not), severity (rows above 0) or full."""

    fold: int
    kind: str


#: Different values, or quantiles where there are more, by which a block of rows stands for a feature's values.
POINTS = 512


def _points(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, rows that each stands for), ascending: all different values, or quantiles at even places if they are many."""
    x = np.sort(x)
    starts = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    if len(starts) <= POINTS:
        return x[starts], np.diff(np.append(starts, len(x))).astype(float)
    return x[((np.arange(POINTS) + 0.5) * len(x) / POINTS).astype(int)], np.full(POINTS, len(x) / POINTS)


def _cuts(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The bounds of at most 32 bins: half-way between up to 32 different values, else values at even places."""
    known, at = np.unique(values, return_inverse=True)
    if len(known) <= BINS:
        return (known[1:] + known[:-1]) / 2
    below = np.cumsum(np.bincount(at, weights))
    return np.unique(known[np.searchsorted(below, below[-1] * np.arange(1, BINS) / BINS)])


def bin_cuts(rows: DataFrame, width: int, n_folds: int, most: int = 1 << 17) -> list[list[np.ndarray]]:
    """By fold left out and feature, ascending: the bounds of at most 32 bins of the other folds' rows (fold number, y, features).

    All rows are read. A block of `most` rows of a task has up to 512 points for each feature and fold; places are off by a
    512th of the rows at most, and not at all where blocks have no more different values.
    """

    def run(batches):
        held, n = [], 0

        def flush():
            m = np.concatenate(held, axis=1)
            held.clear()
            cells = [(g, f, *_points(m[2 + f, m[0] == g])) for g in np.unique(m[0]).astype(int) for f in range(width)]
            g, f, v, w = zip(*cells, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(f, pa.int64()), pa.array(v, pa.list_(pa.float64())), pa.array(w, pa.list_(pa.float64()))], ["fold", "feature", "v", "w"])

        for b in batches:
            if b.num_rows:
                held.append(_matrix(b))
                n += b.num_rows
            if n >= most:
                yield flush()
                n = 0
        if held:
            yield flush()

    def met(key, table):
        g, v, w = table.column("fold").to_numpy(), table.column("v").to_pylist(), table.column("w").to_pylist()
        out = []
        for j in range(n_folds):
            others = np.flatnonzero(g != j)
            if len(others):
                out.append((j, key[0].as_py(), _cuts(*(np.concatenate([part[i] for i in others]) for part in (v, w)))))
        j, f, cuts = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"fold": pa.array(j, pa.int64()), "feature": pa.array(f, pa.int64()), "cuts": pa.array(cuts, pa.list_(pa.float64()))})

    parts = rows.mapInArrow(run, "fold long, feature long, v array<double>, w array<double>")
    out = [[np.zeros(0)] * width for _ in range(n_folds)]
    for j, f, cuts in parts.groupBy("feature").applyInArrow(met, "fold long, feature long, cuts array<double>").collect():
        out[j][f] = np.array(cuts)
    return out


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(float, copy=False)


def packed(rows: DataFrame, cuts: list[list[np.ndarray]], most: int = 1 << 17) -> DataFrame:
    """part, block, n and body: the rows (fold number, y, features) of a task, `most` at a time, as bytes.

    body has the rows' folds, values of y, and for each fold left out and feature their bins.
    """

    def run(batches):
        held, n, block = [], 0, 0
        part = TaskContext.get().partitionId()

        def flush():
            m = np.concatenate(held, axis=1)
            held.clear()
            bins = np.stack([np.searchsorted(c, x).astype(np.uint8) for own in cuts for c, x in zip(own, m[2:], strict=True)])
            body = m[0].astype(np.uint16).tobytes() + m[1].tobytes() + bins.tobytes()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([block], pa.int64()), pa.array([m.shape[1]], pa.int64()), pa.array([body], pa.binary())], ["part", "block", "n", "body"])

        for b in batches:
            if b.num_rows:
                held.append(_matrix(b))
                n += b.num_rows
            if n >= most:
                yield flush()
                n, block = 0, block + 1
        if held:
            yield flush()

    return rows.mapInArrow(run, "part long, block long, n long, body binary")


def poisson_table(rate: float) -> np.ndarray:
    """The Poisson variate for each of 65,536 equally likely draws."""
    p, out = math.exp(-rate), []
    for k in range(64):
        out.append(p)
        p *= rate / (k + 1)
    return np.searchsorted(np.cumsum(out), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def _places(feature: np.ndarray, cut: np.ndarray, bins: np.ndarray, level: int) -> np.ndarray:
    """The number within the level of the node that each row reaches, 2 ** level if it ends before; bins by feature and row."""
    n = bins.shape[1]
    flat, at, node = bins.ravel(), np.arange(n), np.zeros(n, np.intp)
    for k in range(level):
        own = slice((1 << k) - 1, (2 << k) - 1)
        live = np.append(feature[own] >= 0, False)
        first = np.where(live, np.append(feature[own], 0) * n, 0)
        most = np.where(live, np.append(cut[own], 0), BINS).astype(np.uint8)
        below = np.where(live, 2 * np.arange(len(live)), 2 << k)
        node = below[node] + (flat[first[node] + at] > most[node])
    return node


def _sums(rows: DataFrame, fits: list[Fit], feature: np.ndarray, cut: np.ndarray, level: int, width: int, seed: int, rate: float) -> DataFrame:
    """fit, tree and v: by node of the level, feature and bin the weights and weighted values of a task's rows."""
    n_folds, trees, table = 1 + max(f.fold for f in fits), feature.shape[1], poisson_table(rate)
    cells = BINS << level  # and those of rows that end before

    def run(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for part, block, n, body in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), strict=True):
                raw = body.as_buffer()
                folds, y = np.frombuffer(raw, np.uint16, n), np.frombuffer(raw, np.float64, n, 2 * n)
                bins = np.frombuffer(raw, np.uint8, n_folds * width * n, 10 * n).reshape(n_folds, width, n)
                for i, fit in enumerate(fits):
                    mine = np.flatnonzero((folds != fit.fold) & (y > 0) if fit.kind == "severity" else folds != fit.fold)
                    own, v = bins[fit.fold][:, mine], y[mine]
                    v = (v > 0).astype(float) if fit.kind == "occurrence" else v
                    draws = np.random.default_rng([seed, fit.fold, KINDS.index(fit.kind), part, block])
                    for t in range(trees):
                        w = table[draws.integers(0, 1 << 16, len(mine), np.uint16)]
                        hit = np.flatnonzero(w > 0)
                        drawn = own.take(hit, axis=1)
                        node = _places(feature[i, t], cut[i, t], drawn, level) * BINS
                        weight = w[hit].astype(float)
                        weighted = weight * v[hit]
                        out = total.setdefault((i, t), np.zeros((2, width, cells)))
                        for f in range(width):
                            cell = node + drawn[f]
                            out[0, f] += np.bincount(cell, weight, cells)[:cells]
                            out[1, f] += np.bincount(cell, weighted, cells)[:cells]
        for (i, t), v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([t], pa.int64()), pa.array([v.tobytes()], pa.binary())], ["fit", "tree", "v"])

    return rows.mapInArrow(run, "fit long, tree long, v binary")


def _splits(parts: DataFrame, level: int, width: int, leaf: int, seed: int) -> DataFrame:
    """The best split of each node of the level that has rows: its value and cover, feature (-1: none) and bin, and its children's."""
    chosen, names = math.ceil(math.sqrt(width)), ["value", "cover", "left_value", "left_cover", "right_value", "right_cover"]

    def run(key, table):
        i, t = (k.as_py() for k in key)
        both = np.zeros((2, width, 1 << level, BINS))
        for v in table.column("v"):
            both += np.frombuffer(v.as_buffer(), np.float64).reshape(both.shape)
        rows = []
        for node in range(1 << level):
            w, s = both[:, :, node]
            cover, total = w[0].sum(), s[0].sum()
            if not cover:
                continue
            wl, sl = w.cumsum(1)[:, :-1], s.cumsum(1)[:, :-1]
            wr, sr = cover - wl, total - sl
            able = (wl >= max(leaf, 1)) & (wr >= max(leaf, 1))
            able[np.random.default_rng([seed, i, t, level, node]).permutation(width)[chosen:]] = False
            gain = np.where(able, sl**2 / np.where(able, wl, 1) + sr**2 / np.where(able, wr, 1) - total**2 / cover, -1)
            f, b = np.unravel_index(gain.argmax(), gain.shape)
            split = gain[f, b] > 1e-12 * total**2 / cover
            children = (sl[f, b] / wl[f, b], wl[f, b], sr[f, b] / wr[f, b], wr[f, b]) if split else (0.0,) * 4
            rows.append((i, t, (1 << level) - 1 + node, int(f) if split else -1, int(b), total / cover, cover, *children))
        columns = list(zip(*rows, strict=True)) or [()] * 11
        return pa.table({n: pa.array(c, pa.int64() if k < 5 else pa.float64()) for k, (n, c) in enumerate(zip(["fit", "tree", "node", "feature", "bin", *names], columns, strict=True))})

    return parts.groupBy("fit", "tree").applyInArrow(run, "fit long, tree long, node long, feature long, bin long, " + ", ".join(f"{n} double" for n in names))


def _merged(tree: dict[int, dict], node: int, same) -> dict[int, dict]:
    """The tree from the node on, where children that are leaves and the same to `same` are left out."""
    at = tree[node]
    if at["left"] < 0:
        return {node: at}
    left, right = (_merged(tree, at[c], same) for c in ("left", "right"))
    if len(left) == len(right) == 1 and same(left[at["left"]]["value"], right[at["right"]]["value"]):
        return {node: {**at, "left": -1, "right": -1}}
    return {node: at, **left, **right}


def fit_forests(df: DataFrame, features: list[str], y: str, fold: str, kinds: tuple[str, ...], trees: int, depth: int, leaf: int, seed: int, rate: float = 0.7) -> dict[tuple, list[dict[int, dict]]]:
    """(fold, kind): the trees of the forest fitted on all other folds, each of nodes (value, cover, left, right, feature, threshold), 0 the root.

    df is read three times and should be stored; then a pass for each level reads the packed rows for all folds, kinds and trees
    at once. The driver gets the splits only. Rows without a feature are left out; one without y or fold is an error.
    """
    if any(k not in KINDS for k in kinds):
        raise ValueError(f"kinds must be of {KINDS}")
    own = df.dropna(subset=features).select(F.col(fold).alias("_fold"), F.col(y).cast("double").alias("_y"), *(F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(features)))
    counts = {r[0]: r[1:] for r in own.groupBy("_fold").agg(F.count("*"), F.count_if(F.col("_y") > 0), F.count_if(F.col("_y").isNull() | F.isnan("_y"))).collect()}
    if None in counts or any(n[2] for n in counts.values()):
        raise ValueError(f"rows without {y} or {fold}")
    folds = sorted(counts)
    fits = [Fit(j, kind) for j in range(len(folds)) for kind in kinds]
    for f in fits:
        if not sum(n[f.kind == "severity"] for k, n in counts.items() if k != folds[f.fold]):
            raise ValueError(f"no rows to fit {f.kind} without fold {folds[f.fold]}")
    if not folds:
        return {}
    number = F.array_position(F.array(*(F.lit(k) for k in folds)), F.col("_fold")) - 1
    own = own.withColumn("_fold", number.cast("double"))
    cuts = bin_cuts(own, len(features), len(folds))
    rows = checkpointed(packed(own, cuts))
    rows = rows.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)
    feature = np.full((len(fits), trees, (1 << depth) - 1), -1)
    cut = np.zeros_like(feature)
    found: dict[tuple[int, int], dict[int, dict]] = {}
    for level in range(max(depth, 1)):
        split = False
        for r in _splits(_sums(rows, fits, feature, cut, level, len(features), abs(seed), rate), level, len(features), leaf, abs(seed)).collect():
            tree = found.setdefault((r["fit"], r["tree"]), {0: {"value": r["value"], "cover": r["cover"], "left": -1, "right": -1}})
            if r["feature"] < 0 or not depth:
                continue
            n, split = r["node"], True
            feature[r["fit"], r["tree"], n], cut[r["fit"], r["tree"], n] = r["feature"], r["bin"]
            tree[n] |= {"left": 2 * n + 1, "right": 2 * n + 2, "feature": r["feature"], "threshold": float(cuts[fits[r["fit"]].fold][r["feature"]][r["bin"]])}
            tree[2 * n + 1], tree[2 * n + 2] = ({"value": r[f"{c}_value"], "cover": r[f"{c}_cover"], "left": -1, "right": -1} for c in ("left", "right"))
        if not split:
            break
    out = {}
    for i, f in enumerate(fits):
        same = (lambda a, b: (a > 0.5) == (b > 0.5)) if f.kind == "occurrence" else (lambda a, b: a == b)
        own_trees = [found[i, t] for t in range(trees) if (i, t) in found]  # a tree that drew none of a few rows is left out
        if not own_trees:
            raise ValueError(f"too few rows to fit {f.kind} without fold {folds[f.fold]}")
        out[folds[f.fold], f.kind] = [_merged(t, 0, same) for t in own_trees]
    return out
