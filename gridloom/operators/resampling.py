"""Exact multinomial bootstrap of clusters within strata, without gathering a stratum or a row for each draw and cluster.

The clusters of a stratum are numbered. A draw with replacement of as many clusters as there are is a multinomial count, and that
splits down a tree of number ranges: of the draws that reach a range, a binomial share goes to its lower half. The binomials of a
range come from a generator keyed by seed, stratum, range and block of draws, so each task works out the ranges of its own
clusters and all tasks agree: multiplicities add up to the stratum's size, and members of a cluster share them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalar import ratio
from gridloom.operators.order import numbered
from gridloom.sources.scratch import checkpointed

#: A range of so many clusters is dealt at once by a multinomial.
LEAF = 64
#: Draws that a task holds at a time.
BLOCK = 500


def _generator(*key) -> np.random.Generator:
    digest = hashlib.blake2b(repr(key).encode(), digest_size=16).digest()
    return np.random.Generator(np.random.Philox(key=int.from_bytes(digest, "little")))


def multiplicities(seed: int, stratum: str, size: int, numbers: np.ndarray, first: int, draws: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, counts of `draws` draws from `first` on x those numbers) for the places of sorted distinct numbers below size.

    Only ranges that hold some of the numbers are split, so all of a stratum's tasks together do little more than one would.
    """
    open_ = [(0, size, np.full(draws, size, np.int64), 0, len(numbers))]
    while open_:
        low, high, reached, a, b = open_.pop()
        if a == b:
            continue
        g = _generator(seed, stratum, low, high, first)
        if high - low <= LEAF:
            counts = g.multinomial(reached, np.full(high - low, 1.0 / (high - low)))
            yield a, b, counts[:, numbers[a:b] - low]
            continue
        middle = (low + high) // 2
        left = g.binomial(reached, (middle - low) / (high - low))
        cut = a + int(np.searchsorted(numbers[a:b], middle))
        open_ += [(low, middle, left, a, cut), (middle, high, reached - left, cut, b)]


def _numbered(sums: DataFrame, keys: list[str], strata: list[str], cluster: str, values: list[str], seed: int) -> DataFrame:
    """stratum, size, number, key and values of each member of each cluster, clusters in order where they are.

    A cluster's members are one row while it is numbered: they are as many as there are models.
    """
    text = lambda cs: F.to_json(F.struct(*cs)) if cs else F.lit("{}")
    member = F.struct(text(keys).alias("key"), *(F.col(v).cast("double").alias(v) for v in values))
    own = sums.groupBy(text(strata).alias("stratum"), F.col(cluster).alias("cluster")).agg(F.collect_list(member).alias("members"))
    own = checkpointed(own)  # read three times; a row for each cluster
    sizes = own.groupBy("stratum").agg(F.count("*").alias("size"))
    placed = numbered(own, ["stratum"], F.xxhash64(F.lit(seed), "stratum", F.col("cluster").cast("string")), ["cluster"], "number")
    return placed.join(sizes, "stratum").sortWithinPartitions("stratum", "number").select("stratum", "size", "number", F.inline("members"))


def _batches(frames, seed: int, draws: int):
    """(frame, its rows' places in `counts`, first draw, counts) for every range of clusters of the batches."""
    for frame in frames:
        for (stratum, size), part in frame.groupby(["stratum", "size"], sort=False):
            numbers, place = np.unique(part["number"].to_numpy(np.int64), return_inverse=True)
            order = np.argsort(place, kind="stable")
            for first in range(0, draws, BLOCK):
                for a, b, counts in multiplicities(seed, stratum, int(size), numbers, first, min(BLOCK, draws - first)):
                    rows = order[np.searchsorted(place[order], a) : np.searchsorted(place[order], b)]
                    yield part.iloc[rows], place[rows] - a, first, counts


def resampled(sums: DataFrame, keys: list[str], strata: list[str], cluster: str, values: list[str], draws: int, seed: int = 2026) -> DataFrame:
    """keys, draw (1 to draws) and the values' totals over the clusters drawn, as often as they are drawn.

    sums: a row for each of the few members (keys) of each cluster. A cluster belongs to one stratum; one that is in two is two
    clusters. A task adds up what it holds, so a row for each member and draw leaves it. NULL values count as 0; NULL in keys,
    strata or cluster is a value of its own. An empty table gives no rows.
    """

    def run(frames):
        total: dict[str, np.ndarray] = {}
        for part, at, first, counts in _batches(frames, seed, draws):
            x = part[values].to_numpy(float)
            x[np.isnan(x)] = 0.0
            names = part["key"].to_numpy(object)
            for name in dict.fromkeys(names):
                mine = names == name
                sum_ = total.setdefault(name, np.zeros((draws, len(values))))
                sum_[first : first + len(counts)] += counts[:, at[mine]] @ x[mine]
        for name, sum_ in total.items():
            out = pd.DataFrame(sum_, columns=values)
            out.insert(0, "draw", np.arange(1, draws + 1))
            out.insert(0, "key", name)
            yield out

    own = _numbered(sums, keys, strata, cluster, values, seed)
    each = own.mapInPandas(run, "key string, draw long, " + ", ".join(f"`{v}` double" for v in values))
    summed = each.groupBy("key", "draw").agg(*(F.sum(v).alias(v) for v in values))
    types = sums.select(*keys).schema
    return summed.select(*(F.from_json("key", types).getField(k).alias(k) for k in keys), "draw", *values)


def draw_checks(sums: DataFrame, strata: list[str], cluster: str, draws: int, seed: int = 2026) -> DataFrame:
    """strata, clusters, draws, and over the draws of a stratum the least and greatest total, the mean number of different clusters
    and the greatest multiplicity."""

    def run(frames):
        total: dict[str, np.ndarray] = {}
        for part, at, first, counts in _batches(frames, seed, draws):
            sum_ = total.setdefault(part["stratum"].iloc[0], np.zeros((draws, 3), np.int64))
            mine = sum_[first : first + len(counts)]
            mine[:, 0] += counts[:, at].sum(1)
            mine[:, 1] += (counts[:, at] > 0).sum(1)
            mine[:, 2] = np.maximum(mine[:, 2], counts[:, at].max(1))
        for stratum, sum_ in total.items():
            out = pd.DataFrame(sum_, columns=["total", "different", "most"])
            out.insert(0, "draw", np.arange(1, draws + 1))
            out.insert(0, "stratum", stratum)
            yield out

    once = sums.select(*strata, cluster).distinct()
    own = _numbered(once, [], strata, cluster, [], seed)
    sizes = once.groupBy(F.to_json(F.struct(*strata)).alias("stratum") if strata else F.lit("{}").alias("stratum")).agg(F.count("*").alias("clusters"))
    each = own.mapInPandas(run, "stratum string, draw long, total long, different long, most long").groupBy("stratum", "draw").agg(F.sum("total").alias("total"), F.sum("different").alias("different"), F.max("most").alias("most"))
    out = each.groupBy("stratum").agg(F.count("*").alias("draws"), F.min("total").alias("least"), F.max("total").alias("greatest"), F.avg("different").alias("mean_different"), F.max("most").alias("most"))
    types = sums.select(*strata).schema
    return out.join(sizes, "stratum").select(*(F.from_json("stratum", types).getField(k).alias(k) for k in strata), "clusters", "draws", "least", "greatest", "mean_different", "most")


SUMS = ("n", "n_positive", "rate_se", "rate_ae", "rate_e", "count_se", "count_ae", "count_e", "brier", "chance_e", "positive_rate_se", "positive_rate_ae", "positive_count_se", "positive_count_ae")
METRICS = (
    "rate_rmse", "rate_mae", "count_rmse", "count_mae", "brier", "positive_rate_rmse", "positive_rate_mae", "positive_count_rmse", "positive_count_mae", "rate_abs_bias", "count_abs_bias", "chance_abs_bias",
)


def hurdle_sums(df: DataFrame, keys: list[str], y: str = "observed", f: str = "predicted", p: str = "p", exposure: str = "exposure", severity: str = "severity") -> DataFrame:
    """SUMS by keys: numbers and error sums of counts and rates, over all rows and (by the expected count of a positive row,
    severity) over positive rows, and of the chance p of a positive one. Rows without a positive exposure are left out."""
    o, e = (F.col(y) > 0).cast("double"), F.col(exposure).cast("double")
    count, cond, chance = F.col(f) - F.col(y), F.col(severity) - F.col(y), F.col(p) - o
    yes = lambda x: F.sum(F.when(F.col(y) > 0, x).otherwise(0.0))
    cells = [F.count("*"), F.sum(o), F.sum(count * count / e / e), F.sum(F.abs(count) / e), F.sum(count / e), F.sum(count * count), F.sum(F.abs(count)), F.sum(count), F.sum(chance * chance), F.sum(chance)]
    cells += [yes(cond * cond / e / e), yes(F.abs(cond) / e), yes(cond * cond), yes(F.abs(cond))]
    return df.where(e > 0).groupBy(*keys).agg(*(c.alias(name) for c, name in zip(cells, SUMS, strict=True)))


def hurdle_metrics(sums: DataFrame, keys: list[str]) -> DataFrame:
    """keys and METRICS from SUMS; those of positive rows are NULL without one."""
    per = lambda c, n="n": ratio(F.col(c), F.col(n))
    root = lambda c, n="n": F.sqrt(per(c, n))
    cells = [root("rate_se"), per("rate_ae"), root("count_se"), per("count_ae"), per("brier"), root("positive_rate_se", "n_positive"), per("positive_rate_ae", "n_positive")]
    cells += [root("positive_count_se", "n_positive"), per("positive_count_ae", "n_positive"), *(F.abs(per(c)) for c in ("rate_e", "count_e", "chance_e"))]
    return sums.select(*keys, *(c.alias(name) for c, name in zip(cells, METRICS, strict=True)))
