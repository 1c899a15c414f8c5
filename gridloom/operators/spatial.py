"""Nearest neighbours by cells, Moran's I with permutations, blocks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.order import RANGES, _ranges, numbered
from gridloom.operators.shuffles import bijection, dealt
from gridloom.sources.scratch import checkpointed


#: Depth of the tree of cells: a cell's width is the greater side of the points' box by 2 to the level.
DEEPEST = 36
#: Levels that are counted in one pass.
STRIDE = 8


def _at(level: Column, box, x: str = "x", y: str = "y") -> tuple[Column, Column]:
    """A place's cell at a level."""
    scale = F.pow(F.lit(2.0), level) / F.lit(box["span"])
    return F.floor((F.col(x) - F.lit(box["x0"])) * scale), F.floor((F.col(y) - F.lit(box["y0"])) * scale)


def _by_level(df: DataFrame, box, levels: list[int]) -> DataFrame:
    """df with level, cx and cy: its rows' cells at each of the levels."""
    own = df.withColumn("level", F.explode(F.array(*(F.lit(level) for level in levels))))
    cx, cy = _at(F.col("level"), box)
    return own.withColumns({"cx": cx, "cy": cy})


def _levels(places: DataFrame, box, least: int) -> DataFrame:
    """x, y and level of each place: the finest one at which its cell holds at least `least` points, 0 if none does.

    A few levels about the mean density are counted first. Places whose cells are still full go on to finer ones, counting only
    each other (a full cell goes on as a whole), and those whose cells are all too empty to coarser ones.
    """
    first = min(max(int(math.log2(max(box["n"] / (4.0 * least), 1.0)) / 2) - 3, 0), DEEPEST)
    done = None

    def counted(open_: DataFrame, pool: DataFrame, levels: list[int]) -> DataFrame:
        full = _by_level(pool, box, levels).groupBy("level", "cx", "cy").agg(F.sum("n").alias("m")).where(F.col("m") >= least).select("level", "cx", "cy")
        return checkpointed(_by_level(open_, box, levels).join(full, ["level", "cx", "cy"]).groupBy("x", "y", "n").agg(F.max("level").alias("level")))

    def add(part: DataFrame) -> None:
        nonlocal done
        part = part.select("x", "y", "level")
        done = part if done is None else done.unionByName(part)

    low, open_ = first, places
    while True:
        high = min(low + STRIDE - 1, DEEPEST)
        found = counted(open_, open_, list(range(low, high + 1)))
        if low == first:
            lacking = places.join(found.select("x", "y"), ["x", "y"], "left_anti")
        else:  # full at the level before, at none of these
            add(open_.join(found.select("x", "y"), ["x", "y"], "left_anti").withColumn("level", F.lit(low - 1)))
        if high == DEEPEST:
            add(found)
            break
        add(found.where(F.col("level") < high))
        open_, low = found.where(F.col("level") == high).select("x", "y", "n"), high + 1
        if not open_.limit(1).count():
            break
    high = first - 1
    while lacking.limit(1).count():
        if high < 0:
            add(lacking.withColumn("level", F.lit(0)))
            break
        low = max(high - STRIDE + 1, 0)
        found = counted(lacking, places, list(range(low, high + 1)))
        add(found)
        lacking, high = checkpointed(lacking.join(found.select("x", "y"), ["x", "y"], "left_anti")), low - 1
    return checkpointed(done)


def nearest(points: DataFrame, k: int, x: str = "x", y: str = "y", key: str = "grid_uid") -> DataFrame:
    """source, neighbour, rank, distance of each point's k nearest others, ties by key: exact, without a cross join.

    Points of one place are answered together, and of a place the k + 1 least keys are all that anyone can need. A place's cell is
    the smallest of a tree of cells that holds more than k points, so the k-th neighbour is no farther than the cell's
    farthest corner: the place meets the cells of that width within this distance, 25 at most, and is done. A cell holds
    few of those who ask at its level, however dense the points are.
    Coordinates are doubles; rows without one are left out; fewer than k other points give fewer neighbours. Keys are distinct.
    Places nearer to each other than the box's side by 2 to DEEPEST share a cell.
    """
    own = points.select(F.col(key).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    own = own.withColumns({c: F.col(c) + 0.0 for c in ("x", "y")})  # -0 is 0
    limits = own.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")).first()
    empty = own.select(F.col("id").alias("source"), F.col("id").alias("neighbour"), F.lit(1).alias("rank"), F.lit(0.0).alias("distance")).limit(0)
    if limits["n"] < 2:
        return empty
    box = {"n": limits["n"], "x0": limits["x0"], "y0": limits["y0"], "span": max(limits["w"], limits["h"], 1e-300) * (1 + 1e-9)}
    few = own.withColumn("_r", F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))).where(F.col("_r") <= k + 1).drop("_r")
    places = checkpointed(own.groupBy("x", "y").agg(F.count("*").alias("n")))
    asked = _levels(places, box, k + 1)
    used = sorted(r[0] for r in asked.select("level").distinct().collect())
    width = F.lit(box["span"]) / F.pow(F.lit(2.0), F.col("level"))
    cx, cy = _at(F.col("level"), box)
    asked = asked.withColumns({"w": width, "ax": cx, "ay": cy}).withColumns({"lx": F.col("x") - box["x0"] - F.col("ax") * F.col("w"), "ly": F.col("y") - box["y0"] - F.col("ay") * F.col("w")})
    far = lambda c: F.greatest(F.col(c), F.col("w") - F.col(c))
    near = lambda c, i: F.greatest(F.lit(0.0), F.col(i) * F.col("w") - F.col(c), F.col(c) - (F.col(i) + 1) * F.col("w"))
    asked = asked.withColumn("reach", F.sqrt(far("lx") * far("lx") + far("ly") * far("ly")) * (1 + 1e-9) + box["span"] * 1e-13)
    steps = F.array(*(F.lit(i) for i in range(-2, 3)))
    asked = asked.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps)).withColumns({"dx": near("lx", "i"), "dy": near("ly", "j")}).where(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) <= F.col("reach"))
    asked = asked.select("x", "y", "level", (F.col("ax") + F.col("i")).alias("cx"), (F.col("ay") + F.col("j")).alias("cy"))
    there = _by_level(few, box, used).select("level", "cx", "cy", F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    d = F.sqrt((F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy")))
    found = asked.join(there, ["level", "cx", "cy"]).select("x", "y", "other", d.alias("distance"))
    found = found.withColumn("_r", F.row_number().over(Window.partitionBy("x", "y").orderBy("distance", "other"))).where(F.col("_r") <= k + 1)
    answers = found.groupBy("x", "y").agg(F.array_sort(F.collect_list(F.struct("distance", "other"))).alias("near"))
    own = own.join(answers, ["x", "y"]).select("id", F.slice(F.filter("near", lambda o: o["other"] != F.col("id")), 1, k).alias("near"))
    return checkpointed(own.select(F.col("id").alias("source"), F.posexplode("near").alias("i", "o")).select("source", F.col("o.other").alias("neighbour"), (F.col("i") + 1).alias("rank"), F.col("o.distance").alias("distance")))


def graph_checks(edges: DataFrame, k: int) -> DataFrame:
    """Edges, sources, whether each has k, share of reciprocal edges, distances."""
    back = edges.select(F.col("neighbour").alias("source"), F.col("source").alias("neighbour"), F.lit(1).alias("back"))
    own = edges.join(back, ["source", "neighbour"], "left")
    degree = edges.groupBy("source").agg(F.count("*").alias("d")).agg(F.count("*").alias("n_sources"), (F.min("d") == k).alias("all_have_k"))
    return own.agg(F.count("*").alias("n_edges"), F.avg(F.coalesce("back", F.lit(0)).cast("double")).alias("reciprocal_share"), F.min("distance").alias("least"), F.avg("distance").alias("mean"), F.max("distance").alias("greatest")).crossJoin(degree)


def moran(points: DataFrame, edges: DataFrame, value: str, key: str = "grid_uid") -> DataFrame:
    """n, I and its expectation, with weights that sum to 1 for each source."""
    own = points.select(F.col(key).alias("id"), F.col(value).cast("double").alias("v")).where("v is not null")
    mean = own.agg(F.avg("v").alias("m"), F.count("*").alias("n"), F.var_pop("v").alias("s2"))
    z = own.crossJoin(F.broadcast(mean)).select("id", (F.col("v") - F.col("m")).alias("z"))
    e = edges.select("source", "neighbour", (1.0 / F.count("*").over(Window.partitionBy("source"))).alias("w"))
    pair = e.join(z.select(F.col("id").alias("source"), F.col("z").alias("zi")), "source").join(z.select(F.col("id").alias("neighbour"), F.col("z").alias("zj")), "neighbour")
    s = pair.agg(F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("a"), F.sum("w").alias("s0"))
    return mean.crossJoin(s).select("n", (F.col("a") / F.col("s0") / F.col("s2")).alias("moran"), (-1.0 / (F.col("n") - 1)).alias("expected"))


def _drawn_there(pairs: DataFrame, base: DataFrame, n: int, permutations: int, seed: int, order: str) -> DataFrame:
    """k and a: the weighted mean product over pairs (i, j, w, order) for each shuffle, by tasks that hold all values of base (i, z) and a range of the pairs.

    Pairs go by ranges of their source's place, so that a range has few ends; a shuffle is looked up for those only.
    """

    def pack(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_numpy().tobytes()], pa.binary()), pa.array([b.column(1).to_numpy().tobytes()], pa.binary())], ["i", "z"])

    def run(left, right):
        z = np.empty(n)
        for i, v in zip(right.column("i").to_pylist(), right.column("z").to_pylist(), strict=True):
            z[np.frombuffer(i, np.int64)] = np.frombuffer(v)
        s, w = left.column("i").to_numpy(), left.column("w").to_numpy()
        if not len(s):
            return pa.table({"k": pa.array([], pa.int64()), "c": pa.array([], pa.float64()), "w": pa.array([], pa.float64())})
        ends, at = np.unique(np.r_[s, left.column("j").to_numpy()], return_inverse=True)
        s, t, out = at[: len(s)], at[len(s) :], np.empty(permutations)
        for d in range(permutations):
            y = z[bijection(ends, n, seed * 1_000_003 + d, back=True)]
            out[d] = np.dot(w * y[s], y[t])
        return pa.table({"k": np.arange(permutations), "c": out, "w": np.full(permutations, w.sum())})

    ranges = max(2, min(RANGES, n // 800))  # a shuffle has a fixed cost in each
    cut = _ranges(pairs, order, ranges).select("_range", "i", "j", "w")
    all_z = base.select(F.col("i").cast("long"), "z").mapInArrow(pack, "i binary, z binary").crossJoin(base.sparkSession.range(ranges).select(F.col("id").cast("int").alias("_range")))
    sums = cut.groupBy("_range").cogroup(all_z.groupBy("_range")).applyInArrow(run, "k long, c double, w double")
    return sums.groupBy("k").agg((F.sum("c") / F.sum("w")).alias("a"))


def moran_permutation(points: DataFrame, edges: DataFrame, value: str, permutations: int, key: str = "grid_uid", seed: int = 2026, batch: int = 250, most: int = 1 << 22) -> DataFrame:
    """moran() with the pseudo p of `permutations` shuffles of the values: two-sided on |I - E|, one-sided for a greater I, the
    standard errors of both from the number of shuffles, z and the shuffles' spread.

    Points are numbered once; a keyed bijection of the numbers is a shuffle, so none is sorted. Up to `most` points (counted first; 32 MB of
    values) a task holds all values and a range of the edges, along points' x where they have one: no value is moved for a shuffle. Beyond
    that, a point holds its values of `batch` shuffles as one array, so an edge is joined once for a batch and multiplies
    arrays. Either way only sums by shuffle move on, and both have the same shuffles."""
    own = points.select(F.col(key).alias("id"), F.col(value).cast("double").alias("v"), (F.col("x").cast("double") if "x" in points.columns else F.lit(None).cast("double")).alias("o")).where("v is not null")
    real = moran(points, edges, value, key)
    mean = own.agg(F.avg("v").alias("m"), F.var_pop("v").alias("s2"), F.count("*").alias("n"))
    base = checkpointed(numbered(own, [], F.xxhash64(F.lit(seed), "id"), ["id"], "i").crossJoin(F.broadcast(mean.select("m", "s2"))).select("id", "i", (F.col("v") - F.col("m")).alias("z"), F.coalesce("o", F.col("i").cast("double")).alias("o")))
    n = base.count()
    e = edges.select("source", "neighbour", (1.0 / F.count("*").over(Window.partitionBy("source"))).alias("w"))
    if n <= most:
        pairs = e.join(base.select(F.col("id").alias("source"), "i", "o"), "source").join(base.select(F.col("id").alias("neighbour"), F.col("i").alias("j")), "neighbour")
        each = _drawn_there(checkpointed(pairs.select(F.col("i").cast("long"), F.col("j").cast("long"), "w", "o")), base, n, permutations, seed, "o")
    else:
        values = checkpointed(dealt(base, "i", "z", n, permutations, seed, batch).join(base.select("i", "id"), "i").select("id", "part", "zs"))
        pair = e.join(values.select(F.col("id").alias("source"), "part", F.col("zs").alias("a")), "source").join(values.select(F.col("id").alias("neighbour"), "part", F.col("zs").alias("b")), ["neighbour", "part"])
        each = pair.select("part", "w", F.posexplode(F.zip_with("a", "b", lambda a, b: a * b)).alias("k", "c")).groupBy("part", "k").agg((F.sum(F.col("w") * F.col("c")) / F.sum("w")).alias("a"))
    both = each.crossJoin(F.broadcast(mean.select("s2"))).select((F.col("a") / F.col("s2")).alias("i")).crossJoin(F.broadcast(real))
    wide = F.count_if(F.abs(F.col("i") - F.col("expected")) >= F.abs(F.col("moran") - F.col("expected")))
    above, n = F.count_if(F.col("i") >= F.col("moran")), F.count("*")
    out = both.agg(F.first("n").alias("n"), F.first("moran").alias("moran"), F.first("expected").alias("expected"), ((wide + 1) / (n + 1)).alias("p"), ((above + 1) / (n + 1)).alias("p_greater"), ((F.first("moran") - F.avg("i")) / F.stddev_samp("i")).alias("z"), F.stddev_samp("i").alias("spread"), n.alias("permutations"))
    return out.withColumns({f"{c}_error": F.sqrt(F.col(c) * (1 - F.col(c)) / (F.col("permutations") + 1)) for c in ("p", "p_greater")})
