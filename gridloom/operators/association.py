"""Rank correlation: plain, partial, jackknifed, bootstrapped, matrices, pairs and their clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalar import correlation, ratio
from gridloom.operators.mixed import crossed
from gridloom.operators.order import running_totals
from gridloom.sources.scratch import checkpointed


def average_rank(x: str, keys: list[str], digits: int = 12) -> Column:
    """Mean rank of equal values (to `digits` decimals) in a group."""
    v = F.round(F.col(x).cast("double"), digits)
    return F.rank().over(Window.partitionBy(*keys).orderBy(v)) + (F.count("*").over(Window.partitionBy(*keys, v)) - 1) / 2.0


def ranked(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    own = df.where(" and ".join(f"`{c}` is not null" for c in columns))
    return own.withColumns({f"r_{c}": average_rank(c, keys) for c in columns})


def spearman(df: DataFrame, keys: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """n, rho and t of each group, over rows with both values; NULL for short or constant groups."""
    out = ranked(df, keys, [x, y]).groupBy(*keys).agg(F.count("*").alias("n"), correlation(F.col(f"r_{x}"), F.col(f"r_{y}")).alias("rho"))
    out = out.withColumn("rho", F.when(F.col("n") >= least, F.col("rho")))
    return out.withColumn("t", F.when(F.abs("rho") < 1 - 1e-12, F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho")))))


def partial_spearman(df: DataFrame, keys: list[str], x: str, y: str, given: str, least: int = 6) -> DataFrame:
    """Spearman correlation of x and y with the ranks of a third variable taken out, by its closed form.

    NULL where x or y goes with the third one exactly: what is left there is rounding noise."""
    own = ranked(df, keys, [x, y, given]).groupBy(*keys).agg(F.count("*").alias("n"), correlation(F.col(f"r_{x}"), F.col(f"r_{y}")).alias("xy"), correlation(F.col(f"r_{x}"), F.col(f"r_{given}")).alias("xg"), correlation(F.col(f"r_{y}"), F.col(f"r_{given}")).alias("yg"))
    left = (1 - F.col("xg") * F.col("xg")) * (1 - F.col("yg") * F.col("yg"))
    rho = F.when(left > 1e-12, (F.col("xy") - F.col("xg") * F.col("yg")) / F.sqrt(left))
    return own.select(*keys, "n", F.when(F.col("n") >= least, rho).alias("rho"))


def leave_one_out(df: DataFrame, keys: list[str], unit: str, x: str, y: str) -> DataFrame:
    """Range of rho over the groups that lack one unit, and the unit whose loss moves it most.

    A group is a short series: it is copied once for each of its units."""
    own = df.where(f"`{x}` is not null and `{y}` is not null")
    units = own.select(*keys, F.col(unit).alias("left_out")).distinct()
    copies = own.join(units, keys).where(F.col(unit) != F.col("left_out"))
    each = spearman(copies, [*keys, "left_out"], x, y).withColumn("rho", F.round("rho", 12) + 0.0)
    whole = spearman(own, keys, x, y).select(*keys, (F.round("rho", 12) + 0.0).alias("full"))
    out = each.join(whole, keys).withColumn("shift", F.round(F.abs(F.col("rho") - F.col("full")), 12))
    return out.groupBy(*keys).agg(F.first("full").alias("rho"), F.min("rho").alias("least"), F.max("rho").alias("greatest"), F.avg("rho").alias("mean"), (100 * F.avg((F.signum("rho") == F.signum("full")).cast("double"))).alias("same_sign_percent"), F.max_by("left_out", F.struct(F.col("shift"), -F.col("left_out"))).alias("influential"))


def bootstrap_spearman(df: DataFrame, keys: list[str], x: str, y: str, draws: int, seed: int = 2026) -> DataFrame:
    """2.5 and 97.5 percentiles of rho over draws of n rows with replacement; ranks are taken inside each draw."""
    own = ranked(df, keys, [x, y]).withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(x, y)) - 1)
    n = own.groupBy(*keys).agg(F.count("*").alias("n"))
    slots = n.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("slot", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    picked = slots.withColumn("i", F.pmod(F.xxhash64(F.lit(seed), *keys, "draw", "slot"), "n").cast("int")).select(*keys, "draw", "i")
    rho = spearman(picked.join(own.select(*keys, "i", x, y), [*keys, "i"]), [*keys, "draw"], x, y)
    return rho.groupBy(*keys).agg(F.percentile("rho", F.lit(0.025)).alias("low"), F.percentile("rho", F.lit(0.975)).alias("high"), F.count("rho").alias("draws"))


def value_ranks(long: DataFrame, keys: list[str], x: str, name: str, digits: int = 12) -> DataFrame:
    """long with the mean rank of x in its group: distinct values are counted first, and the counts added up by ranges."""
    own = long.withColumn("_v", F.round(F.col(x).cast("double"), digits))
    counts = own.groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    places = running_totals(checkpointed(counts), keys, "_v", ["_n"]).select(*keys, "_v", (F.col("before__n") + (F.col("_n") + 1) / 2.0).alias(name))
    return own.join(places, [*keys, "_v"]).drop("_v")


def pair_matrix(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """a, b, n and rho for each pair of columns with a < b, over rows in which both are there.

    With keys the groups are short series, ranked in windows. Without, a pair is as long as the table, so ranks come from counts
    of distinct values: those of a column without NULL once for all its pairs.
    """
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if keys:
        return spearman(df.select(*keys, F.inline(F.array(*pairs))), [*keys, "a", "b"], "x", "y")
    gaps = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns)).first()
    whole = [c for c in columns if not gaps[c]]
    out = _whole_pairs(df, whole) if len(whole) > 1 else None
    rest = [p for p, (a, b) in zip(pairs, ((a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]), strict=True) if out is None or a not in whole or b not in whole]
    if rest:
        long = df.select(F.inline(F.array(*rest))).where("x is not null and y is not null")
        own = value_ranks(value_ranks(long, ["a", "b"], "x", "rx"), ["a", "b"], "y", "ry")
        part = own.groupBy("a", "b").agg(F.count("*").alias("n"), correlation(F.col("rx"), F.col("ry")).alias("rho")).withColumn("rho", F.when(F.col("n") >= 3, F.col("rho")))
        out = part if out is None else out.unionByName(part)
    return out


def _whole_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """pair_matrix() of columns without NULL: each is ranked once, and the ranks' cross products are added up in one pass."""
    q = len(columns)
    rows = checkpointed(df.select(F.monotonically_increasing_id().alias("_row"), *(F.col(c).cast("double").alias(c) for c in columns)))
    long = rows.select("_row", F.inline(F.array(*(F.struct(F.lit(i).alias("at"), F.col(c).alias("x")) for i, c in enumerate(columns)))))
    ranks = value_ranks(long, ["at"], "x", "r").groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "r"))), lambda s: s["r"]).alias("r"))
    middle = F.broadcast(rows.agg(((F.count("*") + 1) / 2).alias("middle")))
    centred = ranks.crossJoin(middle).select(F.lit("").alias("_s"), F.lit(0).cast("long").alias("n"), F.transform("r", lambda r: r - F.col("middle")).alias("d"))
    cell = lambda i, j: F.get("cross", i * q + j)
    pairs = [F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.when((cell(i, i) > 0) & (cell(j, j) > 0), cell(i, j) / F.sqrt(cell(i, i) * cell(j, j))).alias("rho")) for i in range(q) for j in range(i + 1, q)]
    found = crossed(centred, q).select(F.col("k").alias("n"), F.inline(F.array(*pairs)))
    return found.select("a", "b", "n", F.when(F.col("n") >= 3, F.col("rho")).alias("rho"))


def clusters(edges: DataFrame, nodes: DataFrame, max_rounds: int = 30) -> DataFrame:
    """node and cluster (its least node) of the graph's components: least labels spread until they rest.

    For graphs of variables, which are small; rounds are cut from their lineage by checkpoints."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    now = nodes.select("node", F.col("node").alias("cluster"))
    for _ in range(max_rounds):
        near = both.join(now, F.col("b") == F.col("node")).groupBy("a").agg(F.min("cluster").alias("near"))
        new = now.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("cluster", F.coalesce("near", "cluster")).alias("cluster"), F.col("cluster").alias("was"))
        new = checkpointed(new)
        if not new.where("cluster <> was").limit(1).count():
            return new.drop("was")
        now = new.drop("was")
    raise RuntimeError("clusters did not settle")
