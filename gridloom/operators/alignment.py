"""Joins that say what met and what did not: outer comparison, reference order, match marks, wide members, key checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalar import close


def outer_compare(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], absolute: float = 1e-9, relative: float = 0.0) -> DataFrame:
    """Full outer join on keys: status (both, left, right), each value of either side, and whether all agree.

    Two missing values agree, one missing does not; rows of one side only have no agreement.
    """
    left = a.select(*keys, *(F.col(v).alias(f"left_{v}") for v in values), F.lit(True).alias("_l"))
    right = b.select(*keys, *(F.col(v).alias(f"right_{v}") for v in values), F.lit(True).alias("_r"))
    out = left.join(right, keys, "full_outer")
    same = [F.coalesce(close(F.col(f"left_{v}"), F.col(f"right_{v}"), absolute, relative), F.col(f"left_{v}").isNull() & F.col(f"right_{v}").isNull()) for v in values]
    status = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left").otherwise("right")
    return out.withColumns({"status": status, "agree": F.when(F.col("_l") & F.col("_r"), reduce(Column.__and__, same))}).drop("_l", "_r")


def reconciliation(compared: DataFrame) -> DataFrame:
    """How many rows of outer_compare() are of each kind, and whether the two tables are the same."""
    count = lambda c: F.count_if(c)
    both, agree = F.col("status") == "both", F.coalesce("agree", F.lit(False))
    out = compared.agg(count(both).alias("n_both"), count(F.col("status") == "left").alias("n_left"), count(F.col("status") == "right").alias("n_right"), count(both & ~agree).alias("n_differ"))
    return out.withColumn("reconciled", (F.col("n_left") == 0) & (F.col("n_right") == 0) & (F.col("n_differ") == 0))


def reindexed(reference: DataFrame, df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The keys of the reference, each once, with df's values; found tells whether df has the key."""
    return reference.select(*keys).distinct().join(df.select(*keys, *values, F.lit(True).alias("found")), keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def match_counts(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a, those with and without a key of b, and distinct keys of b that a lacks."""
    marks = b.select(*keys).distinct().withColumn("_m", F.lit(True))
    own = a.join(marks, keys, "left").agg(F.count("*").alias("n_rows"), F.count("_m").alias("n_matched"), F.count_if(F.col("_m").isNull()).alias("n_unmatched"))
    return own.crossJoin(marks.join(a.select(*keys), keys, "left_anti").agg(F.count("*").alias("n_reverse")))


def wide_members(df: DataFrame, keys: list[str], member: str, members: list[str], values: list[str]) -> DataFrame:
    """One row for each key that all members have, with a column for each member and value: one aggregation, no joins."""
    cells = [F.first(F.when(F.col(member) == m, F.col(v)), ignorenulls=True).alias(f"{m}_{v}") for m in members for v in values]
    has = F.count_distinct(F.when(F.col(member).isin(members), F.col(member)))
    return df.groupBy(*keys).agg(*cells, has.alias("_n")).where(F.col("_n") == len(members)).drop("_n")


def sample_checks(base: DataFrame, stored: DataFrame, keys: list[str], values: list[str], absolute: float = 1e-9) -> DataFrame:
    """The stored sample rebuilt from the base table by key: rows that met, that the base lacks, and that differ in each value."""
    right = stored.select(*keys, *(F.col(v).alias(f"_s_{v}") for v in values))
    own = right.join(base.select(*keys, *values, F.lit(True).alias("_b")), keys, "left")
    differ = [F.count_if(F.col("_b") & ~F.coalesce(close(F.col(v), F.col(f"_s_{v}"), absolute), F.col(v).eqNullSafe(F.col(f"_s_{v}")))).alias(f"n_differ_{v}") for v in values]
    return own.agg(F.count("_b").alias("n_rebuilt"), F.count_if(F.col("_b").isNull()).alias("n_lacking"), *differ)


def key_checks(df: DataFrame, keys: list[str], groups: list[str], totals: list[str]) -> DataFrame:
    """For each group: rows, distinct keys, NULL keys, and totals: what a loader compares before it goes on."""
    gone = reduce(Column.__or__, (F.col(k).isNull() for k in keys))
    return df.groupBy(*groups).agg(F.count("*").alias("n_rows"), F.count_distinct(F.struct(*keys)).alias("n_keys"), F.count_if(gone).alias("n_null_keys"), *(F.sum(t).alias(f"total_{t}") for t in totals)).withColumn("unique_keys", F.col("n_rows") == F.col("n_keys"))


def set_comparison(df: DataFrame, group: str, a, b, item: str) -> DataFrame:
    """Sizes of the distinct items of two groups, of what both have, and whether they are the same set."""
    own = df.where(F.col(group).isin(a, b)).groupBy(item).agg(F.max((F.col(group) == a).cast("int")).alias("a"), F.max((F.col(group) == b).cast("int")).alias("b"))
    out = own.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * F.col("b")).alias("n_both"))
    return out.withColumn("equal", (F.col("n_a") == F.col("n_both")) & (F.col("n_b") == F.col("n_both")))


def seeded_sample(df: DataFrame, groups: list[str], keys: list[str], n: int, seed: int) -> DataFrame:
    """n rows of each group without replacement: those that come first by a hash of seed and key, so the same every time.

    Rows meet in their group; the group limit lets Spark keep n rows for each before the shuffle.
    """
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))
    w = Window.partitionBy(*groups).orderBy("_h", *keys)
    return df.withColumn("_h", order).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_h", "_k")


def top_rows(df: DataFrame, groups: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, with place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("place") <= n)


def omission_candidates(blocks: DataFrame) -> DataFrame:
    """candidate and its predictors (sorted): all predictors, and all without each block (blocks: block, predictor).

    A list of predictors is a small fixed table, so it fits one array.
    """
    every = blocks.agg(F.array_sort(F.collect_set("predictor")).alias("every"))
    own = blocks.groupBy("block").agg(F.collect_set("predictor").alias("own")).crossJoin(F.broadcast(every))
    out = own.select(F.concat(F.lit("without "), "block").alias("candidate"), F.array_except("every", "own").alias("predictors"))
    out = out.unionByName(every.select(F.lit("all").alias("candidate"), F.col("every").alias("predictors")))
    return out.select("candidate", F.size("predictors").alias("n_predictors"), F.array_join("predictors", ";").alias("predictors"))


def recode(x: Column, mapping: dict[str, str], other: str | None = None) -> Column:
    """A column by a fixed dictionary; values that it lacks become `other`, or stay."""
    out = reduce(lambda acc, kv: acc.when(x == kv[0], kv[1]), mapping.items(), F)
    return out.otherwise(x if other is None else F.lit(other))


def edge_differences(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Neighbour tables compared by source and rank: rows of each side only, other neighbours, distances that differ."""
    left = a.select("source", "rank", F.col("neighbour").alias("a"), F.col("distance").alias("da"))
    right = b.select("source", "rank", F.col("neighbour").alias("b"), F.col("distance").alias("db"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return left.join(right, ["source", "rank"], "full_outer").agg(
        F.count_if(both).alias("n_both"),
        F.count_if(F.col("b").isNull()).alias("n_left"),
        F.count_if(F.col("a").isNull()).alias("n_right"),
        F.count_if(both & (F.col("a") != F.col("b"))).alias("n_other_neighbour"),
        F.count_if(both & (F.abs(F.col("da") - F.col("db")) > tolerance)).alias("n_other_distance"),
    )
