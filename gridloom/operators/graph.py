"""Components of a graph by merging nodes along edges in random order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources.scratch import checkpointed, tables


def weak_components(edges: DataFrame, a: str = "source", b: str = "neighbour", seed: int = 2026) -> DataFrame:
    """node and component (its least node) of every node of an edge table, whatever the edges' direction.

    A round lets every node follow the least of itself and its neighbours by a hash that is new in each round, and merges it
    into that node; the edges between merged nodes are the next round's. At least a quarter of the nodes is expected to go in a
    round, whatever the graph's diameter, and many more where nodes have several neighbours. Rounds are written out as tables, since
    checkpoints would multiply their guesses of sizes. One count a round comes to the driver.
    """
    own = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    with tables(edges.sparkSession) as (store, drop):
        both = store(own.unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
        now = store(both.select(F.col("u").alias("node"), F.col("u").alias("c")).distinct())
        both, turn = store(both.where("u <> v")), 0
        while both.limit(1).count():
            turn += 1
            by = lambda c: F.struct(F.xxhash64(F.lit(seed + turn), c).alias("h"), F.col(c).alias("c"))  # noqa: B023, E731
            to = store(both.groupBy("u").agg(F.least(F.min(by("v")), F.first(by("u")))["c"].alias("c")))
            new = store(now.join(to.select(F.col("u").alias("c"), F.col("c").alias("further")), "c", "left").select("node", F.coalesce("further", "c").alias("c")))
            left = both.join(to.withColumnRenamed("c", "cu"), "u").join(to.select(F.col("u").alias("v"), F.col("c").alias("cv")), "v")
            merged = store(left.where("cu <> cv").select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct())
            for gone in (now, both, to):
                drop(gone)
            now, both = new, merged
        least = now.groupBy("c").agg(F.min("node").alias("component"))
        return checkpointed(now.join(least, "c").select("node", "component"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count("*").alias("n_nodes"))
