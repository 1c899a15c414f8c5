"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets verify them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import byte_batches, mix, shingle_hashes, texts, word_hashes, written
from gridloom.llm.components import components

NGRAM, SIMILARITY, RECALL = 5, 0.8, 0.9999
#: Tasks over which the members of one large cell are dealt while they get their chunks.
SALTS = 64


def choose_bands(similarity: float, recall: float, max_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows for which a pair at `similarity` shares a band with probability `recall`."""
    best = None
    for rows in range(1, max_hashes + 1):
        p = similarity**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p)) if p > 1e-9 else max_hashes + 1
        if bands * rows <= max_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no band and row counts reach this recall with so few hashes")
    return best


def ngram_sets(batch: list[str], n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; a text of fewer words has one n-gram, of all its words."""
    words, first = word_hashes(batch)
    return [np.unique(shingle_hashes(words[a:b], n)) for a, b in zip(first[:-1], first[1:], strict=True)]


def _signatures(sets: list[np.ndarray], bands: int, rows: int) -> list[np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(2026))
    a = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for own in sets:
            if not len(own):
                out.append(np.zeros(0, np.int64))
                continue
            least = np.full(bands * rows, np.uint64(2**64 - 1))
            for k in range(0, len(own), 256):
                least = np.minimum(least, (own[k : k + 256, None] * a + b).min(0))
            least = least.reshape(bands, rows)
            band = np.arange(1, bands + 1, dtype=np.uint64)
            for r in range(rows):
                band = mix(band + least[:, r])
            out.append(band.view(np.int64))
    return out


def set_hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit hash of each set, as two numbers."""
    one = np.array([np.bitwise_xor.reduce(mix(s)) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
    two = np.array([np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
    return one, two


def sketch(df: DataFrame, n: int, bands: int, rows: int, batch_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, set_1 and set_2 (a 128-bit hash of the n-gram set), n_grams and the band hashes of each row."""

    def run(batches):
        for ids, batch in byte_batches(batches, batch_bytes):
            sets = ngram_sets(batch, n)
            one, two = set_hashes(sets)
            sigs = [s.tolist() for s in _signatures(sets, bands, rows)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(one), pa.array(two), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.list_(pa.int64()))], ["doc_id", "set_1", "set_2", "n_grams", "bands"])

    return texts(df).mapInArrow(run, "doc_id long, set_1 long, set_2 long, n_grams long, bands array<long>")


def shared_counts(sets: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Matrix of the sizes of the intersections of different sets (the diagonal means nothing)."""
    k = len(sets)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(k), [len(s) for s in sets])
    df = np.bincount(column, minlength=len(values))
    everywhere = int(np.count_nonzero(df == k))
    use = (df > 1) & (df < k)
    place = np.cumsum(use) - 1
    keep = use[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.full((k, k), everywhere, np.float32)
    total = int(use.sum())
    for a in range(0, total, columns):
        lo, hi = np.searchsorted(column, (a, a + columns))
        part = np.zeros((k, min(columns, total - a)), np.float32)
        part[row[lo:hi], column[lo:hi] - a] = 1
        out += part @ part.T
    return out


def verify_cell(cell: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links among the rows of one cell that this cell owns: link counts (kind 0) and edges to local roots (kind 1).

    cell: hub, left, right (chunk numbers), chunk, rep, copies, hubs, grams. A pair belongs to the cell of the
    least hub that both its members have, and to the chunk pair that both are in.
    """
    ids = cell["rep"].to_numpy(np.int64)
    sets = [np.frombuffer(g, np.uint64) for g in cell["grams"]]
    size = np.array([len(s) for s in sets], np.float64)
    inter = shared_counts(sets)
    linked = inter >= similarity * (size[:, None] + size[None, :] - inter) - 1e-6
    hub, left, right = (int(cell[c].iloc[0]) for c in ("hub", "left", "right"))
    if left != right:
        chunk = cell["chunk"].to_numpy()
        linked &= chunk[:, None] != chunk[None, :]
    linked &= ids[:, None] != ids[None, :]
    smaller: dict[int, list[int]] = {}
    for k, hubs in enumerate(cell["hubs"]):
        for g in hubs:
            if g < hub:
                smaller.setdefault(int(g), []).append(k)
    for rows in smaller.values():
        if len(rows) > 1:
            linked[np.ix_(rows, rows)] = False
    degree = linked @ cell["copies"].to_numpy(np.int64)
    root = ids.copy()
    while True:
        best = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(1))
        if (best == root).all():
            break
        root = best
    some, moved = degree > 0, root != ids
    return pd.DataFrame({"kind": np.r_[np.zeros(some.sum(), np.int32), np.ones(moved.sum(), np.int32)], "rep": np.r_[ids[some], ids[moved]], "value": np.r_[degree[some], root[moved]].astype(np.int64)})


def near_duplicates(df: DataFrame, n: int = NGRAM, similarity: float = SIMILARITY, recall: float = RECALL, chunk_rows: int = 384, chunk_grams: int = 1_000_000) -> DataFrame:
    """doc_id, class_id, n_copies and n_links for each row of df (doc_id, text).

    Two documents link if the Jaccard similarity of their sets of n words is `similarity` or more; class_id is
    the least doc_id of a connected component of links, n_copies the documents with the same n-gram set, and
    n_links the other documents that the document links to, copies included. Words are lower-cased runs of
    letters, digits and characters beyond ASCII; a text of fewer than n words has one n-gram, of all its words.
    Texts without a word (null and empty ones) link to none, nor do rows without a doc_id, whose class is null.
    Rows that share a doc_id are one document: a repeated row counts as a further copy. An empty table gives an
    empty result, further columns are ignored.

    Equal sets meet once, as their least doc_id. A bucket (one band hash) is never expanded to pairs: its least
    document is a hub, a document joins the cells of its hubs, and a cell is verified in blocks of at most about
    chunk_rows documents and chunk_grams n-grams a side. Any two documents that share a band share a hub, so a
    link is missed only if no band agrees, with probability 1 - recall at the threshold. A cell returns counts
    and edges to local roots, a few rows for each document in it.
    """
    bands, rows = choose_bands(similarity, recall)
    own = written(sketch(df, n, bands, rows), "sketch")
    some = own.where("n_grams > 0 and doc_id is not null")
    classes = some.groupBy("set_1", "set_2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("n_grams").alias("n_grams"))
    classes = written(classes, "classes")

    entries = classes.select("rep", F.explode("bands").alias("band"))
    buckets = entries.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last").select("band", "hub")
    hubs = written(entries.join(buckets, "band").groupBy("rep").agg(F.array_sort(F.collect_set("hub")).alias("hubs")), "hubs")
    members = classes.select("rep", "set_1", "set_2", "copies", "n_grams").join(hubs, "rep")
    large = members.select("n_grams", F.explode("hubs").alias("hub")).groupBy("hub").agg(F.count("*").alias("n"), F.sum("n_grams").alias("grams"))
    large = large.select("hub", F.greatest(F.ceil(F.col("n") / chunk_rows), F.ceil(F.col("grams") / chunk_grams)).cast("int").alias("chunks")).where("chunks > 1")
    # the rows get their blocks while they are light: no n-grams yet, and a large cell's rows are dealt by a salt
    salted = members.select("rep", "set_1", "set_2", F.explode("hubs").alias("hub")).withColumn("salt", F.pmod(F.xxhash64("rep", "set_1"), F.lit(SALTS)).cast("int"))
    large = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = salted.join(large, ["hub", "salt"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("rep", "hub"), F.col("chunks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct("hub", F.least("chunk", o).alias("left"), F.greatest("chunk", o).alias("right"), "chunk"))
    places = placed.groupBy("rep", "set_1", "set_2").agg(F.flatten(F.collect_list(pairs)).alias("places"))
    members = members.select("rep", "set_1", "set_2", "copies", "hubs").join(places, ["rep", "set_1", "set_2"])

    def grams(batches):
        carried = ["rep", "set_1", "set_2", "copies", "hubs", "places"]
        for batch in batches:
            sets = ngram_sets(batch.column("text").to_pylist(), n)
            one, two = set_hashes(sets)
            # of several texts under one doc_id each goes with its own class
            own = pa.array((one == batch.column("set_1").to_numpy()) & (two == batch.column("set_2").to_numpy()))
            out = pa.RecordBatch.from_arrays([batch.column(c) for c in carried] + [pa.array([s.tobytes() for s in sets], pa.binary())], [*carried, "grams"])
            yield out.filter(own)

    places_type = "array<struct<hub:long,left:int,right:int,chunk:int>>"
    sources = texts(df).withColumnRenamed("doc_id", "rep").join(members, "rep").select("rep", "set_1", "set_2", "copies", "hubs", "places", "text")
    payload = sources.mapInArrow(grams, f"rep long, set_1 long, set_2 long, copies long, hubs array<long>, places {places_type}, grams binary").dropDuplicates(["rep", "set_1", "set_2"])
    blocks = payload.select("rep", "copies", "hubs", "grams", F.inline("places"))
    found = blocks.groupBy("hub", "left", "right").applyInPandas(lambda cell: verify_cell(cell, similarity), "kind int, rep long, value long")
    found = written(found, "links")

    degree = found.where("kind = 0").groupBy("rep").agg(F.sum("value").alias("degree"))
    roots = components(found.where("kind = 1").select(F.col("rep").alias("u"), F.col("value").alias("v")))
    labelled = classes.select("set_1", "set_2", "rep", "copies").join(degree, "rep", "left").join(roots.select(F.col("u").alias("rep"), F.col("v").alias("root")), "rep", "left")
    labelled = labelled.select("set_1", "set_2", F.coalesce("root", "rep").alias("class_id"), "copies", (F.col("copies") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"))
    linked = some.select("doc_id", "set_1", "set_2").join(labelled, ["set_1", "set_2"]).select("doc_id", "class_id", F.col("copies").alias("n_copies"), "n_links")
    alone = own.where("n_grams = 0 or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone)


def without_near_duplicates(df: DataFrame) -> DataFrame:
    """The rows of df, one document of each class: the least doc_id. Rows without a doc_id stay."""
    classes = near_duplicates(df).where("doc_id is not null").select(F.col("class_id").alias("kept_id")).distinct()
    return df.join(classes, F.col("doc_id").cast("long") == F.col("kept_id"), "left_semi").unionByName(df.where("doc_id is null"))
