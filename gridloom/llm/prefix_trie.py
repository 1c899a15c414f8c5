"""Prefix trie of conversations: nodes by digest of the turns so far, totals of subtrees in flat arrays of slots.

Turns become digests where they are read, and no text moves again. A conversation's turns stream through one task in
order, which chains their digests; equal conversations are one path from then on, with a count. Nodes are counted by
Spark. Totals of subtrees need a node with its descendants, so the trie is cut into shards: a node is in tier 0 if `bound`
rows of paths at most run through it, in tier t if bound * fan ** t at most do, and a shard is a node with all
descendants of its own tier that no other node of the tier stands above. A shard of tier 0 has `bound` nodes at most, a
shard of a higher tier `fan` nodes at each depth at most, whatever turn begins most conversations. A shard's
totals are added up where its nodes meet, tier by tier, and go to the parent of its top as one sum of all children.

Within a task, digests get their slots by a minimal perfect hash, built level by level: of the digests that are left, those that
alone fall on a place of a bit string take it, and its rank is the slot. A slot keeps the whole digest, which tells other digests
apart. Counts are scattered to the slots, and a pass from the deepest nodes up adds each to its parent's slot.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import mix, written

_CHUNK = 4096
_STEP = np.uint64(0x9E3779B97F4A7C15)
NODE = "h1 long, h2 long, p1 long, p2 long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


class Slots:
    """A minimal perfect hash of distinct digests (two unsigned 64-bit halves), with the digests to verify it."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels, self.rank, left, before = [], [], np.arange(len(a)), 0
        while len(left):
            if len(self.levels) == 64:
                raise ValueError("digests repeat")
            place = self._place(a[left], b[left], len(self.levels), 2 * len(left))
            alone = np.bincount(place, minlength=2 * len(left)) == 1
            self.levels.append(alone)
            self.rank.append(before + np.cumsum(alone) - 1)
            before += int(alone.sum())
            left = left[~alone[place]]
        self.a, self.b = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
        slot = self._find(a, b)
        self.a[slot], self.b[slot] = a, b
        self.slot = slot

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(a ^ mix(b + np.uint64(level + 1) * _STEP)) % np.uint64(size)).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), -1, np.int64)
        for level, (alone, rank) in enumerate(zip(self.levels, self.rank, strict=True)):
            at = np.flatnonzero(out < 0)
            place = self._place(a[at], b[at], level, len(alone))
            hit = alone[place]
            out[at[hit]] = rank[place[hit]]
        return out

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for those that are not of the set."""
        out = self._find(a, b)
        known = out >= 0
        known[known] = (self.a[out[known]] == a[known]) & (self.b[out[known]] == b[known])
        return np.where(known, out, -1)


def shard_totals(table: pa.Table) -> pa.Table:
    """Nodes of one bucket of shards with their totals: children, leaves and saved bytes of the subtree.

    Rows are nodes with what the shards below have sent: kids, leaves and saved, 0 where there are none.
    """
    col = {c: table[c].to_numpy() for c in table.column_names}
    half = {c: col[c].astype(np.int64).view(np.uint64) for c in ("h1", "h2", "p1", "p2")}
    slots = Slots(half["h1"], half["h2"])
    n, slot = len(slots.slot), slots.slot
    parent, depth, convs = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    leaves, saved, kids, conv = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    parent[slot] = slots.find(half["p1"], half["p2"])
    depth[slot], convs[slot], conv[slot], kids[slot], leaves[slot] = col["depth"], col["n_convs"], col["conv_id"], col["kids"], col["leaves"]
    saved[slot] = col["saved"] + (col["n_convs"] - 1) * col["size"]
    inside = parent >= 0
    kids += np.bincount(parent[inside], minlength=n)
    leaves[kids == 0] = 1
    order = np.argsort(-depth, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        up = part[inside[part]]
        np.add.at(leaves, parent[up], leaves[up])
        np.add.at(saved, parent[up], saved[up])
    above = pa.array(np.where(inside, conv[parent], 0), pa.int64(), mask=~inside) if n else pa.array([], pa.int64())
    keep = {c: table[c] for c in ("h1", "h2", "p1", "p2", "depth", "conv_id")}
    return pa.table({**keep, "parent_conv_id": above.take(pa.array(slot)), "n_convs": table["n_convs"], "n_children": kids[slot], "n_leaves": leaves[slot], "saved_tokens": saved[slot]})


def _chained(batches):
    """Rows of conversations in order (c, part, digest, size) to paths: the digest after each turn, and whether it is the last."""
    names = ["c", "depth", "h1", "h2", "p1", "p2", "size", "is_end"]
    root = bytes(16)
    conv, depth, at, held = None, 0, root, None

    def halves(d: bytes) -> tuple[int, int]:
        return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)

    def batch(rows):
        kinds = [pa.int64()] * 7 + [pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for b in batches:
        out = []
        for c, digest, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if c != conv:
                if held:
                    out.append((*held, True))
                conv, depth, at = c, 0, root
                held = c, 0, 0, 0, 0, 0, 0
            if digest is not None:
                if depth:
                    out.append((*held, False))
                above, depth = at, depth + 1
                at = hashlib.blake2b(above + digest, digest_size=16).digest()
                held = c, depth, *halves(at), *halves(above), size
        if out:
            yield batch(out)
    if held:
        yield batch([(*held, True)])


def paths(conversations: DataFrame) -> DataFrame:
    """c, depth, h1, h2, p1, p2, size, is_end: the nodes on each conversation's path, from rows c, part, pos, digest, size.

    A row without a digest only says that the conversation is there; one without turns has its end at the root (depth 0).
    """
    own = conversations.repartition("c").sortWithinPartitions("c", "part", "pos").select("c", "digest", "size")
    return own.mapInArrow(_chained, "c long, depth long, h1 long, h2 long, p1 long, p2 long, size long, is_end boolean")


def numbered_turns(df: DataFrame) -> DataFrame:
    """c, pos (from 0), digest and size of each turn of df (conv_id, turn, role, text); rows without a conv_id are no conversation's.

    Turns are in the order of turn, null first, ties in that of their digest. Null roles and texts are the empty one.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = df.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    order = Window.partitionBy("c").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return turns.select("c", (F.row_number().over(order) - 1).cast("long").alias("pos"), "digest", "size")


def whole(turns: DataFrame) -> DataFrame:
    """Conversations as they are, for prefix_trie()."""
    return turns.select("c", F.lit(0).alias("part"), "pos", "digest", "size")


def rebuilt(turns: DataFrame, every: int = 5, span: int = 9) -> DataFrame:
    """Conversation c begins with the first h turns of conversation c - c % every, then has its own after its first h; h = crc32(c) % span."""
    head = F.pmod(F.crc32(F.col("c").cast("string")), F.lit(span))
    ids = turns.where("pos = 0").select("c", (F.col("c") - F.col("c") % every).alias("base"), head.alias("h"))
    first = turns.where((F.col("c") % every == 0) & (F.col("pos") < span - 1)).groupBy(F.col("c").alias("base")).agg(F.collect_list(F.struct("pos", "digest", "size")).alias("turns"))
    heads = ids.join(first, "base").select("c", "h", F.inline("turns")).where("pos < h").select("c", F.lit(0).alias("part"), "pos", "digest", "size")
    own = turns.where(F.col("pos") >= head).select("c", F.lit(1).alias("part"), "pos", "digest", "size")
    present = ids.select("c", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("size"))
    return heads.unionByName(own).unionByName(present)


def _end_digests(ends: DataFrame) -> DataFrame:
    """h1, h2 and the SHA-256 of the ascending, comma-joined numbers c that end there. Numbers are joined in chunks; chunks stream in order."""
    chunk = F.floor(F.col("c") / _CHUNK)
    parts = ends.groupBy("h1", "h2", chunk.alias("chunk")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("text"))

    def run(batches):
        node, sha = None, None
        for b in batches:
            out = []
            for h1, h2, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if (h1, h2) == node:
                    sha.update(b"," + text.encode())
                    continue
                if node:
                    out.append((*node, sha.hexdigest()))
                node, sha = (h1, h2), hashlib.sha256(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["h1", "h2", "ends_sha256"])
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, sha.hexdigest())], ["h1", "h2", "ends_sha256"])

    return parts.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "chunk").select("h1", "h2", "text").mapInArrow(run, "h1 long, h2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, bound: int = 4096, fan: int = 64, broadcast_nodes: int = 50_000) -> DataFrame:
    """A row for each node of the prefix trie of conversations (rows c, part, pos, digest, size): conv_id (its smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    The root has depth 0, no parent and all conversations as members; a table without conversations has no node. saved_tokens adds up,
    over the subtree, size times the members but one. ends_sha256 is of the ascending, comma-joined numbers of the
    conversations that end at the node. Repeated conversations are members each, ties and nulls are as numbered_turns() has them.

    A conversation's turns stream through one task as digests, so a very long one takes time but no memory. The numbers that end
    at one node are joined in chunks of 4,096 and digested in order, as SHA-256 asks; the nodes that more than
    `bound` rows run through are broadcast where a count shows them to be broadcast_nodes at most, and joined otherwise.
    """
    spark = conversations.sparkSession
    path = written(paths(conversations), "trie-paths")
    ends = path.where("is_end").select("c", "h1", "h2", "depth")
    same = written(ends.groupBy("h1", "h2").agg(F.min("c").alias("c"), F.count("*").alias("m"), F.max("depth").alias("len")), "trie-sequences")
    distinct = path.where("depth > 0").join(same.select("c", "m", "len"), "c")

    heavy = distinct.groupBy("h1", "h2").agg(F.sum(F.col("len") - F.col("depth") + 1).alias("rows")).where(F.col("rows") > bound)
    # the power is found by exact bounds, not by a logarithm
    tier = F.lit(1) + sum((F.col("rows").cast("double") > float(bound) * fan**k).cast("int") for k in range(1, 12))
    heavy = written(heavy.select("h1", "h2", tier.cast("int").alias("tier")), "trie-heavy")
    n_heavy, top = heavy.agg(F.count("*"), F.coalesce(F.max("tier"), F.lit(0))).first()
    placed = distinct.join(F.broadcast(heavy) if n_heavy <= broadcast_nodes else heavy, ["h1", "h2"], "left").withColumn("tier", F.coalesce("tier", F.lit(0)))
    placed = placed.withColumn("shard", F.min(F.struct("depth", "h1", "h2")).over(Window.partitionBy("c", "tier")))
    least = [F.min(c).alias(c) for c in ("p1", "p2", "depth", "size", "tier", "shard")]
    nodes = written(placed.groupBy("h1", "h2").agg(*least, F.sum("m").alias("n_convs"), F.min("c").alias("conv_id")), "trie-nodes")

    buckets = {r["tier"]: max(1, r["n"] // bound) for r in nodes.groupBy("tier").agg(F.count("*").alias("n")).collect()}
    none = spark.createDataFrame([], "h1 long, h2 long, kids long, leaves long, saved long")
    sent, done = none, None
    for t in range(top + 1):
        if t not in buckets:
            continue
        rows = nodes.where(F.col("tier") == t).join(sent, ["h1", "h2"], "left").fillna(0, ["kids", "leaves", "saved"])
        bucket = F.pmod(F.xxhash64("shard"), F.lit(buckets[t]))
        totals = rows.withColumn("bucket", bucket).drop("shard", "tier").groupBy("bucket").applyInArrow(shard_totals, NODE)
        totals = written(totals, f"trie-tier-{t}")
        tops = totals.where("parent_conv_id is null and depth > 1")
        sent = sent.unionByName(tops.groupBy(F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")))
        sent = sent.groupBy("h1", "h2").agg(*(F.sum(c).alias(c) for c in ("kids", "leaves", "saved")))
        done = totals if done is None else done.unionByName(totals)
    done = spark.createDataFrame([], NODE) if done is None else done

    zero = F.lit(0).cast("long")
    below = done.where("depth = 1").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.coalesce(F.sum("saved_tokens"), zero).alias("saved_tokens"))
    root = same.agg(F.min("c").alias("conv_id"), F.sum("m").alias("n_convs")).where("n_convs > 0").crossJoin(F.broadcast(below))
    root = root.select(*(zero.alias(c) for c in ("h1", "h2", "depth")), "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"), "saved_tokens")

    first = same.agg(F.min("c").alias("root_conv"))
    parents = nodes.where("tier > 0").select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("above"))
    lost = done.where("parent_conv_id is null").drop("parent_conv_id").join(F.broadcast(parents) if n_heavy <= broadcast_nodes else parents, ["p1", "p2"], "left").crossJoin(F.broadcast(first))
    lost = lost.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.col("root_conv")).otherwise(F.col("above")))
    columns = ["h1", "h2", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    every = done.where("parent_conv_id is not null").select(columns).unionByName(lost.select(columns)).unionByName(root.select(columns))
    out = every.join(_end_digests(ends), ["h1", "h2"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
