"""Suffix dedup: bytes covered by a fixed-length string that also starts earlier, by blockwise suffix sorting.

Texts are dealt to blocks by doc_id. Each block names the short strings at its difference-cover positions;
one bucket of names at a time is sorted to find those that occur twice. A suffix can tie with another over
the whole length only if such a name stands at one of its cover positions, so only those suffixes are kept.
They are dealt to buckets in turn, and one bucket of suffixes at a time is sorted to find the ones that have
an equal, earlier suffix.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import mix, prefix_hashes, span_hashes, texts

#: A perfect difference set: any two residues modulo PERIOD have a common shift into it.
PERIOD = 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
_LAST = 2**63 - 1
HOT = 1000
_PACKED = "bucket int, block long, kind int, packed binary, orders binary, runs binary"


class Block:
    """The bytes of a block's documents in the order of doc_id, with the places of suffixes and cover samples."""

    def __init__(self, packs: pd.DataFrame, length: int):
        found: dict[tuple[int, int], list] = {}
        for cells, size, body in zip(packs["cells"], packs["size"], packs["body"], strict=True):
            body = pa.decompress(body, decompressed_size=size, codec="zstd", asbytes=True) if size else b""
            at = 0
            for order, row_key, n, null, count in np.frombuffer(cells, np.int64).reshape(-1, 5).tolist():
                # a row that repeats is held once, with the number of its repeats
                if (order, row_key) in found:
                    found[order, row_key][2] += count
                else:
                    found[order, row_key] = [body[at : at + n], null, count]
                at += n
        rows = sorted(found.items(), key=lambda r: r[0])
        self.length = length
        self.doc_id = [None if r[1] else k[0] for k, r in rows]
        self.count = [r[2] for _, r in rows]
        self.ord, self.row_key = (np.array([k[i] for k, _ in rows], np.int64) for i in (0, 1))
        self.size = np.array([len(r[0]) for _, r in rows], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join([r[0] for _, r in rows]), np.uint8)
        self.sums = prefix_hashes(self.data)

    def samples(self, skip: np.ndarray) -> np.ndarray:
        """Cover positions, relative to each document's start, at which a sample string fits; none in documents to skip."""
        depth = self.length - PERIOD + 1
        n = np.where(skip, 0, np.maximum(self.size - depth + 1, 0))
        full = np.arange(int(n.max(initial=0)) // PERIOD + 1)[:, None] * PERIOD + np.array(COVER)
        full = full.ravel()
        return np.concatenate([full[: np.searchsorted(full, m)] + s for s, m in zip(self.start, n, strict=True)] or [np.zeros(0, np.int64)])

    def names(self, buckets: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sample positions, each one's index of a distinct name, names' buckets, names of 32 bits), names in order."""
        at = self.samples(skip)
        h = span_hashes(self.sums, at, at + (self.length - PERIOD + 1))
        key = ((h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        distinct, name = np.unique(key, return_inverse=True)
        return at, name, (distinct >> np.uint64(32)).astype(np.int64), distinct.astype(np.uint32)

    def suffixes(self, at: np.ndarray) -> np.ndarray:
        """Positions of whole-length suffixes that have one of the sample positions `at` as a cover position."""
        mark = np.zeros(len(self.data) + 1, np.int32)
        doc = np.searchsorted(self.start, at, side="right") - 1
        np.add.at(mark, np.maximum(at - PERIOD + 1, self.start[doc]), 1)
        np.add.at(mark, at + 1, -1)
        possible = np.cumsum(mark)[:-1] > 0
        for s, n in zip(self.start, self.size, strict=True):
            possible[max(s, s + n - self.length + 1) : s + n] = False
        return np.flatnonzero(possible)

    def keys(self, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(64-bit key of each suffix, its bucket by an independent hash, whether it is the first here of its key)."""
        key = span_hashes(self.sums, at, at + self.length)
        half = self.length // 2
        bucket = mix(span_hashes(self.sums, at, at + half) + np.uint64(1)) ^ mix(span_hashes(self.sums, at + half, at + self.length))
        bucket = (bucket % np.uint64(buckets)).astype(np.int64)
        first = np.zeros(len(at), bool)
        first[np.unique(key, return_index=True)[1]] = True
        return key, bucket, first


def pack_documents(batches, pack_bytes: int):
    """Rows of block, doc_id, ord, row_key and text as one compressed row for each block and pack_bytes of text; repeated rows once."""

    def packed(groups: dict) -> pa.RecordBatch:
        bodies = [b"".join([r[1] for r in rows.values()]) for rows in groups.values()]
        cells = [np.array([(*k, len(r[1]), r[0], r[2]) for k, r in rows.items()], np.int64).tobytes() for rows in groups.values()]
        body = [codec.compress(b, asbytes=True) if b else b"" for b in bodies]
        return pa.RecordBatch.from_arrays([pa.array(list(groups), pa.int64()), pa.array(cells, pa.binary()), pa.array([len(b) for b in bodies], pa.int64()), pa.array(body, pa.binary())], ["block", "cells", "size", "body"])

    codec = pa.Codec("zstd", compression_level=9)
    groups, total = {}, 0
    for batch in batches:
        for block, doc_id, order, row_key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows = groups.setdefault(block, {})
            if (order, row_key) in rows:
                rows[order, row_key][2] += 1
                continue
            raw = text.encode("utf-8", "surrogatepass")
            rows[order, row_key] = [doc_id is None, raw, 1]
            total += len(raw)
            if total >= pack_bytes:
                yield packed(groups)
                groups, total = {}, 0
    if groups:
        yield packed(groups)


def _by_bucket(bucket: np.ndarray, buckets: int):
    """(bucket, indexes in their order) of the buckets that have any."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), order[edges[b] : edges[b + 1]]


def _planes(names: np.ndarray) -> np.ndarray:
    """Sorted 32-bit names by byte: the high bytes together hardly take room in a compressed shuffle."""
    return names.astype(">u4").view(np.uint8).reshape(-1, 4).T.copy()


def _from_planes(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint8).reshape(4, -1).T.copy().view(">u4").ravel().astype(np.uint32)


def _row(bucket: int, block: int, kind: int, packed: np.ndarray, orders=b"", runs=b"") -> tuple:
    return bucket, block, kind, packed.tobytes(), orders, runs


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["bucket", "block", "kind", "packed", "orders", "runs"])


def _copies(block: Block, messages: pd.DataFrame) -> np.ndarray:
    """Which documents are later exact copies."""
    keys = [np.frombuffer(p, np.int64) for p in messages.loc[messages["kind"] == 3, "packed"]]
    return np.isin(block.row_key, np.concatenate(keys)) if keys else np.zeros(len(block.row_key), bool)


def emit_names(docs: pd.DataFrame, messages: pd.DataFrame, length: int, buckets: int) -> pd.DataFrame:
    """The block's distinct sample names, 32 bits each, packed by bucket; later exact copies have none."""
    if docs.empty:
        return _frame([])
    block = Block(docs, length)
    _, _, bucket, names = block.names(buckets, _copies(block, messages))
    return _frame([_row(b, int(docs["block"].iloc[0]), 0, _planes(names[i])) for b, i in _by_bucket(bucket, buckets)])


def repeated_names(rows: pd.DataFrame) -> pd.DataFrame:
    """For each block of one bucket, bits: which of its names another block has too."""
    parts = [_from_planes(p) for p in rows["packed"]]
    everything = np.sort(np.concatenate(parts))
    twice = np.unique(everything[1:][everything[1:] == everything[:-1]])
    out = []
    for block, names in zip(rows["block"], parts, strict=True):
        bits = np.isin(names, twice, assume_unique=True)
        if bits.any():
            out.append(_row(int(rows["bucket"].iloc[0]), int(block), 1, np.packbits(bits)))
    return _frame(out)


def _candidates(block: Block, messages: pd.DataFrame, name_buckets: int) -> np.ndarray:
    at, name, bucket, names = block.names(name_buckets, _copies(block, messages))
    twice = np.zeros(len(names), bool)
    edges = np.searchsorted(bucket, np.arange(name_buckets + 1))
    for b, packed in messages.loc[messages["kind"] == 1, ["bucket", "packed"]].itertuples(index=False):
        n = edges[b + 1] - edges[b]
        twice[edges[b] : edges[b + 1]] = np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)
    twice |= np.bincount(name, minlength=len(names)) > 1
    return block.suffixes(at[twice[name]])


def emit_suffixes(docs: pd.DataFrame, messages: pd.DataFrame, length: int, name_buckets: int, buckets: int) -> pd.DataFrame:
    """Keys of the block's suffixes that may tie, the first of each key only, packed by bucket with their doc_ids' runs."""
    if docs.empty:
        return _frame([])
    block = Block(docs, length)
    at = _candidates(block, messages, name_buckets)
    key, bucket, first = block.keys(at, buckets)
    at, key, bucket = at[first], key[first], bucket[first]
    doc = np.searchsorted(block.start + block.size, at, side="right")
    out = []
    for b, i in _by_bucket(bucket, buckets):
        change = np.flatnonzero(np.r_[True, doc[i][1:] != doc[i][:-1]])
        runs = np.diff(np.r_[change, len(i)]).astype(np.int32)
        of = doc[i][change]
        out.append(_row(b, int(docs["block"].iloc[0]), 0, key[i], np.r_[block.ord[of], block.row_key[of]].tobytes(), runs.tobytes()))
    return _frame(out)


def later_suffixes(rows: pd.DataFrame) -> pd.DataFrame:
    """For each block of one bucket, bits: which of its suffixes have an equal one in an earlier document."""
    parts = [np.frombuffer(p, np.uint64) for p in rows["packed"]]
    order = [np.repeat(np.frombuffer(o, np.int64).reshape(2, -1), np.frombuffer(r, np.int32), axis=1) for o, r in zip(rows["orders"], rows["runs"], strict=True)]
    keys, orders = np.concatenate(parts), np.concatenate(order, axis=1)
    rank = np.lexsort((orders[1], orders[0], keys))
    sorted_keys = keys[rank]
    later = np.zeros(len(keys), bool)
    later[rank[1:][sorted_keys[1:] == sorted_keys[:-1]]] = True
    edges = np.cumsum([0, *map(len, parts)])
    out = []
    for block, a, b in zip(rows["block"], edges[:-1], edges[1:], strict=True):
        if later[a:b].any():
            out.append(_row(int(rows["bucket"].iloc[0]), int(block), 2, np.packbits(later[a:b])))
    return _frame(out)


def cut_block(docs: pd.DataFrame, messages: pd.DataFrame, length: int, name_buckets: int, buckets: int) -> pd.DataFrame:
    """What is left of each document of the block."""
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    if docs.empty:
        return pd.DataFrame([], columns=columns)
    block = Block(docs, length)
    at = _candidates(block, messages, name_buckets)
    key, bucket, first = block.keys(at, buckets)
    later = ~first
    chosen = np.flatnonzero(first)
    answers = {int(b): p for b, p in messages.loc[messages["kind"] == 2, ["bucket", "packed"]].itertuples(index=False)}
    for b, i in _by_bucket(bucket[chosen], buckets):
        if b in answers:
            later[chosen[i]] = np.unpackbits(np.frombuffer(answers[b], np.uint8), count=len(i)).astype(bool)
    copies = _copies(block, messages)
    mark = np.zeros(len(block.data) + 1, np.int32)
    np.add.at(mark, at[later], 1)
    np.add.at(mark, at[later] + length, -1)
    removed = np.cumsum(mark)[:-1] > 0
    out = []
    for doc_id, s, n, copy, count in zip(block.doc_id, block.start, block.size, copies, block.count, strict=True):
        cut = removed[s : s + n]
        if copy and n >= length:
            cut = np.ones(n, bool)
        kept = block.data[s : s + n][~cut].tobytes()
        spans = int(np.count_nonzero(np.diff(np.r_[False, cut].astype(np.int8)) == 1))
        out.append((doc_id, n, int(cut.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        if count > 1:  # the repeats start later than all of the first row's strings
            again = (doc_id, n, n, 1, hashlib.sha256(b"").hexdigest(), b"") if n >= length else out[-1]
            out += [again] * (count - 1)
    out = pd.DataFrame(out, columns=columns)
    out["doc_id"] = pd.array(out["doc_id"], "Int64")
    return out


def dedup_suffixes(df: DataFrame, length: int = 100, block_bytes: int = 4_000_000, bucket_entries: int = 2_000_000, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) for each row of df (doc_id, text).

    A byte goes if a string of `length` bytes covers it that also starts earlier: in a smaller doc_id, or earlier in
    the same document. Strings are judged on the input. A null text is the empty one, shorter texts stay whole,
    null doc_ids come last. Rows that share a doc_id, or have none, follow each other in the order of a hash of their
    texts, so they are dealt to the blocks like others; the second of two equal rows counts as later. An empty table
    gives an empty result; further columns are ignored. keep_bytes=False leaves out `kept`.

    Memory is bounded by a block (about block_bytes of text) and a bucket (about bucket_entries names or suffixes;
    a frequent string enters once from each block). A later exact copy of a text is settled by its hash, so its
    suffixes are not sorted again. Texts are shuffled once; the exchange is reused by all three passes.
    Suffixes compare by 64 bits of hash within a bucket that an independent hash has chosen.
    """
    if length <= PERIOD + 8:
        raise ValueError(f"length must be over {PERIOD + 8}")
    base = texts(df).withColumns({"ord": F.coalesce("doc_id", F.lit(_LAST)), "row_key": F.xxhash64("doc_id", "text")})
    total, n_rows = base.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    total = total or 0
    blocks = max(1, -(-total // block_bytes))
    name_buckets = max(1, -(-total * len(COVER) // PERIOD // bucket_entries))
    buckets = max(1, -(-total // 3 // bucket_entries))
    dealt = base.select(F.pmod(F.xxhash64("row_key"), F.lit(blocks)).alias("block"), "doc_id", "ord", "row_key", "text")
    dealt = dealt.mapInArrow(lambda batches: pack_documents(batches, 2 * block_bytes), "block long, cells binary, size long, body binary")

    same = base.select("ord", "row_key", F.octet_length("text").alias("n"), F.md5("text").alias("text_md5")).where(F.col("n") >= length)
    firsts = same.groupBy("text_md5", "n").agg(F.min("ord").alias("least"), F.max("ord").alias("most"), F.count("*").alias("rows")).where("least < most")
    # groups with over a HOT-th of the rows are fewer than HOT, so they are broadcast and their rows stay where they are
    often = F.broadcast(firsts.where(F.col("rows") * HOT > n_rows).select("text_md5", "n", "least"))
    rest = same.join(often, ["text_md5", "n"], "left_anti").join(firsts.where(F.col("rows") * HOT <= n_rows).select("text_md5", "n", "least"), ["text_md5", "n"])
    copies = same.join(often, ["text_md5", "n"]).unionByName(rest).where("ord > least").select(F.pmod(F.xxhash64("row_key"), F.lit(blocks)).alias("block"), "row_key")

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        return _frame([_row(0, int(rows["block"].iloc[0]), 3, np.unique(rows["row_key"].to_numpy(np.int64)))])

    known = copies.groupBy("block").applyInPandas(pack, _PACKED)
    names = dealt.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(lambda d, m: emit_names(d, m, length, name_buckets), _PACKED)
    answers = names.groupBy("bucket").applyInPandas(repeated_names, _PACKED).unionByName(known)
    suffixes = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(lambda d, m: emit_suffixes(d, m, length, name_buckets, buckets), _PACKED)
    later = suffixes.groupBy("bucket").applyInPandas(later_suffixes, _PACKED)
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    final = dealt.groupBy("block").cogroup(answers.unionByName(later).groupBy("block"))
    if keep_bytes:
        return final.applyInPandas(lambda d, m: cut_block(d, m, length, name_buckets, buckets), result + ", kept binary")
    return final.applyInPandas(lambda d, m: cut_block(d, m, length, name_buckets, buckets).drop(columns="kept"), result)
