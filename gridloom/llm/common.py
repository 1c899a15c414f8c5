"""Helpers shared by the text operators: input columns, shared folder, byte-level word hashing."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT = "spark.checkpoint.dir"
_OWN: ContextVar[list[str] | None] = ContextVar("tables", default=None)
_TABLES: list[str] = []


@contextmanager
def own_tables(spark: SparkSession, at_end: bool = True):
    """The list of the tables that are written within this block, for delete(); others' clean_up() leaves them alone. at_end: delete what is left of them."""
    tables: list[str] = []
    token = _OWN.set(tables)
    try:
        yield tables
    finally:
        _OWN.reset(token)
        if at_end:
            delete(spark, tables)


def delete(spark: SparkSession, tables: list[str], keep: str | None = None) -> int:
    """Delete tables of a list, and take them off it, except one to keep."""
    gone = [t for t in tables if t != keep]
    for t in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    tables[:] = [t for t in tables if t == keep]
    return len(gone)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a local session (tests) gets one of its own; on a cluster that is an error."""
    path = spark.conf.get(CHECKPOINT, None)
    if not path:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = known.get() if known.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT} must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for clean_up() to delete."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (_TABLES if (own := _OWN.get()) is None else own).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and any executor can be lost."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def leave(tables: list[str]) -> None:
    """Tables that results still read, for clean_up()."""
    _TABLES.extend(tables)


def clean_up(spark: SparkSession) -> int:
    """Delete the tables that this driver has written() outside of own_tables(); for callers, once they have stored the results that read them."""
    return delete(spark, _TABLES)


def checkpointed(df: DataFrame) -> DataFrame:
    """A small intermediate result, cut from its lineage by checkpoint() in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def texts(df: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Only the two columns that are needed and those to carry, a null text as the empty one; further columns never clash."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *carry)


def byte_batches(batches, limit: int):
    """Lists of (ids, texts) of about `limit` text bytes, from Arrow record batches of doc_id and text."""
    ids, out, size = [], [], 0
    for batch in batches:
        for i, t, n in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(1), pc.binary_length(batch.column(1)))), strict=True):
            ids.append(i)
            out.append(t)
            size += n
            if size >= limit:
                yield ids, out
                ids, out, size = [], [], 0
    if ids:
        yield ids, out


def arrow_slices(batches, limit: int):
    """(ids, texts) as Arrow arrays of about `limit` text bytes (a longer text alone), from record batches of doc_id and text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
        cuts = np.r_[0, np.flatnonzero(np.diff(size // limit)) + 1, batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words of the texts of an Arrow array, first word of each text and the end).

    Words are maximal runs of characters other than the blank and U+0009 to U+000D.
    """
    split = pc.ascii_split_whitespace(column.cast(pa.large_string()))
    parts = split.flatten()
    full = pc.greater(pc.binary_length(parts), 0)
    ends = np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))].astype(np.int64)
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    return parts.filter(full), ends[np.r_[0, np.cumsum(sizes)].astype(np.int64)]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(7))
    values = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    word = np.zeros(256, bool)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        word[a:b] = True
    return values, word


_VALUES, _WORD = _tables()
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base modulo 2**64 and of its inverse, n at least; kept for the worker's next batch."""
    global _POWERS
    if len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        with np.errstate(over="ignore"):
            _POWERS = tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)]) for b in (_BASE, inverse))
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """sums[i]: of table value times base power over the first i bytes; a span's hash follows from two of them."""
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_VALUES[data] * powers(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], the same for equal bytes wherever they stand."""
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def word_hashes(docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased word of all docs, first word of each doc and the end).

    Words are maximal runs of ASCII letters, ASCII digits and characters beyond ASCII.
    """
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in docs]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw]))).astype(np.int64)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(docs) + 1, np.int64)
    inside = np.diff(np.r_[False, _WORD[data], False].astype(np.int8))
    begin, end = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
    return span_hashes(prefix_hashes(data), begin, end), np.searchsorted(begin, starts)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes (fewer words: one hash of all of them, none for none)."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mix(out + _BASE) + words[k : k + len(out)]
    return mix(out)
