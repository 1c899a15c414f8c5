"""Permutations of numbered rows without sorting: a keyed bijection says where each number goes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def bijection(i: np.ndarray, n: int, key: int, rounds: int = 6, back: bool = False) -> np.ndarray:
    """Where a permutation of 0..n-1 sends the numbers i, or with back, which numbers it sends there; each key is another permutation.

    A Feistel network on pairs of digits (a, b) with a * b >= n, whose rounds add a hash of one digit to the other; numbers
    that come out at n or beyond go through it again until they are below, which keeps it a bijection.
    """
    i = np.asarray(i, np.int64)
    if n <= 1:
        return np.zeros_like(i)
    a = int(np.ceil(np.sqrt(n)))
    b = -(-n // a)
    seed = _mixed(np.array([key % 2**64], np.uint64) + _STEP)[0]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = (x // b).astype(np.uint64), (x % b).astype(np.uint64)
        with np.errstate(over="ignore"):
            for k in range(rounds - 1, -1, -1) if back else range(rounds):
                salt = seed + np.uint64(k + 1) * _STEP
                base, other = (np.uint64(b), left) if k % 2 else (np.uint64(a), right)
                step = _mixed(salt ^ other) % base
                step = base - step if back else step
                if k % 2:
                    right = (right + step) % base
                else:
                    left = (left + step) % base
        return (left * np.uint64(b) + right).astype(np.int64)

    out = once(i)
    while (over := out >= n).any():
        out[over] = once(out[over])
    return out


def dealt(numbered: DataFrame, number: str, value: str, n: int, draws: int, seed: int = 2026, batch: int = 250) -> DataFrame:
    """number, part and zs: for each number its values in `batch` permutations at a time, as one array by permutation.

    Each value goes straight to the number that the permutation sends it to; one shuffle brings a number's values together.
    """

    def run(batches):
        for b in batches:
            at, v = b.column(0).to_numpy(), b.column(1).to_numpy()
            for d in range(draws):
                yield pa.RecordBatch.from_arrays([pa.array(bijection(at, n, seed * 1_000_003 + d)), pa.array(np.full(len(at), d, np.int32)), pa.array(v)], ["i", "d", "v"])

    rows = numbered.select(F.col(number).cast("long"), F.col(value).cast("double")).mapInArrow(run, "i long, d int, v double")
    own = rows.groupBy("i", F.floor(F.col("d") / batch).alias("part")).agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("zs"))
    return own.select(F.col("i").alias(number), "part", F.transform("zs", lambda s: s["v"]).alias("zs"))


def sent(df: DataFrame, number: str, n: int, key: int) -> DataFrame:
    """df with the number replaced by where the permutation of a key sends it."""
    names = [c for c in df.columns if c != number]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bijection(b.column(0).to_numpy(), n, key)), *b.columns[1:]], b.schema.names)

    own = df.select(F.col(number).cast("long").alias(number), *names)
    return own.mapInArrow(run, own.schema)
