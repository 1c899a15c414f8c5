"""Periodic runs of words: segments between rare words are split until none is rare, then scanned for equal words at a lag.

A word of a run with `exponent` periods occurs that often within any segment that holds the run, so words that occur
less often split their segment; what is left is split again, until nothing changes. The scan of the surviving segments
takes the lags from the text: the distance of each gram of m words to its next occurrence. A run of period q, for
m / 2 < q <= m, shows as a stretch of places whose distance is exactly q (a nearer occurrence would give the run a
smaller period), which begins where the run begins and ends m + q words before its end. Grams of 8, 16, 32 ... words,
named exactly by pairs of names of half the size, so find the runs of all periods in n log n steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from gridloom.llm.common import arrow_slices, texts, words_of

#: Splitting only saves work for the scan, which is exact on any segments; texts made to split word by word stop here.
ROUNDS = 200
_GRAM = 8


def surviving_segments(codes: np.ndarray, owner: np.ndarray, length: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers, segment of each): what recursive splitting at rare words leaves of the owners' words."""
    at, segment = np.arange(len(codes)), owner.astype(np.int64)
    settled: list[tuple[np.ndarray, np.ndarray]] = []
    width = int(codes.max()) + 1 if len(codes) else 1
    for _ in range(ROUNDS):
        if not len(at):
            break
        _, name, count = np.unique(segment * width + codes[at], return_inverse=True, return_counts=True)
        often = count[name] >= exponent
        open_ = np.zeros(int(segment.max()) + 1, bool)
        open_[segment[~often]] = True
        done = ~open_[segment]
        settled.append((at[done], segment[done]))
        on = open_[segment] & often
        at, old = at[on], segment[on]
        segment = np.cumsum(np.r_[False, (np.diff(at) != 1) | (np.diff(old) != 0)][: len(at)])
        long_enough = np.bincount(segment, minlength=1)[segment] >= length
        at, segment = at[long_enough], segment[long_enough]
    settled.append((at, segment))
    at = np.concatenate([a for a, _ in settled])
    fresh = np.concatenate([np.r_[True, (np.diff(a) != 1) | (np.diff(s) != 0)][: len(a)] for a, s in settled])
    segment = np.cumsum(fresh)
    keep = np.bincount(segment, minlength=1)[segment] >= length
    return at[keep], segment[keep]


def _pairs(name: np.ndarray, step: int) -> np.ndarray:
    """Names of twice the size: equal where the two halves are; grams beyond the end are like no other."""
    n = max(0, len(name) - step)
    out = np.arange(len(name), dtype=np.int64) + len(name)
    if n:
        out[:n] = np.unique(name[:n] * (2 * len(name)) + name[step:], return_inverse=True)[1]
    return out


def find_runs(codes: np.ndarray, owner: np.ndarray, length: int = 24, exponent: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, in word numbers of codes; owner is not decreasing and no run crosses owners."""
    if exponent < 3 or length < 3 * _GRAM:
        raise ValueError(f"runs need an exponent of 3 and a length of {3 * _GRAM} at least")
    at, segment = surviving_segments(codes, owner, length, exponent)
    found = [np.zeros((3, 0), np.int64)]
    name = np.unique(segment * (int(codes.max()) + 1) + codes[at], return_inverse=True)[1].astype(np.int64) if len(at) else at
    m, size = 1, np.bincount(segment, minlength=1)[segment] if len(at) else at
    while len(at):
        if m >= _GRAM:
            order = np.argsort(name, kind="stable")
            same = name[order[1:]] == name[order[:-1]]
            lag = np.zeros(len(name), np.int64)
            lag[order[:-1][same]] = np.diff(order)[same]
            place = np.flatnonzero((lag <= m) & (lag > (m // 2 if m > _GRAM else 0)))
            if len(place):
                first = np.flatnonzero(np.r_[True, (np.diff(place) != 1) | (np.diff(lag[place]) != 0)])
                count = np.diff(np.r_[first, len(place)])
                period = lag[place[first]]
                total = count + m + period - 1
                ok = total >= np.maximum(length, exponent * period)
                found.append(np.stack([at[place[first]][ok], total[ok], period[ok]]))
            going = size >= 3 * (m + 1)
            at, name, size = at[going], name[going], size[going]
            if len(at):
                name = np.unique(name, return_inverse=True)[1].astype(np.int64)
        name, m = _pairs(name, m), 2 * m
    start, total, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, start))
    return start[order], total[order], period[order]


def collapse(column: pa.Array, length: int, exponent: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(words of each text, its runs, the text without the repetitions) of an Arrow array of texts."""
    words, bounds = words_of(column)
    counts = np.diff(bounds)
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    start, total, period = find_runs(codes, owner, length, exponent)
    step = np.zeros(len(codes) + 1, np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, start + total, -1)
    keep = np.cumsum(step)[:-1] == 0
    kept = np.r_[0, np.cumsum(keep)][bounds]
    left = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(kept, pa.int64()), words.filter(pa.array(keep))), pa.scalar(" ", pa.large_string()))
    text = owner[start] if len(start) else start
    run = pa.StructArray.from_arrays([pa.array(start - bounds[text]), pa.array(total), pa.array(period)], ["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(counts) + 1)).astype(np.int32)), run)
    return counts, runs, left


def collapse_runs(df: DataFrame, length: int = 24, exponent: int = 3, batch_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_words, runs (start, length, period) and text for each row of df (doc_id, text).

    Words are runs of characters other than the blank and U+0009 to U+000D. A run is a stretch of words with smallest
    period q that no neighbouring word extends, of `length` words and `exponent` * q words at least; runs are
    sorted by start, then period, and may overlap. text has the words that no run holds after its first q words, one
    blank between two. A null text is the empty one and has no words; rows that repeat are treated row by row, a
    null doc_id stays null, further columns are ignored, an empty table gives an empty result. Nothing is cut: a text
    of any length is read whole, in n log n steps and memory in proportion to it.
    """

    def run(batches):
        for ids, column in arrow_slices(batches, batch_bytes):
            counts, runs, left = collapse(column, length, exponent)
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), runs, left.cast(pa.string())], ["doc_id", "n_words", "runs", "text"])

    return texts(df).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string")
