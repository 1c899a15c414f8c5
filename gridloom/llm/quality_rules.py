"""Quality rules: base counts, and a linear-chain conditional random field that labels lines as content or boilerplate."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import byte_batches, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_UPPER, _DIGIT, _SHOUT = re.compile(r"[A-Z]"), re.compile(r"[0-9]"), re.compile(r"!!|\?\?|\.\.\.")
_LINK = re.compile(r"https?://|www\.|@\w+\.")

#: Bits of a line's features; each line has the bias and one bit of every group.
_GROUPS = (("symbols", 4), ("upper", 3), ("digits", 3), ("words", 4), ("length", 3), ("end", 2), ("shout", 3), ("repeat", 2), ("link", 2), ("distinct", 3), ("first", 2))
_AT = np.cumsum([1, *(n for _, n in _GROUPS)])
N_FEATURES = int(_AT[-1])
BOILERPLATE, CONTENT = 0, 1


def _bin(x: float, edges: tuple) -> int:
    return sum(x >= e for e in edges)


def line_features(line: str, n_words: int, n_distinct: int, repeated: bool, first: bool) -> list[int]:
    """Indexes of the features that the line has."""
    n = len(line) or 1
    bins = (
        _bin(len(_SYMBOL.findall(line)) / n, (0.005, 0.02, 0.06)),
        _bin(len(_UPPER.findall(line)) / n, (0.15, 0.4)),
        _bin(len(_DIGIT.findall(line)) / n, (0.05, 0.25)),
        _bin(n_words, (3, 8, 20)),
        _bin(n / max(n_words, 1), (4, 12)),
        int(line.rstrip()[-1:] in ".!?:;\"'”»)"),
        _bin(len(_SHOUT.findall(line)) / max(n_words, 1), (0.05, 0.3)),
        int(repeated),
        int(_LINK.search(line) is not None),
        _bin(n_distinct / max(n_words, 1), (0.4, 0.75)),
        int(first),
    )
    return [0, *(int(a) + b for a, b in zip(_AT[:-1], bins, strict=True))]


def repeated_words(words: list[str], size: int = 8) -> int:
    """Words in windows of `size` words that the text has twice or more, the first ones included.

    Windows of 2, 4 and 8 words get ranks from pairs of ranks, so equal ranks mean equal words.
    """
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[str, int] = {}
    rank = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    if len(ids) == len(words):
        return 0
    step = 1
    while step < size:
        pair = rank[:-step] * (len(rank) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        step *= 2
    twice = np.bincount(rank)[rank] > 1
    if not twice.any():
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(twice), 1)
    np.add.at(cover, np.flatnonzero(twice) + size, -1)
    return int(np.count_nonzero(np.cumsum(cover)[:-1]))


def describe(text: str) -> tuple[dict, list[list[int]], list[int]]:
    """The base counts, and the features and word counts of the lines that have a word."""
    words = WORD.findall(text)
    seen: set[str] = set()
    features, sizes, n_dup = [], [], 0
    for line in text.split("\n"):
        own = WORD.findall(line)
        if own:
            dup = line in seen
            n_dup += dup
            features.append(line_features(line, len(own), len(set(own)), dup, not seen))
            sizes.append(len(own))
            seen.add(line)
    n_repeat = repeated_words(words)
    base = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(_SYMBOL.findall(text)), "n_dup_lines": n_dup, "n_repeat_words": n_repeat}
    base["base_failed"] = len(words) < 20 or 100 * n_repeat > 30 * len(words)
    return base, features, sizes


# --- the random field ---------------------------------------------------------------------------


def fit_crf(sequences: list[tuple[list[list[int]], list[int]]], rounds: int = 200, rate: float = 0.08, penalty: float = 0.02) -> np.ndarray:
    """Weights (features and two transition rows, by label) that maximise the penalised likelihood, by Adam.

    sequences: features and labels of each document's lines. All sequences run side by side through the
    forward-backward recursion. Without sequences all weights are 0, which labels every line as content.
    """
    weights = np.zeros((N_FEATURES + 2, 2))
    sequences = [s for s in sequences if len(s[0])]
    if not sequences:
        return weights
    sequences.sort(key=lambda s: -len(s[0]))
    T, N = len(sequences[0][0]), len(sequences)
    length = np.array([len(s[0]) for s in sequences])
    alive = np.array([np.searchsorted(-length, -t, side="left") for t in range(T + 1)])  # sequences longer than t
    where = np.concatenate([np.arange(alive[t]) * T + t for t in range(T)])
    x = np.zeros((N * T, len(_GROUPS) + 1), np.int64)
    y = np.zeros(N * T, np.int64)
    for k, (f, labels) in enumerate(sequences):
        x[k * T : k * T + len(f)] = f
        y[k * T : k * T + len(f)] = labels
    xs, ys = x[where], y[where]
    empirical = np.zeros_like(weights)
    for c in range(xs.shape[1]):
        np.add.at(empirical, (xs[:, c], ys), 1)
    both = [(k * T + t) for t in range(1, T) for k in range(alive[t])]
    np.add.at(empirical, (N_FEATURES + y[np.array(both, np.int64) - 1], y[np.array(both, np.int64)]), 1)
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        score = np.zeros((N * T, 2))
        score[where] = weights[xs].sum(1)
        score = score.reshape(N, T, 2)
        move = weights[N_FEATURES:]
        ahead, back = np.zeros((N, T, 2)), np.zeros((N, T, 2))
        ahead[:, 0] = score[:, 0]
        for t in range(1, T):
            n = alive[t]
            ahead[:n, t] = score[:n, t] + np.logaddexp(ahead[:n, t - 1, :1] + move[0], ahead[:n, t - 1, 1:] + move[1])
        last = np.arange(N)
        total = np.logaddexp(ahead[last, length - 1, 0], ahead[last, length - 1, 1])
        for t in range(T - 2, -1, -1):
            n = alive[t + 1]
            nxt = score[:n, t + 1] + back[:n, t + 1]
            back[:n, t] = np.logaddexp(nxt[:, :1] + move[:, 0], nxt[:, 1:] + move[:, 1])
        p = np.exp(ahead + back - total[:, None, None]).reshape(-1, 2)[where]
        expected = np.zeros_like(weights)
        for c in range(xs.shape[1]):
            for label in (0, 1):
                expected[:N_FEATURES, label] += np.bincount(xs[:, c], p[:, label], N_FEATURES)
        for t in range(1, T):
            n = alive[t]
            pair = ahead[:n, t - 1, :, None] + move + (score[:n, t] + back[:n, t])[:, None, :] - total[:n, None, None]
            expected[N_FEATURES:] += np.exp(pair).sum(0)
        grad = (empirical - expected) / len(where) - penalty * weights / np.sqrt(len(where))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        weights = weights + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return weights


def viterbi(weights: np.ndarray, features: list[list[int]]) -> list[int]:
    """The most likely labels of a document's lines; ties go to content."""
    if not features:
        return []
    score = weights[np.array(features)].sum(1).tolist()
    (a00, a01), (a10, a11) = weights[N_FEATURES:].tolist()
    s0, s1 = score[0]
    back = []
    for e0, e1 in score[1:]:
        b0, b1 = int(s1 + a10 >= s0 + a00), int(s1 + a11 >= s0 + a01)
        back.append((b0, b1))
        s0, s1 = (s1 + a10 if b0 else s0 + a00) + e0, (s1 + a11 if b1 else s0 + a01) + e1
    label = int(s1 >= s0)
    out = [label]
    for pair in reversed(back):
        label = pair[label]
        out.append(label)
    return out[::-1]


def content_share(weights: np.ndarray, features: list[list[int]], sizes: list[int]) -> float:
    """Share of the words that are in lines labelled content; 0 without words."""
    total = sum(sizes)
    return sum(n for n, label in zip(sizes, viterbi(weights, features), strict=True) if label == CONTENT) / total if total else 0.0


def train(documents: DataFrame, labels: DataFrame, max_documents: int = 1500, chunk: int = 40, max_chunks: int = 5000) -> np.ndarray:
    """A field fitted on a bounded sample of labelled documents: the max_documents first by a hash of doc_id.

    Line labels are those of the documents: one of quality 1 lends its lines as content, one of quality 0 as
    boilerplate, except lines whose features occur at least as often under quality 1. Documents are cut to sequences
    of `chunk` lines; the fit (and nothing else) takes max_chunks of them at most, the first by a hash of document and
    place, wherever they stand in their text. They come to the driver as packed numbers: 10 MB at these bounds.
    """
    sample = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents)
    rows = texts(documents).join(F.broadcast(sample), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(max_documents)

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text, q in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = np.array(describe(text)[1], np.int32)
                for at in range(0, len(found), chunk):
                    out.append((zlib.crc32(f"{doc_id}:{at}".encode()), q, found[at : at + chunk].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["h", "quality", "lines"])

    cut = rows.select("doc_id", "text", F.col("quality").cast("int")).mapInArrow(run, "h long, quality int, lines binary")
    fitted = [(r["quality"], np.frombuffer(r["lines"], np.int32).reshape(-1, len(_GROUPS) + 1)) for r in cut.orderBy("h", "quality", "lines").limit(max_chunks).collect()]
    if not fitted:
        return fit_crf([])
    # a clean line of a poor document looks like the lines of good ones: the commoner side decides
    side = np.repeat([bool(q) for q, _ in fitted], [len(f) for _, f in fitted])
    _, which = np.unique(np.concatenate([f for _, f in fitted]), axis=0, return_inverse=True)
    good, bad = (np.bincount(which.ravel(), weights=w, minlength=int(which.max()) + 1) for w in (side, ~side))
    label = np.where(side | (good >= bad)[which.ravel()], CONTENT, BOILERPLATE)
    edges = np.cumsum([0, *(len(f) for _, f in fitted)])
    sequences = [(f, label[a:b]) for (_, f), a, b in zip(fitted, edges[:-1], edges[1:], strict=True)]
    return fit_crf(sequences)


def apply_rules(df: DataFrame, weights: np.ndarray, min_share: float = 0.5, batch_bytes: int = 1 << 20) -> DataFrame:
    """Base counts, content share and verdict for each row of df (doc_id, text).

    kept: the base rules hold and at least min_share of the words are in content lines. A null text is the
    empty one, has no words and fails. Repeated rows are judged row by row, a null doc_id stays null, an
    empty table gives an empty result, further columns are ignored. Each text is read whole, once.
    """

    def run(batches):
        for ids, batch in byte_batches(batches, batch_bytes):
            found = [describe(t) for t in batch]
            share = [content_share(weights, f, s) for _, f, s in found]
            cols = [pa.array(ids, pa.int64())]
            cols += [pa.array([b[k] for b, _, _ in found], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            failed = [b["base_failed"] for b, _, _ in found]
            cols += [pa.array(failed, pa.bool_()), pa.array(share, pa.float64()), pa.array([not f and s >= min_share for f, s in zip(failed, share, strict=True)], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"])

    return texts(df).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean")


def keep_good(df: DataFrame, weights: np.ndarray, min_share: float = 0.5) -> DataFrame:
    """The rows of df whose text apply_rules() would keep, with all their columns, in one pass over them."""
    at = df.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = []
            for t in batch.column(at).to_pylist():
                base, features, sizes = describe(t or "")
                keep.append(not base["base_failed"] and content_share(weights, features, sizes) >= min_share)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)
