"""SentencePiece encoding and decoding of whole texts by a forward pass over the trie of distinct marked words.

A unigram model's pieces carry log probabilities: the forward value of a prefix is the best sum of scores over its
splits, with the piece that ends it, and all words that begin with the prefix share it.

A BPE model's pieces carry merge ranks. Best-sum Viterbi over those gives other ids than the model has, so there
the forward value of a prefix is the last piece of its encoding. It is found from the same pieces that end there and
the values of the shorter prefixes: exactly one of them follows the last piece of what is before it unmerged.
"""

from __future__ import annotations

import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.common import byte_batches, texts

MARK = "▁"
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_MARKED = re.compile(f"{MARK}[^{MARK}]*")  # no unigram piece goes on over a mark
_STATE: dict[str, Codec] = {}


UNIGRAM, BPE = 1, 2


def _fields(message: bytes):
    """(number, value) of the fields of a protocol buffer message; values are ints or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = message[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, message[at : at + n]
            at += n


def model_type(serialized: bytes) -> int:
    """UNIGRAM or BPE, if the model is one that Codec encodes as the library does; else an error.

    Texts must go in as they are but for the blank mark: no character map, a mark before the text, blanks kept and
    escaped. Fixed values: field numbers of the public model format.
    """
    parts = {2: [], 3: [], 1: []}
    for number, value in _fields(serialized):
        parts.setdefault(number, []).append(value)
    trainer, normal = ({k: v for p in parts[n] for k, v in _fields(p)} for n in (2, 3))
    if normal.get(2) or not normal.get(3, 1) or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24, 0):
        raise ValueError("the model changes texts before it encodes them; only the identity with a leading mark is known")
    kind = trainer.get(3, UNIGRAM)
    if kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are known")
    pieces = [dict(_fields(p)) for p in parts[1]]
    if any(p.get(3, 1) == 4 for p in pieces):
        raise ValueError("user-defined pieces are not known")
    if kind == UNIGRAM and any(MARK in p[1].decode()[1:] for p in pieces if p.get(3, 1) == 1):
        raise ValueError("the model has pieces over several words")
    return kind


class Codec:
    """Pieces of a BPE or unigram model file, with the words and piece pairs that this worker has met."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.model = model
        self.kind = model_type(model.serialized_model_proto())
        n = len(model)
        self.piece = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.id = {self.piece[i]: i for i in plain}
        self.rank = {self.piece[i]: (-model.get_score(i), i) for i in plain}
        self.score = {self.piece[i]: model.get_score(i) for i in plain}
        self.unknown, self.unknown_score = model.unk_id(), min(self.score.values(), default=0.0) - 10.0  # the library's penalty
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(model.is_byte(i) for i in self.byte):
            if self.kind == BPE:
                raise ValueError("a BPE model needs pieces for all bytes")
            self.byte = []
        self.begins = {p[:k] for p in self.id for k in range(1, len(p))}
        # a byte from 128 on stands as its escape, so that joined pieces turn to bytes in one step
        self.text = [p.replace(MARK, " ") for p in self.piece]
        if not self.byte:
            self.text[self.unknown] = " \u2047 "  # what the library gives for an unknown piece
        for b, i in enumerate(self.byte):
            self.text[i] = chr(b) if b < 128 else chr(0xDC00 + b)
        for i in range(n):
            if model.is_control(i):
                self.text[i] = ""
        self.words: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, word: str) -> list[str]:
        """Pieces after merging neighbours, best rank first and leftmost on a tie, until none is left.

        A heap holds the pairs that may merge, so a run of any length takes n log n steps.
        """
        parts: list[str | None] = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple] = []

        def push(k: int) -> None:
            if k >= 0 and after[k] < len(parts):
                pair = parts[k] + parts[after[k]]
                if (rank := self.rank.get(pair)) is not None:
                    heapq.heappush(heap, (rank[0], k, pair))

        for k in range(len(parts)):
            push(k)
        while heap:
            _, k, pair = heapq.heappop(heap)
            if parts[k] is None or after[k] >= len(parts) or parts[k] + parts[after[k]] != pair:
                continue  # one of the two has merged since
            gone = after[k]
            parts[k], parts[gone], after[k] = pair, None, after[gone]
            if after[k] < len(parts):
                before[after[k]] = k
            push(before[k])
            push(k)
        return [p for p in parts if p is not None]

    def follows(self, a: str, b: str) -> bool:
        """Whether a and b next to each other stay as they are."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return known

    def _ids(self, part: str) -> tuple[int, ...]:
        i = self.id.get(part)
        if i is None and not self.byte:
            return (self.unknown,)
        return (i,) if i is not None else tuple(self.byte[b] for b in part.encode("utf-8", "surrogatepass"))

    def best_words(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """encode_words() of a unigram model: forward scores of the prefixes; on a tie the longest last piece."""
        out: dict[str, tuple[int, ...]] = {}
        forward: list[tuple[float, int]] = [(0.0, 0)]  # of each prefix of the current path: best sum, start of its last piece
        open_at: list[list[int]] = [[]]
        before = ""
        score, begins = self.score, self.begins
        for word in sorted(words):
            common = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                common += 1
            del forward[common + 1 :], open_at[common + 1 :]
            for end in range(common + 1, len(word) + 1):
                going, best, at = [], None, 0
                for start in (*open_at[-1], end - 1):
                    part = word[start:end]
                    own = score.get(part)
                    if own is None and end - start == 1:
                        own = self.unknown_score
                    if own is not None and (best is None or forward[start][0] + own > best):
                        best, at = forward[start][0] + own, start
                    if part in begins:
                        going.append(start)
                forward.append((best, at))
                open_at.append(going)
            before = word
            parts, end = [], len(word)
            while end:
                parts.append(word[forward[end][1] : end])
                end = forward[end][1]
            out[word] = tuple(chain.from_iterable(map(self._ids, reversed(parts))))
        return out

    def encode_words(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of distinct words: sorted, they are a trie in depth-first order, and a common prefix keeps its values."""
        if self.kind == UNIGRAM:
            return self.best_words(words)
        out: dict[str, tuple[int, ...]] = {}
        last: list[str] = [""]  # the last piece of each prefix of the current path
        open_at: list[list[int]] = [[]]  # and the starts from which a piece may still go on over its end, in order
        before = ""
        id_of, begins, pairs = self.id, self.begins, self.pairs
        for word in sorted(words):
            if word.startswith(MARK * 2) or word.count(MARK) == len(word):
                out[word] = tuple(chain.from_iterable(map(self._ids, self.merged(word))))
                continue
            common = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                common += 1
            del last[common + 1 :], open_at[common + 1 :]
            for end in range(common + 1, len(word) + 1):
                going, found = [], None
                for start in (*open_at[-1], end - 1):
                    part = word[start:end]
                    if found is None and (part in id_of or end - start == 1):
                        if not start or (known if (known := pairs.get((last[start], part))) is not None else self.follows(last[start], part)):
                            found = part
                    if part in begins:
                        going.append(start)
                last.append(found)
                open_at.append(going)
            before = word
            parts, end = [], len(word)
            while end:
                parts.append(last[end])
                end -= len(last[end])
            out[word] = tuple(chain.from_iterable(map(self._ids, reversed(parts))))
        return out

    def encode(self, batch: list[str], keep_words: int = 500_000) -> list[np.ndarray]:
        pattern = _WORDS if self.kind == BPE else _MARKED
        split = [pattern.findall(MARK + t.replace(" ", MARK)) if t else [] for t in batch]
        new = self.encode_words(list({w for ws in split for w in ws if w not in self.words}))
        if len(self.words) + len(new) > keep_words:
            old = {w for ws in split for w in ws if w not in new}
            self.words = {w: self.words[w] for w in old}
        self.words.update((w, ids) for w, ids in new.items() if len(w) <= 48)
        get = {w: ids for w, ids in new.items() if len(w) > 48}
        codes = [np.fromiter(chain.from_iterable([self.words[w] if w in self.words else get[w] for w in ws]), np.int32) for ws in split]
        if not self.byte:  # a run of unknown characters is one unknown piece
            codes = [c[np.r_[True, (c[1:] != self.unknown) | (c[:-1] != self.unknown)]] if len(c) else c for c in codes]
        return codes

    def decode(self, ids) -> str:
        text = "".join(map(self.text.__getitem__, ids))
        if text[:1] == " ":
            text = text[1:]
        return text.encode("utf-8", "surrogateescape").decode("utf-8", "replace") if not text.isascii() else text


def codec(path: str) -> Codec:
    """The worker's codec of this file, kept for later tasks."""
    if path not in _STATE:
        _STATE[path] = Codec(path)
    return _STATE[path]


def encode(df: DataFrame, model_path: str, batch_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, ids, n_tokens and exact for each row of df (doc_id, text).

    ids are those that the sentencepiece library gives for this BPE or unigram model file, without begin and end
    pieces; other models, and those that change texts first, are refused. The library sums a unigram path's scores in
    single precision from the text's beginning, here they are summed from the word's in double: splits whose sums
    agree to six digits may be told apart otherwise. exact tells whether decoding them gives the text again, which holds unless the text has the mark U+2581
    itself. A null text is the empty one and has no ids. Rows that repeat are encoded row by row, a null doc_id
    stays null, an empty table gives an empty result, further columns are ignored. A word of any length costs
    time in proportion; a worker keeps the ids of at most about half a million short words.
    """

    def run(batches):
        own = codec(model_path)
        for ids, batch in byte_batches(batches, batch_bytes):
            codes = own.encode(batch)
            exact = [own.decode(c.tolist()) == t for c, t in zip(codes, batch, strict=True)]
            sizes = np.array([len(c) for c in codes], np.int64)
            values = pa.array(np.concatenate(codes) if codes else np.zeros(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists, pa.array(sizes), pa.array(exact, pa.bool_())], ["doc_id", "ids", "n_tokens", "exact"])

    return texts(df).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, exact boolean")


def decode(df: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of each row of df (doc_id, ids). Null ids give an empty text; ids that the model lacks fail."""

    def run(batches):
        own = codec(model_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return df.selectExpr("cast(doc_id as long) doc_id", "cast(ids as array<int>) ids").mapInArrow(run, "doc_id long, text string")
