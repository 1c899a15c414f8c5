"""Token ids of whole corpora in binary files, with Elias-Fano encoded document boundaries, and their reader.

A file holds documents in ascending doc_id order, one after another, little-endian:

* 8 bytes of magic, then eight unsigned 64-bit numbers: documents, those of them without a doc_id (the last ones), ids,
  bytes of an id (2 or 4), the least doc_id plus 2**63, and the bytes of the three parts that follow
* doc_ids less the least one, and the ids before each document and after the last, as two Elias-Fano sequences
* the ids of all documents, concatenated

An Elias-Fano sequence of n numbers up to u keeps the low bits of each (about log2(u / n) of them) packed, and the
high bits as a bit string in which the i-th set bit is at i plus the high part: about 2 + log2(u / n) bits a number.
The place of every 256th set bit is kept too, so that one number is found by reading a few words of the bit string.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import arrow_slices, shared_folder, texts, words_of, written

MAGIC = b"GLTOKEF1"
_LAST = 2**63 - 1
_SAMPLE = 256
_STATE: dict[tuple, Words] = {}


class EliasFano(NamedTuple):
    """Numbers that never fall, in about 2 + log2(u / n) bits each."""

    n: int
    low_bits: int
    low: np.ndarray  # packed bits as bytes
    high: np.ndarray  # bit string as bytes
    sample: np.ndarray  # places of set bits 0, 256, 512, ...

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        place = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(place[-1]) + 1 if n else 0, np.uint8)
        bits[place] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), place[::_SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high)], "<u8")
        return b"".join((head.tobytes(), self.low.tobytes(), self.high.tobytes(), self.sample.astype("<u4").tobytes()))

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, a, b = (int(x) for x in np.frombuffer(data, "<u8", 4))
        return cls(n, low_bits, np.frombuffer(data, np.uint8, a, 32), np.frombuffer(data, np.uint8, b, 32 + a), np.frombuffer(data, "<u4", -1, 32 + a + b))

    def _low(self, i: int) -> int:
        at = i * self.low_bits
        part = int.from_bytes(self.low[at >> 3 : (at + self.low_bits + 7) >> 3].tobytes(), "little")
        return (part >> (at & 7)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th number, from the nearest sampled place on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.sample[i // _SAMPLE]), i % _SAMPLE
        byte = at >> 3
        left += int(np.unpackbits(self.high[byte : byte + 1], count=at & 7, bitorder="little").sum()) if at & 7 else 0
        while True:
            bits = np.flatnonzero(np.unpackbits(self.high[byte : byte + 64], bitorder="little"))
            if left < len(bits):
                return ((byte * 8 + int(bits[left]) - i) << self.low_bits) | self._low(i)
            left, byte = left - len(bits), byte + 64

    def values(self) -> np.ndarray:
        """All numbers, unsigned."""
        place = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (place - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
            for k in range(self.low_bits):
                out |= bits[:, k].astype(np.uint64) << np.uint64(k)
        return out


def pack(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """A file's bytes; doc_ids ascend, with None last."""
    known = np.array([i for i in doc_ids if i is not None], np.int64)
    least = int(known[0]) + 2**63 if len(known) else 2**63
    keys = EliasFano.of(known.astype(np.uint64) + np.uint64(2**63) - np.uint64(least)).to_bytes()
    bounds = EliasFano.of(np.r_[0, np.cumsum(sizes, dtype=np.int64)]).to_bytes()
    body = ids.tobytes()
    head = np.array([len(doc_ids), len(doc_ids) - len(known), len(ids), ids.dtype.itemsize, least, len(keys), len(bounds), len(body)], "<u8")
    return b"".join((MAGIC, head.tobytes(), keys, bounds, body))


class TokenFile:
    """A file's documents: their doc_ids and boundaries in memory, their ids read when asked for."""

    def __init__(self, source):
        self.source = source
        if source.read_at(8, 0) != MAGIC:
            raise ValueError("not a token file")
        self.n, self.n_null, self.n_ids, self.width, least, keys, bounds, _ = (int(x) for x in np.frombuffer(source.read_at(64, 8), "<u8"))
        self._keys, self._least = EliasFano.from_bytes(source.read_at(keys, 72)), least
        self.bounds = EliasFano.from_bytes(source.read_at(bounds, 72 + keys))
        self._body = 72 + keys + bounds

    def doc_ids(self) -> list[int | None]:
        known = (self._keys.values() + np.uint64(self._least) - np.uint64(2**63)).astype(np.int64)
        return [*known.tolist(), *[None] * self.n_null]

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids from place first to before place last of the file."""
        return np.frombuffer(self.source.read_at((last - first) * self.width, self._body + first * self.width), f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        """The ids of the file's i-th document, by two selects."""
        return self.ids(self.bounds.select(i), self.bounds.select(i + 1))


def _opened(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder in the shared folder, as Arrow has it (file, hdfs, s3, gs), and the path there."""
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", folder))


def splits_at_blanks(config: dict) -> bool:
    """Whether a tokenizer's ids of a text are those of its words between ASCII white space, one after another.

    So it is where white space is dropped by a pre-tokenizer that only keeps matches without any, words are not joined by
    the normalizer, and added tokens have no white space and don't reach over it. Fixed values: names of the format.
    """
    normal, before = config.get("normalizer"), config.get("pre_tokenizer")
    steps = (normal.get("normalizers") or [normal]) if normal else []
    if any(s["type"] not in ("NFC", "NFD", "Lowercase") and not (s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " ") for s in steps):
        return False
    parts = (before.get("pretokenizers") or [before]) if before else []
    first = parts[0] if parts else {}
    kept = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and first["pattern"] == {"Regex": WORD_PATTERN}
    plain = all(p["type"] == "ByteLevel" and not p.get("add_prefix_space") and not p.get("use_regex", True) for p in parts[1:])
    apart = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"])) for t in config.get("added_tokens", []))
    return bool(kept and plain and apart and config["model"]["type"] == "BPE" and not config["model"].get("continuing_subword_prefix") and config.get("post_processor") is None)


#: Fixed value: the published pattern of word ends tokenizers, whose matches hold no white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: Words of visible ASCII and the letters of U+00C0 to U+00FF: one letter in lower case each, no marks to compose.
_PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"
#: WORD_PATTERN on such words in lower case.
_PLAIN_PARTS = "('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\\s]+)"


def _byte_letters() -> dict[int, str]:
    """The letters from U+00C0 on as byte-level models write them: a visible byte as its own character, the others from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(visible)]
    letter = {**{b: chr(b) for b in visible}, **{b: chr(256 + k) for k, b in enumerate(others)}}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


_BYTES = _byte_letters()


def gathered(flat: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes) of the runs `index` of flat, whose runs have `sizes`."""
    begin, sizes = (np.cumsum(sizes) - sizes)[index], sizes[index]
    before = np.cumsum(sizes) - sizes
    return flat[np.repeat(begin - before, sizes) + np.arange(sizes.sum())], sizes


class Words:
    """A tokenizer file with the ids of the parts of words that this worker has met."""

    def __init__(self, path: str, keep: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.by_word = splits_at_blanks(config)
        self.added = [t["content"] for t in config.get("added_tokens", [])]
        self.keep, self.known = keep, {}
        self.size = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0) + 1

    def _ids(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _part_ids(self, parts: list[str]) -> list[list[int]]:
        """Ids of parts. What the steps before the model make of a plain part is known: its bytes as the model writes them; so it goes to the library's model at once."""
        own = pa.array(parts, pa.large_string())
        plain = pc.and_(pc.match_substring_regex(own, _PLAIN), pc.match_substring_regex(own, f"^{_PLAIN_PARTS}$"))
        for text in self.added:
            plain = pc.and_not(plain, pc.match_substring(own, text))
        plain = plain.to_pylist()
        tokenize = self.tokenizer.model.tokenize
        rest = iter(self._ids([p for p, known in zip(parts, plain, strict=True) if not known]))
        return [[t.id for t in tokenize(p if p.isascii() else p.translate(_BYTES))] if known else next(rest) for p, known in zip(parts, plain, strict=True)]

    def parts(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(parts, parts of each word): plain words in lower case at the places where the pattern parts them, others whole.

        A part alone has the ids that it has within its word; a plain word with an added token's text is left whole.
        """
        plain = pc.match_substring_regex(words, _PLAIN)
        for text in self.added:
            plain = pc.and_not(plain, pc.match_substring(words, text))
        split = pc.if_else(plain, pc.replace_substring_regex(pc.utf8_lower(words), _PLAIN_PARTS, "\\1 "), words)
        own, bounds = words_of(split)
        return own, np.diff(bounds)

    def encode(self, column: pa.Array, end: int, dtype: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each text with the end id, all ids)."""
        if not self.by_word:
            ids = self._ids(column.to_pylist())
            return np.array([len(x) + 1 for x in ids], np.int64), np.fromiter(chain.from_iterable([*x, end] for x in ids), dtype)
        words, bounds = words_of(column)
        coded = words.dictionary_encode()
        parts, count = self.parts(coded.dictionary)
        coded_parts = parts.dictionary_encode()
        distinct = coded_parts.dictionary.to_pylist()
        ids = [self.known.get(w) for w in distinct]
        new = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(new, self._part_ids([distinct[i] for i in new]), strict=True):
            ids[i] = x
        often = np.bincount(coded_parts.indices.to_numpy(zero_copy_only=False), minlength=len(distinct)) > 1  # most others never come again
        if len(self.known) > self.keep:
            self.known = {}
        self.known.update((distinct[i], ids[i]) for i in new if often[i] and len(distinct[i]) <= 48)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), dtype, int(sizes.sum()))
        flat, sizes = gathered(flat, sizes, coded_parts.indices.to_numpy(zero_copy_only=False))
        at = np.r_[0, np.cumsum(sizes)]
        edge = np.r_[0, np.cumsum(count)]
        flat, sizes = np.append(flat, np.array([end], dtype)), np.append(np.diff(at[edge]), 1)  # the end id is one more word
        n_docs = len(bounds) - 1
        code = np.full(len(words) + n_docs, len(count), np.int64)
        is_word = np.ones(len(code), bool)
        is_word[bounds[1:] + np.arange(n_docs)] = False
        code[is_word] = coded.indices.to_numpy(zero_copy_only=False)
        out, sizes = gathered(flat, sizes, code)
        return np.diff(np.r_[0, np.cumsum(sizes)][np.r_[0, bounds[1:] + np.arange(1, n_docs + 1)]]), out


def write_tokens(df: DataFrame, tokenizer_path: str, end: int, shards: int | None = None, file_ids: int = 1 << 23, batch_bytes: int = 8 << 20, keep_words: int = 400_000) -> DataFrame:
    """The manifest of files that hold the ids of all texts of df (doc_id, text): shard, part, path, start, n_docs, n_ids.

    Each document has the ids that the tokenizers library gives for its whole text without special tokens, then the end id.
    Files follow each other by shard and part in ascending doc_id order, and start counts the ids of all documents in
    the files before. Rows of one doc_id are in the order of a hash of their text, those without a doc_id come last, a
    null text is the empty one (the end id only), an empty table has no files, further columns are ignored.

    Texts are dealt to `shards` ranges of doc_id (default: the session's shuffle partitions), ties by text hash and then
    at random, so that many rows of one doc_id are not one task's. A shard is encoded where it is written. A file is
    closed at file_ids ids, after a whole document, and has a new name in each attempt of a task; the manifest lists those of the
    attempts that Spark took, so files of lost executors are never read. Executors write to the shared folder by Arrow's
    file systems. The tokenizer file must be at the same path on every executor.
    """
    spark = df.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = shared_folder(spark, "tokens")
    order = ["ord", "doc_id", "tie", "salt"]
    rows = texts(df).withColumns({"ord": F.coalesce("doc_id", F.lit(_LAST)), "tie": F.xxhash64("text"), "salt": F.rand(7)}).select("doc_id", "text", "ord", "tie", "salt")
    rows = rows.repartitionByRange(shards, *(F.col(c).asc_nulls_last() for c in order)).sortWithinPartitions(*(F.col(c).asc_nulls_last() for c in order))

    def run(batches):
        key = tokenizer_path, keep_words
        if key not in _STATE:
            _STATE[key] = Words(*key)
        words = _STATE[key]
        dtype = "<u2" if max(words.size, end + 1) <= 1 << 16 else "<u4"
        system, at = _opened(folder)
        system.create_dir(at, recursive=True)
        shard, part = TaskContext.get().partitionId(), 0
        doc_ids, sizes, ids, held = [], [], [], 0

        def closed() -> pa.RecordBatch:
            path = f"{at}/{shard:06d}-{part:05d}-{uuid.uuid4().hex}.tok"
            with system.open_output_stream(path) as out:
                out.write(pack(doc_ids, np.concatenate(sizes), np.concatenate(ids)))
            return pa.RecordBatch.from_pylist([{"shard": shard, "part": part, "path": path, "n_docs": len(doc_ids), "n_ids": held}], schema)

        schema = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        for keys, column in arrow_slices(batches, batch_bytes):
            size, flat = words.encode(column, end, dtype)
            doc_ids += keys.to_pylist()
            sizes.append(size)
            ids.append(flat)
            held += len(flat)
            if held >= file_ids:
                yield closed()
                part += 1
                doc_ids, sizes, ids, held = [], [], [], 0
        if doc_ids:
            yield closed()

    files = written(rows.select("doc_id", "text").mapInArrow(run, "shard long, part long, path string, n_docs long, n_ids long"), "token-files")
    below = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("base"))
    start = F.col("base") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))
    return files.join(base, "shard").select("shard", "part", F.concat(F.lit(folder + "/"), F.substring_index("path", "/", -1)).alias("path"), start.alias("start"), "n_docs", "n_ids")


def read_tokens(files: DataFrame, what=None, schema: str = "ids array<int>", tasks: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens and the ids of each document of the files of a manifest (path, start).

    start counts the ids of all documents before. In place of the ids, what(ids as unsigned 32-bit numbers) may give
    another value, of the column in schema. Files are dealt to tasks; a task reads one document's ids at a time.
    """
    spark = files.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = schema.split()[0]
    what = what or (lambda ids: ids.astype(np.int32))

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, at = _opened(path)
                with system.open_input_file(at) as source:
                    file = TokenFile(source)
                    bounds, doc_ids = file.bounds.values().astype(np.int64), file.doc_ids()
                    for a in range(0, file.n, 4096):
                        b = min(a + 4096, file.n)
                        cells = [what(file.ids(int(x), int(y)).astype("<u4")) for x, y in zip(bounds[a:b], bounds[a + 1 : b + 1], strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids[a:b], pa.int64()), pa.array(bounds[a:b] + start), pa.array(np.diff(bounds[a : b + 1])), pa.array(cells)], ["doc_id", "start", "n_tokens", name])

    return files.select("path", "start").repartition(tasks, "path").mapInArrow(run, f"doc_id long, start long, n_tokens long, {schema}")


def crc32(ids: np.ndarray) -> int:
    """CRC-32, without sign, of ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(ids.tobytes())
