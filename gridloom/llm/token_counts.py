"""Token counts of whole texts, as the tokenizers library gives them, in Arrow batches that return lengths only."""

from __future__ import annotations

import json
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import byte_batches, texts

#: Before a single blank, tab or line break between two other characters a byte-level BPE always starts a new word.
#: Not so before any \s: U+001C to U+001F are white space for re, but not for the tokenizer.
_SAFE = re.compile(r"(?<=\S)(?=[ \t\r\n]\S)")
_STATE: dict[str, tuple] = {}


def safe_pieces(text: str) -> list[str]:
    """Pieces of text whose token counts add up to those of the whole."""
    return _SAFE.split(text)


def splits_at_blanks(config: dict) -> bool:
    """Whether a tokenizer starts a new word at each place of _SAFE: byte-level BPE by its own pattern, texts unchanged, no added token with white space.

    Fixed values: names of the tokenizer file's format.
    """
    before = config.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    apart = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])) for t in config.get("added_tokens", []))
    return bool(plain and apart and not config.get("normalizer") and config["model"]["type"] == "BPE")


def _counter(path: str, cache_words: int, batch_bytes: int):
    """A function of texts to token counts; the worker keeps it, and the counts of short pieces, for later tasks."""
    if path not in _STATE:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            splits = splits_at_blanks(json.load(f))
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        _STATE[path] = tokenizer, {}, splits
    tokenizer, known, splits = _STATE[path]

    def fill(new: list[str]) -> dict[str, int]:
        out: dict[str, int] = {}
        group, size = [], 0
        for k, piece in enumerate(new, 1):
            group.append(piece)
            size += len(piece) if piece.isascii() else len(piece.encode("utf-8", "surrogatepass"))
            if size >= batch_bytes or k == len(new):
                out.update(zip(group, (len(e) for e in tokenizer.encode_batch_fast(group, add_special_tokens=False)), strict=True))
                group, size = [], 0
        return out

    def count(batch: list[str]) -> list[int]:
        split = [safe_pieces(t) if splits else [t] for t in batch]
        new = fill(list({p for pieces in split for p in pieces if p not in known}))
        if len(known) + len(new) > cache_words:
            known.clear()
            new |= fill(list({p for pieces in split for p in pieces if p not in new}))
        known.update((p, n) for p, n in new.items() if len(p) <= 48)
        new = {p: n for p, n in new.items() if len(p) > 48}
        return [sum(known[p] if p in known else new[p] for p in pieces) for pieces in split]

    return count


def count_tokens(df: DataFrame, tokenizer_path: str, batch_bytes: int = 1 << 20, cache_words: int = 600_000, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of df (doc_id, text).

    No begin, end or added special tokens; special strings within a text count as the library's default
    has them. A null text is the empty one (0 bytes, 0 tokens). Rows that repeat are counted row by row,
    a null doc_id stays null, further columns are ignored, and an empty table gives an empty result.
    Texts gather to batches of about batch_bytes, and only the distinct pieces that a worker has not
    seen before (it keeps cache_words at most) are encoded; a long text is split at safe boundaries. A tokenizer for
    which those are not known to be safe gets each text whole.
    The tokenizer file must be at the same path on every executor.
    """

    def run(batches):
        count = _counter(tokenizer_path, cache_words, 4 * batch_bytes)
        for ids, batch in byte_batches(batches, batch_bytes):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in batch], pa.int64()), pa.array(count(batch), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = texts(df).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
