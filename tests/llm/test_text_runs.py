"""Prefix trie, periodic runs and token files."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import periodic_runs, prefix_trie, queries, token_files
from tests.llm.conftest import EDGES

TURNS = "conv_id long, turn long, role string, text string, depth int, h1 string, c long, size string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "h", 2, "s") for r in rows], TURNS)


def brute_trie(rows):
    """Node rows, from dictionaries of whole prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    convs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        convs[c] = tuple(own.get(c - c % 5, [])[:h] + ts[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
        ends[ts].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own_saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = own_saved + sum(saved[k] for k in kids[node])
    sha = lambda node: hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]), leaves[node], saved[node], sha(node)) for node, m in members.items())


def trie_rows(df):
    return sorted(tuple(r) for r in df.collect())


def conversations(rng, n, words):
    """Conversations that share beginnings, copies of one another, some short, some numbers absent, nulls."""
    rows, pool = [], []
    for c in range(n):
        if rng.random() < 0.1:
            continue
        ts = list(rng.choice(pool))[: rng.randint(1, 12)] if pool and rng.random() < 0.6 else []
        ts += [(rng.choice(["user", "assistant", None]), rng.choice(words)) for _ in range(rng.randint(0 if ts else 1, 4))]
        pool.append(ts)
        numbers = [None, *range(len(ts))][: len(ts)] if rng.random() < 0.3 else range(len(ts))
        rows += [(c, k, r, t) for k, (r, t) in zip(numbers, ts, strict=True)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("bound", "fan", "broadcast"), [(4096, 64, 50_000), (6, 2, 50_000), (1, 2, 0)])
def test_prefix_trie(spark, bound, fan, broadcast):
    rng = random.Random(bound)
    rows = conversations(rng, 160, ["a", "é b", "", None, "long text of a turn"])
    rows += [(c, k, "user", "same") for c in range(200, 240) for k in range(9)]  # one group of copies
    rows += [(250, k, "user", f"deep {k}") for k in range(90)]
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.numbered_turns(turns(spark, rows))), bound, fan, broadcast)
    assert trie_rows(got) == brute_trie(rows)


def test_prefix_trie_edges(spark):
    trie = lambda rows: prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.numbered_turns(turns(spark, rows))))
    assert trie([]).count() == 0 and trie([(None, 0, "user", "nobody's")]).count() == 0
    one = [(None, 0, "user", "nobody's"), (7, None, None, None)]
    assert trie_rows(trie(one)) == brute_trie(one)
    bare = next(c for c in range(6, 10) if zlib.crc32(str(c).encode()) % 9 >= 1)  # its base is absent, its own turn goes
    assert trie_rows(trie([(bare, 3, "user", "x")])) == [(bare, 0, None, 1, 0, 1, 0, hashlib.sha256(str(bare).encode()).hexdigest())]
    tied = [(10, 1, "user", "b"), (10, 1, "user", "a"), (10, 1, "user", "a")]
    assert trie(tied).count() == trie(list(reversed(tied))).count() == 4
    plain = prefix_trie.prefix_trie(prefix_trie.whole(prefix_trie.numbered_turns(turns(spark, tied))))
    assert [(r["depth"], r["n_convs"]) for r in plain.orderBy("depth").collect()] == [(0, 1), (1, 1), (2, 1), (3, 1)]


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, 2**64, 20_000, dtype=np.uint64) for _ in range(2))
    a[:5000] = a[0]  # equal halves are told apart by the others
    slots = prefix_trie.Slots(a, b)
    assert sorted(slots.slot) == list(range(20_000)) and (slots.find(a, b) == slots.slot).all()
    assert (slots.find(b, a) == -1).all() and len(prefix_trie.Slots(a[:0], b[:0]).slot) == 0
    with pytest.raises(ValueError, match="repeat"):
        prefix_trie.Slots(np.zeros(2, np.uint64), np.zeros(2, np.uint64))


def brute_runs(words, length=24, exponent=3):
    """Lag by lag from the least, so a stretch that has been found has its smallest period already."""
    out, seen = [], set()
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(length, exponent * q) and (i, j) not in seen and not any(a == i and n == j - i + q for a, n, _ in out):
                out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(rng, k):
    words = []
    for _ in range(rng.randint(0, 6)):
        part = [f"w{rng.randrange(k)}" for _ in range(rng.randint(1, 40))]
        words += (part * 6)[: rng.randint(1, 150)] + [f"x{rng.randrange(60)}" for _ in range(rng.choice([0, 0, 3, 30]))]
    return words


def collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_periodic_runs_by_brute_force():
    rng, total = random.Random(3), 0
    for _ in range(250):
        docs = [periodic(rng, rng.choice([1, 2, 3, 5, 50])) for _ in range(rng.randint(1, 4))]
        counts, runs, left = periodic_runs.collapse(pa.array([rng.choice([" ", "\n ", "\t\x0b"]).join(d) for d in docs]), 24, 3)
        for words, n, found, text in zip(docs, counts, runs.to_pylist(), left.to_pylist(), strict=True):
            expected = brute_runs(words)
            total += len(expected)
            assert [(r["start"], r["length"], r["period"]) for r in found] == expected
            assert n == len(words) and text == collapsed(words, expected)
    assert total > 500


def test_splitting_keeps_whole_runs_and_drops_rare_words():
    words = [*[f"u{k}" for k in range(50)], *["a", "b"] * 20, *[f"v{k}" for k in range(50)]]
    codes = np.unique(words, return_inverse=True)[1]
    at, segment = periodic_runs.surviving_segments(codes, np.zeros(len(codes), np.int64), 24, 3)
    assert at.tolist() == list(range(50, 90)) and len(set(segment.tolist())) == 1


def test_periodic_runs_of_hard_texts():
    rng = random.Random(1)
    hard = " ".join(rng.choice("ab") for _ in range(200_000))
    cube = " ".join(["c"] * 300_000)
    _, runs, left = periodic_runs.collapse(pa.array([hard, cube]), 24, 3)
    assert runs[1].as_py() == [{"start": 0, "length": 300_000, "period": 1}] and left[1].as_py() == "c"
    with pytest.raises(ValueError, match="exponent"):
        periodic_runs.find_runs(np.zeros(3, np.int64), np.zeros(3, np.int64), 24, 2)


def test_collapse_runs_on_tables(edges, empty):
    rows = periodic_runs.collapse_runs(edges).collect()
    assert len(rows) == len(EDGES)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["n_words"] == by_id[2]["n_words"] == by_id[8]["n_words"] == 0 and by_id[1]["text"] == "" and by_id[None]["n_words"] == 14
    assert [(r["start"], r["length"], r["period"]) for r in by_id[9]["runs"]] == [(0, 160, 4)] and by_id[9]["text"] == "é ünï 日本語 🎉"
    assert periodic_runs.collapse_runs(empty).count() == 0


def test_op12_query(spark, tmp_path):
    rng = random.Random(8)
    docs = [(i, " ".join(f"w{rng.randrange(2000)}" for _ in range(rng.choice([0, 1, 30, 400]))) if i % 7 else None) for i in range(150)]
    docs += [(i, "\n".join(periodic(rng, 3))) for i in range(150, 200)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    planted = 0
    for i, text in docs:
        words, h = WORD.findall(text or ""), zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
            planted += 1
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        r = got[i]
        assert (r["n_runs"], r["runs_sha256"]) == (len(runs), hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest())
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert planted > 5


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, u in [(0, 0), (1, 0), (1, 2**63), (5, 3), (1000, 10), (1000, 10**6), (3000, 2**62), (777, 776)]:
        values = np.sort(rng.integers(0, u + 1, n, dtype=np.uint64))
        coded = token_files.EliasFano.of(values).to_bytes()
        own = token_files.EliasFano.from_bytes(coded)
        assert (own.values() == values).all() and [own.select(i) for i in range(n)] == values.tolist()
        assert len(coded) <= 32 + n * (2 + max(0, np.log2((u + 1) / max(n, 1))) + 0.125 * 1) / 8 + n / 4 + 16
    with pytest.raises(IndexError):
        own.select(777)


@pytest.fixture(scope="module")
def word_file():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("word_bpe_49k.json")


def test_words_as_the_library_encodes_whole_texts(word_file):
    words = token_files.Words(word_file, 500)
    assert words.by_word
    rng = random.Random(0)
    parts = ["a", "B", " ", "\n", "\t", "\x0b", "\x1c", "\xa0", " ", "é", "é", "'s", "it's", "<|endoftext|>", " <|startoftext|>x", "9", "ß", "İ", "日本", "🎉", "!?", "\r\n", "ΑΣ", " ̀", "\x85"]
    for _ in range(400):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(4)]
        sizes, flat = words.encode(pa.array(texts), 1, "<u2")
        expected = [[*words.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
        assert sizes.tolist() == list(map(len, expected)) and flat.tolist() == sum(expected, [])


def test_other_tokenizers_encode_whole_texts(spark, make, word_file):
    path = word_file.replace("word_bpe_49k", "byte_bpe_50k")
    words = token_files.Words(path, 500)
    assert not words.by_word
    text = " two  blanks\n\nand <|endoftext|> é"
    got = token_files.read_tokens(token_files.write_tokens(make([(1, text)]), path, 50256, shards=2)).first()
    assert got["ids"] == [*words.tokenizer.encode(text, add_special_tokens=False).ids, 50256]


def test_token_files(spark, make, edges, empty, word_file):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(word_file)
    rng = random.Random(2)
    rows = [(rng.randint(-50, 2**40), " ".join(rng.choice(["Alpha", "beta9", "é!", "x"]) for _ in range(rng.choice([0, 1, 50, 3000])))) for _ in range(300)]
    files = token_files.write_tokens(make(rows), word_file, 1, shards=5, file_ids=4000, batch_bytes=10_000).cache()
    assert files.count() > 10 and files.selectExpr("count(distinct path) = count(*)").first()[0]
    got = sorted(token_files.read_tokens(files).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted(i for i, _ in rows)
    at, expected = 0, {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in rows}
    for r in got:
        assert (r["start"], r["n_tokens"], r["ids"]) == (at, len(expected[r["doc_id"]]), expected[r["doc_id"]])
        at += r["n_tokens"]
    path = files.orderBy(files.start).first()["path"]
    with token_files._opened(path)[0].open_input_file(token_files._opened(path)[1]) as source:
        file = token_files.TokenFile(source)
        assert file.width == 2 and file.document(file.n - 1).tolist() == expected[file.doc_ids()[-1]]
    rest = sorted(token_files.read_tokens(token_files.write_tokens(edges, word_file, 1, shards=3)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rest] == [1, 2, 3, 5, 6, 7, 7, 8, 9, None] and rest[0]["ids"] == rest[1]["ids"] == [1]
    assert token_files.read_tokens(token_files.write_tokens(empty, word_file, 1, shards=3)).count() == 0


def test_op13_query(spark, make, tmp_path, word_file):
    from tokenizers import Tokenizer

    make([(i, f"Text number {i}" if i % 3 else None) for i in range(90)]).write.parquet(str(tmp_path / "documents.parquet"))
    library, at = Tokenizer.from_file(word_file), 0
    for r in queries.op13_token_files(spark, str(tmp_path)).orderBy("doc_id").collect():
        ids = [*library.encode(f"Text number {r['doc_id']}" if r["doc_id"] % 3 else "", add_special_tokens=False).ids, 1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
