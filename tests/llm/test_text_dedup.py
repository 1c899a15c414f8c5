"""Line dedup, n-gram join, suffix dedup, decontamination, components and the pipeline."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from gridloom.llm import components, decontamination, line_dedup, ngram_join, suffix_dedup
from tests.llm.conftest import EDGES


def brute_lines(rows):
    seen, out = {}, {}
    for i, t in sorted(rows):
        lines = t.split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if "".join(w).strip(" ") and seen.setdefault(w, (i, k)) != (i, k):
                gone |= {k, k + 1, k + 2}
        out[i] = (len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_line_dedup(make, edges, empty):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice("abcde") for _ in range(rng.randint(1, 12)))) for i in range(60)]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.dedup_lines(make(rows)).collect()}
    assert got == brute_lines(rows)
    assert sum(x[1] for x in got.values()) > 50
    rest = line_dedup.dedup_lines(edges, carry=("lang",)).collect()
    assert len(rest) == len(EDGES) and {r["text"] for r in rest if r["doc_id"] in (1, 2)} == {""}
    assert [r["n_removed"] for r in rest if r["doc_id"] == 8] == [0]
    assert line_dedup.dedup_lines(empty).count() == 0


def grams(t):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_links(rows):
    sets = {i: grams(t) for i, t in rows}
    keys = sorted(sets)
    links = [(a, b) for x, a in enumerate(keys) for b in keys[x + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    root = {i: i for i in keys}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    degree = Counter()
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: (find(i), degree[i]) for i in keys}


def near_rows(seed=8):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 150))]
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(own)))
    return rows + [(len(rows), rows[3][1].upper() + "!"), (len(rows) + 1, "Hi there"), (len(rows) + 2, "hi, THERE"), (len(rows) + 3, "...")]


@pytest.mark.parametrize("chunk", [384, 2])
def test_near_duplicates_are_exact(make, chunk):
    rows = near_rows()
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(make(rows), chunk_rows=chunk).collect()}
    assert got == brute_links(rows)


def test_near_duplicates_recall_at_the_threshold(make):
    """Pairs a little above the similarity, where bands miss the most: all but one in a thousand are linked."""
    rng = random.Random(15)
    rows, near = [], 0
    for k in range(500):
        base = [f"p{k}x{j}" for j in range(104)]
        changed = list(base)
        for j in rng.sample(range(0, 104, 8), 2):
            changed[j] = "changed"
        changed[-1] = rng.choice([changed[-1], "other"])
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(changed))]
        a, b = grams(rows[-1][1]), grams(rows[-2][1])
        near += len(a & b) >= 0.8 * len(a | b)
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.near_duplicates(make(rows)).collect()}
    found = sum(got[2 * k] for k in range(500))
    assert near > 400 and near * 0.999 <= found <= near


def test_one_doc_id_with_two_texts(make):
    rows = [(1, "a b c d e f g h"), (1, "k l m n o p q r"), (2, "A b c d e f g h"), (3, "a b c d e f g h."), (4, "k l m n o p q r")]
    got = sorted({(r["doc_id"], r["class_id"]) for r in ngram_join.near_duplicates(make(rows)).collect()})
    assert got == [(1, 1), (2, 1), (3, 1), (4, 1)]


def test_near_duplicates_edges(edges, empty):
    got = [(r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(edges).collect()]
    assert len(got) == len(EDGES)
    by = defaultdict(list)
    for i, c, n in got:
        by[i].append((c, n))
    assert by[1] == [(1, 0)] and by[None] == [(None, 0)] and by[6] == [(5, 1)] and by[7] == [(7, 1), (7, 1)]
    assert ngram_join.near_duplicates(empty).count() == 0
    assert {r["doc_id"] for r in ngram_join.without_near_duplicates(edges).collect()} == {1, 2, 3, None, 5, 7, 8, 9}


def test_clean_up_removes_the_written_tables(spark, make):
    from pathlib import Path

    from gridloom.llm import common

    found = ngram_join.near_duplicates(make([(1, "a b c d e f"), (2, "a b c d e f")])).collect()
    paths = [Path(p) for p in common._TABLES]
    assert len(found) == 2 and paths and all(p.exists() for p in paths)
    assert common.clean_up(spark) == len(paths) and not any(p.exists() for p in paths)


def test_bands_reach_the_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 128
    with pytest.raises(ValueError):
        ngram_join.choose_bands(0.01, 0.999999)


def test_shared_counts():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(9)]
    got = ngram_join.shared_counts(sets, columns=7)
    assert all(got[i, j] == len(set(sets[i].tolist()) & set(sets[j].tolist())) for i in range(9) for j in range(9) if i != j)


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40) if k % 10 != 9] + [(100, 3), (200, 100), (7, 7)]
    got = {r["u"]: r["v"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(k, k) == k - k % 10 for k in range(41) if k != 40) and got[200] == got[100] == 0
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_suffix(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        b = t.encode()
        cut = [False] * len(b)
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                cut[k : k + length] = [True] * length
            seen.add(w)
        kept = bytes(c for c, x in zip(b, cut, strict=True) if not x)
        spans = sum(x and (not k or not cut[k - 1]) for k, x in enumerate(cut))
        out.setdefault(i, []).append((len(b), sum(cut), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize(("block", "bucket"), [(4_000_000, 2_000_000), (3_000, 200)])
def test_suffix_dedup(make, block, bucket):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefghij éü\n") for _ in range(n))
    passages = [word(n) for n in (99, 100, 101, 130, 300)]
    rows = [(i, word(rng.randint(0, 200)) + rng.choice(passages) + word(rng.randint(0, 120)) + rng.choice(["", rng.choice(passages)])) for i in range(50)]
    rows += [(100, rows[7][1]), (101, "z" * 500), (102, "z" * 300), (103, ""), (104, rows[3][1][:150])]
    got = defaultdict(list)
    for r in suffix_dedup.dedup_suffixes(make(rows), block_bytes=block, bucket_entries=bucket).collect():
        got[r["doc_id"]].append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])))
    assert got == brute_suffix(rows, 100)


def test_suffix_edges(edges, empty):
    got = defaultdict(list)
    for r in suffix_dedup.dedup_suffixes(edges, keep_bytes=False).collect():
        got[r["doc_id"]].append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    want = brute_suffix([(i, t or "") for i, t in EDGES], 100)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(x[:4] for x in v) for k, v in want.items()}
    assert suffix_dedup.dedup_suffixes(empty).count() == 0


def test_suffix_rows_without_and_with_shared_ids(make):
    """Rows without a doc_id are dealt to many blocks; of equal rows one is the first, whatever block they are in."""
    rng = random.Random(16)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    shared = word(180)
    rows = [(None, word(300) + shared + word(100)) for _ in range(30)] + [(5, word(200) + shared) for _ in range(10)]
    rows += [rows[0]] * 40 + [rows[35]] * 40 + [(6, "short")] * 20
    got = suffix_dedup.dedup_suffixes(make(rows), block_bytes=2_000, bucket_entries=300).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    keyed = make(rows).selectExpr("doc_id", "text", "xxhash64(doc_id, text) AS k").collect()
    order = sorted(keyed, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["k"]))
    brute = brute_suffix([(k, r["text"]) for k, r in enumerate(order)], 100)
    want = Counter((r["doc_id"], *brute[k][0]) for k, r in enumerate(order))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in got) == want
    assert [bytes(r["kept"]) for r in got if r["doc_id"] == 6] == [b"short"] * 20


def test_cover_is_a_difference_cover():
    n, d = suffix_dedup.PERIOD, suffix_dedup.COVER
    assert {(a - b) % n for a in d for b in d} == set(range(n)) and sorted(d) == list(d)


def brute_leaks(docs, items):
    words = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    bag = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    out = set()
    for i, t in docs:
        w = words(t)
        for j, u in items:
            v = words(u)
            if len(v) < 5:
                continue
            b = bag(v)
            for s in range(max(1, len(w) - len(v) + 1)):
                a = bag(w[s : s + len(v)])
                shared = sum((a & b).values())
                if a and shared >= 0.8 * (sum(a.values()) + sum(b.values()) - shared) - 1e-9:
                    out.add((i, j))
    return out


@pytest.mark.parametrize("literals", [20_000, 0])
def test_leaks_are_those_of_all_windows(spark, make, literals):
    rng = random.Random(9)
    words = [f"v{k}" for k in range(300)]
    items = [(j, " ".join(rng.choice(words) for _ in range(rng.randint(8, 50)))) for j in range(12)] + [(50, "two words"), (51, None), (None, "a b c d e f g")]
    docs = []
    for i in range(60):
        own = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        if i % 3 == 0:
            part = items[rng.randrange(12)][1].split()
            for _ in range(rng.randint(0, 2)):
                part[rng.randrange(len(part))] = "changed"
            if i % 2:
                part.insert(rng.randrange(len(part)), "more")
            at = rng.randrange(len(own))
            own[at:at] = part
        docs.append((i, " ".join(own) + ("" if i % 4 else ".")))
    docs += [(100, items[2][1].upper().replace(" ", ", ")), (101, " ".join(items[3][1].split()[1:])), (102, "a b c d e f g")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(make(docs), bench, literal_rows=literals, broadcast_items=literals).collect()}
    assert got == brute_leaks(docs, items[:14])
    assert len(got) > 5


@pytest.mark.parametrize("literals", [20_000, 0])
def test_leaks_between_aligned_windows(spark, make, literals):
    """Changed ends and an insertion in the middle: the best window starts between the two that shared shingles align."""
    rng = random.Random(11)
    items, docs = [], []
    for j, (n, ends, more) in enumerate([(60, 1, 2), (104, 3, 6), (200, 7, 14)]):
        own = [f"i{j}x{k}" for k in range(n)]
        items.append((j, " ".join(own)))
        part = ["changed"] * ends + own[ends : n // 2] + [f"more{k}" for k in range(more)] + own[n // 2 : n - ends] + ["changed"] * ends
        docs.append((j, " ".join(f"f{rng.randrange(10**9)}" for _ in range(30)) + " " + " ".join(part) + " " + " ".join(f"f{rng.randrange(10**9)}" for _ in range(40))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(make(docs), bench, literal_rows=literals, broadcast_items=literals).collect()}
    assert got == brute_leaks(docs, items) == {(0, 0), (1, 1), (2, 2)}


@pytest.mark.parametrize("literals", [20_000, 0])
def test_leaks_with_repeated_words(spark, make, literals):
    """A run of one word makes a shingle of great weight, on one side only: similarity 0.8 and more, but wide angles."""
    items, docs = [], []
    for j, (n, run) in enumerate([(124, 11), (92, 7), (196, 20)] * 4):
        own = [f"i{j}x{k}" for k in range(n)]
        items.append((j, " ".join([*own, *["blank"] * (run + 4)])))
        docs.append((j, " ".join([*own, *(f"d{j}y{k}" for k in range(run + 4))])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(make(docs), bench, literal_rows=literals, broadcast_items=literals).collect()}
    assert got == brute_leaks(docs, items)
    assert len(got) == len(items)


@pytest.mark.parametrize("literals", [20_000, 0])
def test_leaks_of_moved_parts(spark, make, literals):
    """Swapped halves, and parts in another order with other words between: no shared shingle aligns the best window."""
    rng = random.Random(13)
    other = lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
    items, docs = [], []
    for j, n in enumerate((60, 60, 90, 120, 150, 40)):
        own = [f"i{j}x{k}" for k in range(n)]
        items.append((j, " ".join(own)))
        cut = n // 2 if j % 2 == 0 else n // 3
        docs.append((2 * j, " ".join(other(80) + own[cut:] + own[:cut] + other(80))))
        docs.append((2 * j + 1, " ".join(other(80) + own[cut:] + other(1 + j) + own[:cut] + other(80))))
    items += [(20 + j, " ".join(f"i{j}x{k}" for k in range(30, 60)) + " " + " ".join(f"n{j}x{k}" for k in range(30))) for j in range(2)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(make(docs), bench, literal_rows=literals, broadcast_items=literals).collect()}
    assert got == brute_leaks(docs, items)
    assert {(0, 0), (4, 2), (6, 3)} <= got


def test_leak_edges(spark, edges, empty):
    bench = spark.createDataFrame([(1, "a text without an id that is long enough"), (2, None)], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(edges, bench).collect()]
    assert got == [(None, 1)]
    assert decontamination.find_leaks(empty, bench).count() == 0 and decontamination.find_leaks(edges, bench.limit(0)).count() == 0
    assert decontamination.without_leaks(edges, bench).count() == len(EDGES) - 1


def test_hamming_blocks_find_all_within_the_radius(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(60):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, decontamination.RADIUS)):
            b ^= 1 << bit
        rows.append((a - (1 << 63), b - (1 << 63)))
    df = spark.createDataFrame(rows, "a long, b long")
    n = decontamination.RADIUS // decontamination.BLOCKS
    own = df.select(decontamination.hamming_blocks(df["a"], 0).alias("x"), decontamination.hamming_blocks(df["b"], n).alias("y"))
    assert own.selectExpr("arrays_overlap(x, y) AS hit").where("hit").count() == len(rows)


def test_pipeline_follows_its_operators(spark, tmp_path):
    """Each stage, on small tables, against brute force on the rows that the stage before it kept."""
    rng = random.Random(12)
    words = [f"k{k}" for k in range(500)]
    text = lambda n: "\n".join(" ".join(rng.choice(words) for _ in range(12)) + "." for _ in range(n))
    item = " ".join(rng.choice(words) for _ in range(30))
    rows = [(i, text(rng.randint(3, 9))) for i in range(30)]
    rows += [(30, rows[4][1].replace("k1", "k2", 1)), (31, text(3) + " " + item), (32, "tiny"), (33, None), (34, rows[5][1] + "\n" + text(4))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(5)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == list(corpus_pipeline.COLUMNS) and out.dtypes == docs.dtypes
        path = f"{tmp_path}/out{k}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append({r["doc_id"]: r.asDict().get("text") for r in docs.collect()})
    assert set(kept[0]) == {i for i, t in rows} - {32, 33}
    assert kept[1] == {i: x[2] for i, x in brute_lines([(i, t) for i, t in rows if i in kept[0]]).items()}
    classes = brute_links(list(kept[1].items()))
    assert set(kept[2]) == {i for i, (c, _) in classes.items() if i == c}
    assert set(kept[3]) == set(kept[2]) - {31}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept[4]) == len(kept[3])


def test_occurrences_of_many_repeats(spark):
    from pyspark.sql import functions as F

    values = [5, 3, 5, 5, 3, 9]
    one = spark.createDataFrame([(values,), ([7] * 200_000,), ([],), ([4],)], "v array<long>").select(F.expr("size(v)").alias("n"), decontamination.occurrences(F.col("v")).alias("o"))
    got = {r["n"]: [tuple(x) for x in r["o"]] for r in one.collect()}
    assert sorted(got[6]) == [(3, 0), (3, 1), (5, 0), (5, 1), (5, 2), (9, 0)] and got[0] == [] and got[1] == [(4, 0)]
    assert got[200_000] == [(7, k) for k in range(200_000)]


def test_pipeline_on_empty_tables_and_its_tables_go(spark, tmp_path):
    import os

    from gridloom.llm import common

    folder = common.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    left = {f for f in set(os.listdir(folder)) - before if f.startswith(("stage-", "join-", "suffix-", "trie-"))}
    assert len(left) == 1
    common.clean_up(spark)
    assert not left & set(os.listdir(folder))
