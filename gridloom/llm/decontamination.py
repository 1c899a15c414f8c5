"""Benchmark decontamination: item-sized windows, SimHash fingerprints found through Hamming blocks, exact verification.

DataFrame functions only. A window that holds fewer shingles of the items of its size than the similarity takes could
never verify; every other window gets a fingerprint, wherever it starts, and the blocks of it name the items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import texts

NGRAM, SIMILARITY = 5, 0.8
#: Fingerprints of BITS bits, cut to BLOCKS blocks; all pairs within RADIUS bits agree in a block up to RADIUS // BLOCKS bits.
#: A bit of two sets of similarity 0.8 differs with a probability of 0.152 by the angle: more than RADIUS then differ in
#: one of 100,000 pairs. Counted out for small sets it is 0.161 (3 of 100,000) and, at worst, 0.188 for 4 features and
#: the same with one more (3 of 10,000), which only a text shorter than an item of 9 words has.
BITS, BLOCKS, RADIUS = 64, 8, 23
_WIDTH = BITS // BLOCKS


def word_array(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _positions(words: Column) -> Column:
    return F.when(F.size(words) >= NGRAM, F.sequence(F.lit(0), F.size(words) - NGRAM))


def shingle_hashes(words: Column) -> Column:
    return F.transform(_positions(words), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(NGRAM))))


def shingle_texts(words: Column) -> Column:
    return F.transform(_positions(words), lambda i: F.array_join(F.slice(words, i + 1, NGRAM), " "))


def occurrences(values: Column) -> Column:
    """(value, number) of each value of an array: how many equal ones came before it, so that weights become a set."""

    def numbered(ordered: Column) -> Column:
        """Each run of equal values is numbered from its own first place on, so the cost is linear."""
        first = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))

        def runs(at: Column) -> Column:
            length = lambda s, j: F.coalesce(F.get(at, j + 1), F.size(ordered)) - s
            return F.flatten(F.transform(at, lambda s, j: F.transform(F.sequence(F.lit(0), length(s, j) - 1), lambda k: F.struct(F.get(ordered, s).alias("value"), k.cast("long").alias("number")))))

        return F.get(F.transform(F.array(first), runs), 0)

    # a lambda binds the sorted array, or it would be sorted again for each value
    repeated = F.get(F.transform(F.array(F.array_sort(values)), numbered), 0)
    single = F.transform(values, lambda v: F.struct(v.alias("value"), F.lit(0).cast("long").alias("number")))
    return F.when(F.size(F.array_distinct(values)) == F.size(values), single).otherwise(repeated)


def features(hashes: Column) -> Column:
    """A hash for each shingle and number of its occurrence: weighted similarity is that of these sets."""
    return F.transform(occurrences(hashes), lambda o: F.xxhash64(o["value"], o["number"]))


def simhash(hashes: str) -> Column:
    """Fingerprint of a column of hashes, in which each votes as often as it occurs; ties give 0."""

    def bit(b: Column) -> Column:
        ones = F.size(F.filter(hashes, lambda h: F.call_function("getbit", h, b) == 1))
        return F.when(2 * ones > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), bit), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def hamming_blocks(fingerprint: Column, radius: int) -> Column:
    """(number, value) of each block, with all values within `radius` bits of it."""
    flips = [m for m in range(1 << _WIDTH) if m.bit_count() <= radius]
    masks = F.array(*(F.lit(m).cast("long") for m in flips))

    def variants(number: int) -> Column:
        value = F.shiftrightunsigned(fingerprint, number * _WIDTH).bitwiseAND(F.lit((1 << _WIDTH) - 1))
        return F.transform(masks, lambda m: F.struct(F.lit(number).alias("number"), value.bitwiseXOR(m).alias("value")))

    return F.flatten(F.array(*(variants(number) for number in range(BLOCKS))))


def weighted(shingles: Column) -> Column:
    """The shingles with the number of their occurrence; what two of these sets share is the sum of the lesser counts."""
    return F.transform(occurrences(shingles), lambda o: F.concat_ws(" ", o["value"], o["number"]))


def _hits(docs: DataFrame, shingles: DataFrame, literal_rows: int) -> DataFrame:
    """doc_id, words and hits of each row that shares a shingle with an item: the set of (n_item, pos) of such shingles."""
    own = docs.select("doc_id", "row_key", word_array(F.col("text")).alias("words"))
    cells = F.transform(shingle_hashes(F.col("words")), lambda h, i: F.struct(i.alias("pos"), h.alias("hash")))
    hit = F.collect_set(F.struct("n_item", "pos")).alias("hits")
    known = [r[0] for r in shingles.select("hash").distinct().limit(literal_rows + 1).collect()]
    if len(known) <= literal_rows:
        # the words go with the row's first hit only; the outer form, as the filter that Spark derives from the
        # inner one would split each text again for every word
        found = F.filter(cells, lambda c: c["hash"].isin(known))
        rows = own.select("doc_id", "row_key", "words", F.inline_outer(F.transform(found, lambda c, i: F.struct(c["pos"].alias("pos"), c["hash"].alias("hash"), (i == 0).alias("first")))))
        rows = rows.where("hash is not null").select("doc_id", "row_key", "pos", "hash", F.when(F.col("first"), F.col("words")).alias("words"))
        return rows.join(F.broadcast(shingles), "hash").groupBy("doc_id", "row_key").agg(hit, F.first("words", ignorenulls=True).alias("words")).select("doc_id", "words", "hits")
    hits = own.select("doc_id", "row_key", F.inline_outer(cells)).where("hash is not null").join(shingles, "hash")
    hits = hits.groupBy(F.col("doc_id").alias("d"), F.col("row_key").alias("k")).agg(hit)
    return docs.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("k"))).select("doc_id", word_array(F.col("text")).alias("words"), "hits")


def _windows(hits: DataFrame, similarity: float) -> DataFrame:
    """doc_id, n_item, start and window: every window with enough shingles of items of n_item words for the similarity.

    Of w shingles of the window and m of an item, at least similarity / (1 + similarity) * (w + m) must be shared. A
    window that holds as many hits holds, for some k, the hits k to k + least - 1, so it starts at or before the k-th
    and ends at or after the last of them. A start is given with the first hit that doesn't precede it, so only once.
    """
    items = hits.select("doc_id", "words", "hits", F.explode(F.array_distinct(F.transform("hits", lambda h: h["n_item"]))).alias("n_item"))
    at = F.filter("hits", lambda h: h["n_item"] == F.col("n_item"))
    own = items.select("doc_id", "words", "n_item", F.array_sort(F.transform(at, lambda h: h["pos"])).alias("at"))
    held = F.least(F.size("words"), F.col("n_item")) - (NGRAM - 1)
    least = F.greatest(F.lit(1), F.ceil((F.lit(similarity) * (held + F.col("n_item") - (NGRAM - 1)) - 1e-9) / (1 + similarity)).cast("int"))
    own = own.select("*", held.alias("held"), least.alias("least")).where(F.size("at") >= F.col("least"))
    last = F.greatest(F.lit(0), F.size("words") - F.col("n_item"))

    def starts(k: Column) -> Column:
        after = F.when(k > 0, F.get("at", k - 1) + 1).otherwise(0)
        return F.struct(F.greatest(F.lit(0), after, F.get("at", k + F.col("least") - 1) - F.col("held") + 1).alias("low"), F.least(F.get("at", k), last).alias("high"))

    ranges = F.filter(F.transform(F.sequence(F.lit(0), F.size("at") - F.col("least")), starts), lambda r: r["low"] <= r["high"])
    parts = own.select("doc_id", "n_item", "words", F.inline(ranges))
    parts = parts.select("doc_id", "n_item", "low", "high", F.slice("words", F.col("low") + 1, F.col("high") - F.col("low") + F.col("n_item")).alias("part"))
    parts = parts.select("doc_id", "n_item", "low", "part", F.explode(F.sequence("low", "high")).alias("start"))
    return parts.select("doc_id", "n_item", "start", F.slice("part", F.col("start") - F.col("low") + 1, F.col("n_item")).alias("window"))


def _near(printed: DataFrame, index: DataFrame) -> DataFrame:
    """printed with item_id and hamming of every item of its size whose fingerprint is within RADIUS bits, once for each.

    A pair that agrees in several blocks is taken in the first of them.
    """
    pairs = printed.select("*", F.inline_outer(hamming_blocks(F.col("print"), 0))).join(index, ["n_item", "number", "value"])
    differ = F.col("print").bitwiseXOR(F.col("item_print"))

    def agree(number: int) -> Column:
        return F.bit_count(F.shiftrightunsigned(differ, number * _WIDTH).bitwiseAND(F.lit((1 << _WIDTH) - 1))) <= RADIUS // BLOCKS

    first = F.lit(BLOCKS)
    for number in reversed(range(BLOCKS)):
        first = F.when(agree(number), number).otherwise(first)
    # coalesce() keeps Spark from deriving a filter on print, which would compute every fingerprint once more below
    pairs = pairs.withColumn("hamming", F.bit_count(differ)).where((F.coalesce("hamming", F.lit(BITS)) <= RADIUS) & (F.col("number") == first))
    return pairs.select(*printed.columns, "item_id", "hamming")


def find_leaks(df: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, literal_rows: int = 20_000, broadcast_items: int = 1_000) -> DataFrame:
    """doc_id, item_id, start, shared, total, hamming: the best window of each document and leaked item.

    df has doc_id and text, benchmark item_id and text. A window of as many words as the item (or the whole text,
    if that is shorter) leaks it if the weighted Jaccard similarity of their five-word shingles, each weighted by
    its count, is `similarity` or more; shared and total are the sums of lesser and greater weights, start the
    window's first word. Of several windows the most similar and then the first is given. Items and texts of under
    five words have no shingle and never leak. Null texts are empty, rows without item_id are left out; rows that
    share a doc_id count as one document, and a null doc_id stays null. Empty tables give an empty result, further
    columns are ignored.

    Fingerprints are of all windows that hold enough shingles of items of their size, whichever item has them. They
    meet the index of block values by size, block number and value: the blocks name the items, and find every
    fingerprint within RADIUS bits. A repeated shingle has a feature for each occurrence, so the bits follow the
    weighted similarity: a pair at 0.8 differs in 10 bits on average and in more than RADIUS in about one of 100,000
    cases (see there for small sets). The words travel with the row's hits: the only shuffles are of rows with a hit,
    and of candidates. The items' shingle hashes are literals of the scan up to literal_rows, beyond that they are
    joined; both find the same. The index has 296 rows of four numbers for each item, under 16 kB; it may be broadcast
    up to broadcast_items items; beyond that the distinct fingerprints are merged with it, without their words. Words
    of an item are joined to its candidates alone.
    """
    items = texts(benchmark, key="item_id").where("doc_id is not null").select(F.col("doc_id").alias("item_id"), word_array(F.col("text")).alias("item_words"))
    items = items.where(F.size("item_words") >= NGRAM).distinct()
    shingles = items.select(F.size("item_words").alias("n_item"), F.explode(shingle_hashes(F.col("item_words"))).alias("hash")).distinct()
    docs = texts(df).withColumn("row_key", F.xxhash64("doc_id", "text"))

    windows = _windows(_hits(docs, shingles, literal_rows), similarity)

    prints = items.select("item_id", F.size("item_words").alias("n_item"), shingle_hashes(F.col("item_words")).alias("hashes")).withColumn("hashes", features(F.col("hashes"))).select("item_id", "n_item", simhash("hashes").alias("item_print"))
    index = prints.select("item_id", "n_item", "item_print", F.inline_outer(hamming_blocks(F.col("item_print"), RADIUS // BLOCKS)))
    # each step reads its input several times, so none goes into the next one's expression
    printed = windows.select("*", shingle_hashes(F.col("window")).alias("hashes")).withColumn("hashes", features(F.col("hashes"))).select("doc_id", "n_item", "start", "window", simhash("hashes").alias("print"))
    if items.count() <= broadcast_items:  # Spark's own estimate does not see the variants of a block
        near = _near(printed, F.broadcast(index))
    else:
        found = _near(printed.select("n_item", "print").distinct(), index.hint("merge")).select("n_item", "print", "item_id", "hamming")
        near = printed.join(found, ["n_item", "print"])
    near = near.join(items, "item_id")

    exact = near.select("doc_id", "item_id", "start", "hamming", shingle_texts(F.col("window")).alias("a"), shingle_texts(F.col("item_words")).alias("b"))
    exact = exact.withColumns({"a": weighted(F.col("a")), "b": weighted(F.col("b"))})
    exact = exact.withColumn("shared", F.size(F.array_intersect("a", "b"))).withColumn("total", F.size("a") + F.size("b") - F.col("shared"))
    best = exact.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("shared") / F.col("total")).alias("ratio"), (-F.col("start")).alias("before"), "shared", "total", "hamming")).alias("best"))
    leaks = best.where(F.col("best.shared") >= F.col("best.total") * F.lit(similarity) - 1e-9)
    return leaks.select("doc_id", "item_id", (-F.col("best.before")).cast("long").alias("start"), F.col("best.shared").cast("long").alias("shared"), F.col("best.total").cast("long").alias("total"), F.col("best.hamming").cast("int").alias("hamming"))


def without_leaks(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of df whose document leaks no item; rows with a null doc_id stay only if none of them leaks."""
    leaked = find_leaks(df, benchmark).select("doc_id").distinct().withColumnRenamed("doc_id", "leaked_id")
    return df.join(leaked, F.col("doc_id").cast("long").eqNullSafe(F.col("leaked_id")), "left_anti")


#: Leaks without fingerprints: exact similarity of all windows that share a shingle with the item.
ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS words FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS words FROM benchmark
), ds AS (
  SELECT doc_id, len(words) AS n, i AS pos, array_to_string(words[i + 1 : i + 5], ' ') AS s FROM d, unnest(range(greatest(len(words) - 4, 0))) AS t(i)
), bs AS (
  SELECT item_id, len(words) AS n, i AS pos, array_to_string(words[i + 1 : i + 5], ' ') AS s FROM b, unnest(range(greatest(len(words) - 4, 0))) AS t(i)
), bc AS (
  SELECT item_id, n, s, count(*) AS c FROM bs GROUP BY ALL
), hit AS (
  SELECT ds.doc_id, bc.item_id, bc.n AS n_item, ds.n AS n_doc, ds.pos, ds.s, bc.c FROM ds JOIN bc USING (s)
), w AS (
  SELECT DISTINCT doc_id, item_id, n_item, n_doc, start
  FROM hit, unnest(range(greatest(0, pos + 5 - least(n_item, n_doc)), least(pos, greatest(0, n_doc - n_item)) + 1)) AS t(start)
), wc AS (
  SELECT w.doc_id, w.item_id, w.n_item, w.n_doc, w.start, least(count(*), any_value(h.c)) AS c
  FROM w JOIN hit h ON h.doc_id = w.doc_id AND h.item_id = w.item_id AND h.pos >= w.start AND h.pos + 4 < w.start + w.n_item
  GROUP BY w.doc_id, w.item_id, w.n_item, w.n_doc, w.start, h.s
), scored AS (
  SELECT doc_id, item_id, start, sum(c) AS shared, least(n_item, n_doc) - 4 + n_item - 4 - sum(c) AS total
  FROM wc GROUP BY doc_id, item_id, n_item, n_doc, start
), best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY CAST(shared AS DOUBLE) / total DESC, start) AS k FROM scored WHERE shared >= 0.8 * total - 1e-9
)
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start, CAST(shared AS BIGINT) AS shared, CAST(total AS BIGINT) AS total FROM best WHERE k = 1
"""
