"""URL filters: host and path rules, and association rules mined by FP-growth from labelled pages."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import checkpointed

#: (action, rule) of the fixed list; a rule is host/path-prefix.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
BLOCK = "label=block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ://, ASCII lower-cased, and the path up to ? or #; both empty without ://."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def listed(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits: its host or a subdomain of it, and its path as a prefix."""
    rule = action = F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def url_tokens(url: Column) -> Column:
    """Distinct tokens: scheme, the host and its parts, path segments (digits as #), extension, query keys, fragment."""
    host, path = host_and_path(url)
    rest = F.coalesce(url, F.lit(""))
    parts = F.split(host, r"\.")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    query = F.regexp_extract(rest, r"\?([^#]*)", 1)
    return F.array_distinct(
        F.concat(
            F.array(F.concat(F.lit("scheme:"), F.regexp_extract(rest, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.concat(F.lit("host:"), host), F.concat(F.lit("tld:"), F.element_at(parts, -1))),
            F.transform(parts, lambda s: F.concat(F.lit("label:"), s)),
            F.transform(segments, lambda s: F.concat(F.lit("path:"), F.regexp_replace(s, r"[0-9]+", "#"))),
            F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("query:"), F.split_part(s, F.lit("="), F.lit(1)))),
            F.when(rest.contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
        )
    )


def set_key(tokens: str) -> Column:
    """A text for each token array, not the same for any two: tokens with their lengths before them. It begins with a digit, or is empty."""
    return F.array_join(F.transform(tokens, lambda t: F.concat(F.length(t).cast("string"), F.lit(":"), t)), "")


def labelled(pages: DataFrame, labels: DataFrame, fixed=RULES) -> DataFrame:
    """tokens_key, tokens, n and n_bad of each distinct token set of labelled pages.

    The fixed list labels the pages that one of its rules fits. Of the others those are labelled whose page_id is a
    doc_id of labels: toxic or of quality 0 means bad. That a page and the document of its number belong together is an
    assumption: no table says so, and no other one labels pages.
    """
    label = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max(((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).cast("int")).alias("bad"))
    _, action = listed(*host_and_path(F.col("url")), fixed)
    own = pages.select(F.col("page_id").cast("long"), action.alias("action"), url_tokens(F.col("url")).alias("tokens")).join(label, "page_id", "left")
    own = own.withColumn("bad", F.coalesce((F.col("action") == "block").cast("int"), "bad")).where("bad is not null")
    return own.groupBy(set_key("tokens").alias("tokens_key")).agg(F.first("tokens").alias("tokens"), F.count("*").alias("n"), F.sum("bad").alias("n_bad"))


def token_classes(sets: DataFrame, least: int, total: int) -> DataFrame:
    """members: the tokens that occur in exactly the same token sets, `least` pages at least, without those of every page.

    Tokens that always come together would make FP-growth list each of their combinations. Sets of token sets compare
    by four sums of 32-bit hashes. At most (tokens of a page) / support tokens are frequent, so the table is small.
    """
    low, parts = F.lit(0xFFFFFFFF).cast("long"), []
    for salt in (1, 2):
        h = F.xxhash64(F.lit(salt), "tokens_key")
        parts += [F.sum(h.bitwiseAND(low)), F.sum(F.shiftrightunsigned(h, 32))]
    seen = sets.select("tokens_key", "n", F.explode("tokens").alias("token"))
    stats = seen.groupBy("token").agg(F.sum("n").alias("pages"), *(p.alias(f"s{k}") for k, p in enumerate(parts))).where((F.col("pages") >= least) & (F.col("pages") < total))
    return stats.groupBy("pages", "s0", "s1", "s2", "s3").agg(F.array_sort(F.collect_list("token")).alias("members")).select("members")


def _baskets(sets: DataFrame, classes: DataFrame, chunk: int = 1_000) -> DataFrame:
    """items: a row for each labelled page, of the first members of its classes and BLOCK if it is bad.

    A frequent token set is one row until here; it is dealt to the tasks in chunks before it becomes many.
    """
    first = F.broadcast(classes.select(F.get("members", 0).alias("item"), F.explode("members").alias("token")))
    rows = sets.select("tokens_key", "n", "n_bad", F.explode("tokens").alias("token")).join(first, "token")
    rows = rows.groupBy("tokens_key", "n", "n_bad").agg(F.collect_set("item").alias("items"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / chunk)))).repartition("tokens_key", "part")
    number = F.explode(F.sequence(F.col("part") * chunk, F.least(F.col("n"), (F.col("part") + 1) * chunk) - 1))
    rows = rows.select("items", "n_bad", number.alias("number"))
    return rows.select(F.when(F.col("number") < F.col("n_bad"), F.array_append("items", F.lit(BLOCK))).otherwise(F.col("items")).alias("items"))


def minimal(rules: DataFrame) -> DataFrame:
    """Of rules (items, confidence, n; with all their parts) those of a greater confidence than each proper part.

    Sizes are taken in turn, and a rule meets its parts of one item less with the best confidence within them: a
    few joins on whole item sets instead of one on single items.
    """
    rules = checkpointed(rules)
    size = rules.agg(F.max(F.size("items"))).first()[0] or 0
    best = out = None
    for k in range(1, size + 1):
        own = rules.where(F.size("items") == k)
        if k == 1:
            own = own.withColumn("within", F.lit(0.0))
        else:
            part = own.select("items", F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("part"))
            within = part.join(best.select(F.col("items").alias("part"), "best"), "part").groupBy("items").agg(F.max("best").alias("within"))
            own = own.join(within, "items")
        own = checkpointed(own)
        best = own.select("items", F.greatest("confidence", "within").alias("best"))
        kept = own.where("confidence > within").select(*rules.columns)
        out = kept if out is None else out.unionByName(kept)
    return rules if out is None else out


def mine_rules(pages: DataFrame, labels: DataFrame, min_support: float = 0.005, min_count: int = 5, min_confidence: float = 0.6, min_lift: float = 1.3, fixed=RULES) -> DataFrame:
    """rule_id, items, confidence and n (bad pages) of the rules items => block, from every labelled page.

    items is an array of token classes: a page has the item if it has one of the class's tokens, which on labelled
    pages always come together. See labelled() for the labels. A rule's bad pages are at least min_support of the
    labelled ones and min_count; it has min_confidence and min_lift; it goes if a proper part of its items has its
    confidence. Without labelled pages, or bad ones, there are no rules.
    """
    sets = checkpointed(labelled(pages, labels, fixed))
    total, bad = sets.agg(F.sum("n"), F.sum("n_bad")).first()
    empty = pages.sparkSession.createDataFrame([], "rule_id long, items array<array<string>>, confidence double, n long")
    if not bad:
        return empty
    least = max(min_count, math.ceil(min_support * total))
    classes = checkpointed(token_classes(sets, least, total))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / total)).fit(_baskets(sets, classes))
    found = model.freqItemsets.select(F.array_sort("items").alias("items"), "freq")
    with_block = found.where(F.array_contains("items", BLOCK) & (F.size("items") > 1)).select(F.array_remove("items", BLOCK).alias("items"), F.col("freq").alias("n"))
    rules = with_block.join(found, "items").select("items", (F.col("n") / F.col("freq")).alias("confidence"), "n")
    kept = minimal(rules).where((F.col("confidence") >= min_confidence) & (F.col("confidence") >= min_lift * bad / total))
    members = F.broadcast(classes.select(F.get("members", 0).alias("item"), "members"))
    whole = kept.select(F.xxhash64("items").alias("rule_id"), "confidence", "n", F.explode("items").alias("item")).join(members, "item")
    return whole.groupBy("rule_id", "confidence", "n").agg(F.array_sort(F.collect_list("members")).alias("items")).select("rule_id", "items", "confidence", "n")


def fired(tokens: DataFrame, rules: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """tokens_key and the highest confidence of the rules of which the tokens have a member of each item.

    tokens: tokens_key, tokens, one row for each distinct token set. The rules' inverted index
    (token, rule, item, number of items) is broadcast while it has broadcast_rows rows at most, else joined by a shuffle.
    """
    index = rules.select("rule_id", "confidence", F.size("items").alias("n_items"), F.posexplode("items").alias("item", "members"))
    index = index.select("rule_id", "confidence", "n_items", "item", F.explode("members").alias("token"))
    if index.count() <= broadcast_rows:
        index = F.broadcast(index)
    hits = tokens.select("tokens_key", F.explode("tokens").alias("token")).join(index, "token")
    whole = hits.groupBy("tokens_key", "rule_id").agg(F.size(F.collect_set("item")).alias("n"), F.first("n_items").alias("n_items"), F.first("confidence").alias("confidence")).where("n = n_items")
    return whole.groupBy("tokens_key").agg(F.max("confidence").alias("confidence"))


def judge_urls(pages: DataFrame, rules: DataFrame, fixed=RULES, hot_share: float = 0.002) -> DataFrame:
    """page_id, host, path, rule, verdict and confidence for each row of pages (page_id, url).

    The longest fixed rule decides; without one, a page that a mined rule fires on is blocked, all others
    are allowed. A null url, or one without ://, has an empty host and path. Repeated rows are judged row by
    row, a null page_id stays null, an empty table gives an empty result, further columns are ignored.
    Mined rules meet each distinct token set once. What they say of sets with over hot_share of the rows, which
    are fewer than 1 / hot_share, is broadcast; their rows don't move for the join of the others.
    """
    host, path = host_and_path(F.col("url"))
    rule, action = listed(F.col("host"), F.col("path"), fixed)
    own = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"), url_tokens(F.col("url")).alias("tokens"))
    own = own.withColumn("tokens_key", set_key("tokens")).withColumns({"rule": rule, "action": action})
    distinct = own.groupBy("tokens_key").agg(F.first("tokens").alias("tokens"), F.count("*").alias("rows"))
    found = checkpointed(distinct.select("tokens_key", "rows").join(fired(distinct, rules), "tokens_key", "left"))
    total = found.agg(F.sum("rows")).first()[0] or 0
    is_hot = F.col("rows") > hot_share * total
    hot = found.where(is_hot).select(F.col("tokens_key").alias("hot_key"), F.col("confidence").alias("hot_confidence"))
    rest = found.where(~is_hot & F.col("confidence").isNotNull()).select(F.col("tokens_key").alias("rest_key"), "confidence")
    own = own.drop("tokens").join(F.broadcast(hot), F.col("tokens_key") == F.col("hot_key"), "left")
    # no set's key begins with a line break, so the rows of hot sets are dealt by their ids and meet nothing
    key = F.when(F.col("hot_key").isNotNull(), F.concat(F.lit("\n"), F.xxhash64("page_id", "path").cast("string"))).otherwise(F.col("tokens_key"))
    own = own.withColumn("join_key", key).join(rest, F.col("join_key") == F.col("rest_key"), "left")
    sure = F.coalesce("hot_confidence", "confidence")
    return own.select("page_id", "host", "path", "rule", F.coalesce("action", F.when(sure.isNotNull(), "block").otherwise("allow")).alias("verdict"), F.coalesce(sure, F.lit(0.0)).alias("confidence"))
