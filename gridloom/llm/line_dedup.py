"""Line dedup: consecutive three-line windows that occur earlier anywhere lose all the lines they cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import texts

SIZE = 3
_LAST = 2**63 - 1


def _keyed(df: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, carried columns, and what identifies and orders a row: a null doc_id comes last."""
    return texts(df, carry=carry).withColumns({"ord": F.coalesce("doc_id", F.lit(_LAST)), "row_key": F.xxhash64("doc_id", "text")})


def _hashes(lines: Column, i: Column, salt: int) -> Column:
    return F.xxhash64(F.lit(salt), *(F.get(lines, i + k) for k in range(SIZE)))


def _windows(keyed: DataFrame) -> DataFrame:
    """ord, row_key, pos, and a 128-bit hash of each window that has a character other than a space."""
    lines = keyed.select("ord", "row_key", F.split("text", "\n").alias("lines"))
    at = F.filter(F.when(F.size("lines") >= SIZE, F.sequence(F.lit(0), F.size("lines") - SIZE)), lambda i: F.trim(F.concat(*(F.get("lines", i + k) for k in range(SIZE)))) != "")
    cell = F.transform(at, lambda i: F.struct(i.alias("pos"), _hashes(F.col("lines"), i, 1).alias("h1"), _hashes(F.col("lines"), i, 2).alias("h2")))
    return lines.select("ord", "row_key", F.inline(cell))


def dedup_lines(df: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that is left, for each row of df (doc_id, text), and the columns to carry.

    A line is removed if it lies in a window of three consecutive lines (split at \\n, compared exactly)
    that also starts earlier: at a smaller doc_id, or earlier in the same text. First occurrences stay, and
    overlapping windows merge. Windows of spaces only don't count; a text of under three lines stays as it
    is; a null text is the empty one (one line). Rows that share a doc_id compare by position only, so
    exact repeats of a row are treated alike; null doc_ids come last. An empty table gives an empty result,
    further columns are ignored.

    Occurrences are counted by a partial aggregation, so a frequent window reaches one task once from each
    map task; only repeated windows are joined back, and texts move once, to meet their removed positions.
    """
    keyed = _keyed(df, carry)
    windows = _windows(_keyed(df))
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("ord", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first")
    later = windows.join(first, ["h1", "h2"]).where((F.col("ord") != F.col("first.ord")) | (F.col("pos") != F.col("first.pos")))
    starts = later.groupBy("ord", "row_key").agg(F.collect_set("pos").alias("starts"))
    joined = keyed.join(starts, ["ord", "row_key"], "left").withColumn("lines", F.split("text", "\n"))
    covered = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + SIZE - 1)))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), covered)
    out = joined.withColumn("left", F.when(F.col("starts").isNotNull(), left))
    return out.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("left").isNull(), F.lit(0)).otherwise(F.size("lines") - F.size("left")).cast("long").alias("n_removed"),
        F.when(F.col("left").isNull(), F.col("text")).otherwise(F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n")).alias("text"),
        *carry,
    )


ORACLE_SQL = """
WITH line AS (
  SELECT doc_id, n_lines, i AS pos, lines[i + 1] AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, len(string_split(coalesce(text, ''), chr(10))) AS n_lines FROM documents),
       unnest(range(n_lines)) AS t(i)
), three AS (
  SELECT doc_id, n_lines, pos, line, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c
  FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY line, b, c ORDER BY doc_id, pos) AS k
    FROM three WHERE pos + 2 < n_lines AND trim(concat(line, b, c)) <> ''
  ) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM later, (VALUES (0), (1), (2)) AS d(k)
)
SELECT l.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(g.pos) AS BIGINT) AS n_removed,
       coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS text
FROM line l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos
GROUP BY l.doc_id
"""
