"""Text, Parquet and JSON tables: readers, and writers that never gather rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.scalar import clean


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, columns: list[str] | None = None, strict: bool = True) -> DataFrame:
    """A delimited table (also .gz and .bz2) with a header; malformed rows fail unless strict is False, which nulls them.

    Only the columns asked for are parsed; NaN and infinities become NULL.
    """
    out = spark.read.csv(path, header=True, schema=schema, mode="FAILFAST" if strict else "PERMISSIVE", encoding="UTF-8", enforceSchema=False)
    if columns:
        out = out.select(*columns)
    return out.select(*(clean(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in out.schema))


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a delimited file, from its first line only."""
    first = spark.read.text(path).limit(1).collect()
    return [c.strip().strip('"') for c in first[0][0].lstrip("﻿").split(",")] if first else []


def missing_columns(spark: SparkSession, path: str, required: list[str]) -> list[str]:
    have = set(header(spark, path))
    return [c for c in required if c not in have]


def resolve_columns(have: list[str], aliases: dict[str, list[str]]) -> dict[str, str]:
    """Name of each wanted column: an exact alias, else the only one that is equal in lower case. Ambiguity is an error."""
    out = {}
    for want, names in aliases.items():
        exact = [c for c in have if c in names]
        loose = exact or [c for c in have if c.lower() in {n.lower() for n in names}]
        if len(loose) != 1:
            raise ValueError(f"{want}: {'no column' if not loose else 'several columns'} among {have}")
        out[want] = loose[0]
    return out


def read_monthly(spark: SparkSession, path: str, limit: float = 90.0) -> DataFrame:
    """month and value of a two-column text series; malformed rows go, and values from `limit` on count as missing."""
    raw = spark.read.csv(path, header=True, schema="d string, v string").where(F.col("d").rlike(r"^\d{4}-\d{2}-\d{2}$"))
    return raw.select(F.trunc(F.to_date("d"), "month").alias("month"), sentinel_null(F.expr("try_cast(v AS DOUBLE)"), limit).alias("value"))


def sentinel_null(x: Column, limit: float = 90.0) -> Column:
    return F.when(F.abs(x) < limit, x)


def fill_missing(series: DataFrame, fill: DataFrame, key: str = "month", value: str = "value") -> DataFrame:
    """series with NULL values replaced from fill, and whether each row was; values that are there stay."""
    right = fill.select(key, F.col(value).alias("_fill"))
    out = series.join(right, key, "left")
    return out.select(*(F.coalesce(value, "_fill").alias(value) if c == value else F.col(c) for c in series.columns), (F.col(value).isNull() & F.col("_fill").isNotNull()).alias("filled"))


def read_categories(spark: SparkSession, path: str, groups: list[str], category: str) -> DataFrame:
    """category, group, count, percentage from a wide table with {group}_Count and {group}_Percentage; blanks are 0."""
    schema = ", ".join([f"`{category}` string", *(f"`{g}_Count` string, `{g}_Percentage` string" for g in groups)])
    wide = spark.read.csv(path, header=True, schema=schema)
    cells = [F.struct(F.lit(g).alias("group"), F.coalesce(F.expr(f"try_cast(`{g}_Count` AS INT)"), F.lit(0)).alias("count"), F.coalesce(F.expr(f"try_cast(`{g}_Percentage` AS DOUBLE)"), F.lit(0.0)).alias("percentage")) for g in groups]
    return wide.select(F.col(category).alias("category"), F.inline(F.array(*cells)))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", compression: str | None = None) -> None:
    df.write.csv(path, mode=mode, header=True, compression=compression)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.json(path, mode=mode)


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append df as Parquet; fails if a key is there already. Returns the rows written.

    For one writer at a time: a plain folder of files has no lock. df is computed once for the check and once for the write.
    """
    spark = df.sparkSession
    try:
        there = spark.read.parquet(path).select(*keys)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = None
    if there is not None and df.join(there, keys, "left_semi").limit(1).count():
        raise ValueError("some keys are in the table already")
    before = spark.read.parquet(path).count() if there is not None else 0
    df.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON documents, one a line or one a file; without a schema Spark infers it."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def recovered(df: DataFrame, path: str, part: dict[str, str | int], keys: list[str], rows: int | None = None) -> tuple[DataFrame, bool]:
    """df from the stored part of a partitioned table if that is valid, else computed and written: (table, was there).

    part names the partition (column: value) of path. A stored part is valid if its keys are unique and it has `rows`
    rows, where given; one that is not is replaced. A write that was cut off has no success mark and counts as absent.
    """
    spark = df.sparkSession
    place = "/".join([path.rstrip("/"), *(f"{k}={v}" for k, v in part.items())])
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")):
        own = spark.read.parquet(place)
        n, distinct = own.agg(F.count("*"), F.count_distinct(F.struct(*keys))).first()
        if n == distinct and (rows is None or n == rows):
            return own, True
    df.drop(*part).write.mode("overwrite").parquet(place)
    return spark.read.parquet(place), False


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file, size_bytes and sha256 of every file below path; each is read by one task, none by the driver."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
