"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, SentencePiece encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontamination, line_dedup, ngram_join, quality_rules, sentencepiece_codec

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line field accept."""
    weights = quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.keep_good(docs.select(*COLUMNS), weights)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of repeated three-line windows; n_chars follows the text."""
    left = line_dedup.dedup_lines(docs, carry=("lang", "source"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return ngram_join.without_near_duplicates(docs).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and exact of each document."""
    import public_tokenizers  # only this stage needs the package of vocabulary files

    return sentencepiece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminated), ("SentencePiece encoding", encoded)]

#: SQL has no form of the line field and of the codec; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage but the last is written to the shared folder and read again.

    What a stage has written goes once the next one's table is there; only the last table stays, for the caller's clean_up().
    """
    from gridloom.llm.common import delete, leave, own_tables, written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept: list[str] = []
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with own_tables(spark) as tables:
            docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
            table = tables.pop()  # the stage's own table, written last
        delete(spark, kept)
        kept = [table]
    leave(kept)
    return STAGES[-1][1](spark, docs, sf_dir)
