"""Event-time windows over a stream of Parquet files, run until the files that are there are read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gridloom.operators.calendar import sessions, sliding, tumbling
from gridloom.sources.scratch import shared_dir

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def event_stream(spark: SparkSession, path: str, pattern: str = "*.parquet", delay: str = "1 hour") -> DataFrame:
    """The event files of a folder as a stream; events later than the watermark's delay are dropped by stateful operators."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 16).option("pathGlobFilter", pattern).parquet(path).withWatermark("ts", delay)


def windowed(stream: DataFrame, kind: str, keys: list[str], width: str, slide: str | None = None) -> DataFrame:
    if kind == "tumbling":
        return tumbling(stream, keys, "ts", width, "value")
    if kind == "sliding":
        return sliding(stream, keys, "ts", width, slide or width, "value")
    return sessions(stream, keys, "ts", width)


def run_to_end(result: DataFrame, mode: str = "complete") -> DataFrame:
    """The result table of a stream once all available input is read: the last batch's, written by the executors.

    Each batch of the complete mode replaces the table before it in the shared folder; in the append mode they add up."""
    spark = result.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    how = "overwrite" if mode == "complete" else "append"
    query = result.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").foreachBatch(lambda batch, _: batch.write.mode(how).parquet(f"{path}-rows")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{path}-rows")
