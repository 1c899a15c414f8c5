"""Cutting lineage in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session without one gets its own, on a cluster that is an error."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if not path and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = path or tempfile.mkdtemp(prefix="gridloom-")
    if not known.isDefined():
        context.setCheckpointDir(path)
    return path.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df by checkpoint() in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def tables(spark: SparkSession):
    """store(df): df as a Parquet table in the shared folder, for this block only; drop(df) deletes one before its end.

    A checkpoint carries its plan's guess of its size on, and a join's guess is the product of its sides', so that over rounds
    of joins the guess is a number of more and more digits, which fills the driver. A table has the size of its files.
    """
    paths: dict[int, tuple[DataFrame, str]] = {}

    def store(df: DataFrame) -> DataFrame:
        path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
        paths[id(out)] = out, path
        return out

    def drop(df: DataFrame) -> None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop(id(df))[1])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    try:
        yield store, drop
    finally:
        for df, _ in list(paths.values()):
            drop(df)
