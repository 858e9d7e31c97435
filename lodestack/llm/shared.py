"""Where the operators of this subpackage read tables and cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and all run on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestack-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the folder of this application's intermediate data, which lodestack.frames.clean_up() removes."""
    return f"{shared_dir(spark)}/lodestack-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df computed once and read from the shared folder from here on, so that lost executors cost nothing before it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def saved(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again; its size is then known to joins."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def packed(docs: DataFrame, *columns) -> DataFrame:
    """Some columns of docs, and all of them as the struct row, so that no name of theirs meets one that an operator adds."""
    return docs.select(*columns, F.struct("*").alias("row"))
