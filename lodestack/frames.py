"""Reading tables, cutting lineage into the folder that a cluster shares, and texts in any store that Spark knows."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a temporary one only where none is named and all run on one machine."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not found.isDefined():
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestack-"))
    return (named or sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables; clean_up() removes it."""
    return f"{shared_dir(spark)}/lodestack-{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Removes what saved() and its like have written in this application; results that still read it must be written first."""
    store, found = _store(spark, run_dir(spark))
    store.delete(found, True)


def cut(df: DataFrame) -> DataFrame:
    """df computed once, kept where lost executors don't matter; loops call it each round."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt over all cores by a key that few of them share, for what costs more by the row than by the byte: a small file is one task, however many rows it has."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def saved(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again; its size is then known to joins."""
    path = f"{run_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _store(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def make_folder(spark: SparkSession, path: str) -> None:
    """A new folder; raises if it is there."""
    store, found = _store(spark, path)
    if store.exists(found):
        raise FileExistsError(path)
    store.mkdirs(found)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in a small folder."""
    store, found = _store(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(found) if f.isFile())


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """A new small file; FileExistsError if there is one, whoever made it."""
    store, found = _store(spark, path)
    try:
        out = store.create(found, False)
    except Py4JJavaError as e:
        if store.exists(found):
            raise FileExistsError(path) from e
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, replaced as a whole; a crash in between may leave none, so it is for copies of what is kept elsewhere."""
    store, found = _store(spark, path)
    _, draft = _store(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = store.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if store.exists(found):
        store.delete(found, False)
    if not store.rename(draft, found):
        raise OSError(f"{draft} could not be renamed to {path}")
