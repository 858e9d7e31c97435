"""A folder tree as a corpus, hidden files and names that start with _ included, which Spark's file sources leave out."""

from __future__ import annotations

import codecs
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestack.frames import cut

SNIFF = 2048
#: Files that one task reads, folders that it lists, and tasks of a job at most.
FILES_PER_TASK, FOLDERS_PER_TASK, MOST_TASKS = 200, 50, 20_000
SCHEMA = "path string, is_text boolean, content string, size bigint"


def is_text(start: bytes) -> bool:
    """No NUL, and UTF-8 but for a character that the end may cut."""
    try:
        codecs.getincrementaldecoder("utf-8")().decode(start, final=False)
    except UnicodeDecodeError:
        return False
    return b"\0" not in start


def _listed(root: str, skip: tuple[str, ...]):
    """What folders (paths from root) hold: folders, without those of skipped names, and regular files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = os.path.realpath(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found, is_folder = [], []
                with os.scandir(os.path.join(root, folder)) as entries:
                    for e in entries:
                        own = e.is_dir(follow_symlinks=False)
                        if own and e.name in skip or not own and not e.is_file():
                            continue
                        if not own and e.is_symlink() and os.path.commonpath([top, os.path.realpath(e.path)]) != top:
                            raise ValueError(f"{e.path} leads out of {root}")
                        found.append(f"{folder}/{e.name}" if folder else e.name)
                        is_folder.append(own)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(is_folder)], ["path", "is_folder"])

    return run


def _read(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():  # a file at a time: any of them may be long
                with open(os.path.join(root, name), "rb") as f:
                    start = f.read(SNIFF)
                    text = is_text(start)
                    content = (start + f.read()).decode("utf-8", "replace").replace("\r\n", "\n") if text else None
                    size = os.fstat(f.fileno()).st_size
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([text]), pa.array([content], pa.string()), pa.array([size], pa.int64())], ["path", "is_text", "content", "size"])

    return run


def folder_files(spark: SparkSession, root: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """path of every regular file under root, which all machines must see; skip: names of folders that are not even listed.

    A job for each level of the tree lists its folders in tasks, so no file passes through the driver. A link to
    a file outside root is an error; links to folders are not followed.
    """
    level, found = spark.createDataFrame([("",)], "path string"), []
    while True:
        listed = cut(level.mapInArrow(_listed(root, skip), "path string, is_folder boolean"))
        found.append(listed.where("not is_folder").select("path"))
        level = listed.where("is_folder").select("path")
        folders = level.count()
        if not folders:
            break
        level = level.repartition(min(-(-folders // FOLDERS_PER_TASK), MOST_TASKS))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def folder_corpus(spark: SparkSession, root: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """path, is_text, content (null for binary files) and size of folder_files()."""
    files = folder_files(spark, root, skip)
    tasks = min(max(1, -(-files.count() // FILES_PER_TASK)), MOST_TASKS)
    return files.repartition(tasks, "path").mapInArrow(_read(root), SCHEMA)
