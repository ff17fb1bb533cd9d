"""Files that tasks write into, and read by range from, the shared folder of the cluster."""
from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Ids that may be broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
_made: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that spark.checkpoint.dir names."""
    _made.append(f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """`df` written as a compressed table in the shared folder and read again: computed once, its lineage cut, safe from lost executors."""
    folder = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def mark() -> int:
    """How many folders this process has made so far, for release()."""
    return len(_made)


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the folders that this process has made (those after a mark); results that read from them must be written before."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    while len(_made) > since:
        path = hadoop(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def few(ids: DataFrame) -> bool:
    """Can the ids be broadcast?"""
    return ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS


def picked(rows: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """The rows that have one of the ids, which are broadcast if they are few, else joined by a shuffle."""
    return rows.join(F.broadcast(ids) if few(ids) else ids, on, "left_semi")


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI (file, hdfs, s3, gs) or of a plain path."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


class RangeFile:
    """A file read by byte ranges."""

    def __init__(self, uri: str):
        system, path = opened(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()

    def read(self, start: int, length: int) -> bytes:
        data = self.file.read_at(length, start)
        if len(data) != length:
            raise EOFError(f"{length} bytes at {start}: only {len(data)} there")
        return data

    def close(self) -> None:
        self.file.close()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


def created(uri: str):
    """Output stream for a new file; its folder is made. A task writes under a name of its own attempt, so that a retry or a copy
    of the task never touches it; readers take only files that a finished task has named in the manifest."""
    system, path = opened(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path)
