"""A result table with snapshots: a commit writes the files of its blocks only, and a log entry makes them the newest version of these blocks.

Layout below the root: `data/<attempt>` rows of a commit, `blocks/<attempt>` its distinct keys, `log/<version>.json` one line that names the
attempt. A log entry is created only if it does not exist, so of two writers one is first; the other compares its blocks with what came
in between: disjoint blocks go on as the next version, a block that both wrote is a conflict. Readers take a version and see
each block as the newest commit up to it wrote it; earlier versions stay readable. A full commit (compact) replaces all blocks,
and readers need no entry before it. What a broken writer left behind is in no log entry and is never read."""
from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("run_id", "dataset_id", "block_id")


class Conflict(RuntimeError):
    """Another writer has changed one of the blocks since the parent version."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a new file; False if it exists already."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    try:
        out = fs.create(p, False)
    except Exception:
        if fs.exists(p):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def history(spark: SparkSession, root: str) -> list[dict]:
    """Log entries by version: one line per commit."""
    fs, p = _fs(spark, f"{root}/log")
    if not fs.exists(p):
        return []
    rows = spark.read.schema("version long, parent long, attempt string, full boolean").json(f"{root}/log").collect()
    return sorted((r.asDict() for r in rows), key=lambda r: r["version"])


def _blocks(spark: SparkSession, root: str, entries: list[dict], keys) -> DataFrame:
    """keys, version of all blocks that these commits wrote."""
    out = None
    for e in entries:
        part = spark.read.parquet(f"{root}/blocks/{e['attempt']}").select(*keys, F.lit(e["version"]).alias("_version"))
        out = part if out is None else out.unionByName(part)
    return out


def commit(df: DataFrame, root: str, parent: int | None = None, keys=KEYS, full: bool = False) -> int:
    """Write `df` as the new contents of the blocks (keys) in it; returns the version. `parent`: the version the writer has read, the newest by default.
    With `full` every other block is gone."""
    spark, attempt = df.sparkSession, uuid.uuid4().hex
    log = history(spark, root)
    parent = (log[-1]["version"] if log else 0) if parent is None else parent
    df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).write.parquet(f"{root}/data/{attempt}")
    mine = spark.read.schema(df.schema).parquet(f"{root}/data/{attempt}").select(*keys).distinct()
    mine.write.parquet(f"{root}/blocks/{attempt}")
    mine, checked = spark.read.parquet(f"{root}/blocks/{attempt}"), parent
    while True:
        between = [e for e in history(spark, root) if e["version"] > checked]
        if between:
            if full or any(e["full"] for e in between) or not _blocks(spark, root, between, keys).join(mine, list(keys), "left_semi").isEmpty():
                raise Conflict(f"{root}: version {between[-1]['version']} has changed blocks of this commit, which was made from version {parent}")
            checked = between[-1]["version"]
        entry = {"version": checked + 1, "parent": parent, "attempt": attempt, "full": full}
        if _create(spark, f"{root}/log/{checked + 1:012d}.json", json.dumps(entry)):
            return checked + 1


def snapshot(spark: SparkSession, root: str, version: int | None = None, keys=KEYS) -> DataFrame:
    """The table as of a version (the newest by default). Commits are joined with the blocks they still hold; their data are read from their own files."""
    log = [e for e in history(spark, root) if version is None or e["version"] <= version]
    if not log:
        raise ValueError(f"{root}: no version")
    start = max((k for k, e in enumerate(log) if e["full"]), default=0)
    log = log[start:]
    data = None
    for e in log:
        part = spark.read.parquet(f"{root}/data/{e['attempt']}").withColumn("_version", F.lit(e["version"]))
        data = part if data is None else data.unionByName(part, allowMissingColumns=True)
    if len(log) == 1:
        return data.drop("_version")
    newest = _blocks(spark, root, log, keys).groupBy(*keys).agg(F.max("_version").alias("_version"))
    return data.join(newest, [*keys, "_version"], "left_semi").drop("_version")


def compact(spark: SparkSession, root: str, keys=KEYS) -> int:
    """The newest snapshot as one full commit."""
    newest = history(spark, root)[-1]["version"]
    return commit(snapshot(spark, root, newest, keys), root, newest, keys, full=True)
