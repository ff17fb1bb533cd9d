"""Dropping lines that many documents have, by levelled sorted runs of line hashes.

LineRuns keeps, in the shared folder, sorted runs of (line hash, number of documents). A batch of documents comes as its own hashes with
counts. It merge-anti-joins the runs: hashes that have reached `least` documents are closed and need no further counting; what is left
becomes a run of level 0, sorted by hash. When a level holds `fanout` runs, they are merged into one run of the next level, so
b batches leave about log(b) runs. All runs of a store are dealt by the same hash into the same number of buckets, so merges
and anti-joins read bucket against bucket without a shuffle; a batch is shuffled once, after partial counts. With least = 1 a
run knows every line seen, and what add() returns are the lines that no earlier batch had.

The key of a line is the line without the six white-space characters at both ends, A-Z lower-cased; keys shorter than `chars` code points are
never dropped. Keys are told apart by 128 bits. Each text goes to Python twice: for its hashes, and with the closed hashes that it has, for what is
kept. In between only hashes move: (row, hash) pairs are joined with the closed hashes, both sides are stored tables, so
large partitions of a line that a third of all documents have may be split. A row is known by 64 bits of its key and
text; rows that are the same by chance only share closed hashes, which changes nothing.

A null or empty text is one empty line. Rows with one key count as one document, rows without a key as one document together. Repeated rows
stay. An empty table gives an empty result. Columns of the input stay, results get names that it has not.
"""
from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import shared_folder, stored
from .text import SLICE, columns, fresh

WHITE = b" \t\n\v\f\r"


def line_key(line: bytes) -> bytes:
    """bytes.lower() and bytes.strip() know ASCII alone."""
    return line.strip(WHITE).lower()


def _code_points(key: bytes, chars: int) -> bool:
    """Has the key at least `chars` code points?"""
    return len(key) >= chars and (len(key) >= 4 * chars or len(key.decode("utf-8", "surrogatepass")) >= chars)


def line_hashes(text: str | None, chars: int) -> list[bytes]:
    """128-bit hash of each line's key, b"" for keys that are too short to be dropped."""
    keys = map(line_key, (text or "").encode("utf-8", "surrogatepass").split(b"\n"))
    return [xxhash.xxh3_128_digest(k) if _code_points(k, chars) else b"" for k in keys]


class LineRuns:
    """Levelled sorted runs of (hi, lo, n): the two halves of a hash and the documents that have it. State on the driver: names of runs by level."""

    def __init__(self, spark: SparkSession, least: int, fanout: int = 2, buckets: int | None = None):
        if least < 1 or fanout < 2:
            raise ValueError("least must be 1 or more and fanout 2 or more")
        self.spark, self.least, self.fanout, self.levels = spark, least, fanout, []
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.made = 0
        self.folder = shared_folder(spark, "line-runs")
        self.prefix = "line_runs_" + self.folder.rpartition("-")[2]

    def _write(self, rows: DataFrame, level: int) -> DataFrame:
        """`rows` as a run of `level`, each bucket sorted by hash."""
        name, self.made = f"{self.prefix}_{self.made}", self.made + 1
        writer = rows.write.bucketBy(self.buckets, "hi", "lo").sortBy("hi", "lo").option("path", f"{self.folder}/{name}").option("compression", "zstd")
        writer.saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        """Largest first."""
        return [self.spark.table(name) for level in reversed(self.levels) for name in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Take a batch (hi, lo, n), n documents with the line; returns the sums by hash of those that were not closed before. The one
        shuffle of the sums deals them into the buckets as well, where the session's shuffle partitions are as many."""
        rows = lines.groupBy("hi", "lo").agg(F.sum("n").alias("n"))
        for run in self.runs():
            rows = rows.join(run.where(F.col("n") >= self.least), ["hi", "lo"], "left_anti")
        added = self._write(rows.select("hi", "lo", "n"), 0)
        self._compact()
        return added

    def _compact(self) -> None:
        for level in range(len(self.levels)):
            while len(self.levels[level]) >= self.fanout:
                names, self.levels[level] = self.levels[level][: self.fanout], self.levels[level][self.fanout :]
                self._write(self._merged([self.spark.table(n) for n in names]), level + 1)
        # merged runs stay on disk until the store is dropped: what add() has returned may still be read from them

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """Counts of runs summed by hash: a full outer merge of sorted buckets, so nothing is shuffled."""
        out = runs[0]
        for run in runs[1:]:
            other = run.withColumnRenamed("n", "m")
            out = out.join(other, ["hi", "lo"], "full_outer").select("hi", "lo", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return out

    def closed(self) -> DataFrame:
        """hi, lo of the hashes that at least `least` documents have."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], "hi long, lo long")
        return self._merged(runs).where(F.col("n") >= self.least).select("hi", "lo")

    def drop(self) -> None:
        """Forget the store; its files go with storage.release."""
        for k in range(self.made):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.prefix}_{k}")
        self.levels, self.made = [], 0


def _slices(batches):
    """Few rows at a time, so that what Python holds stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _pairs(batches, chars: int):
    """Batches of (row, key, text) -> row, key, hi, lo of each row's distinct hashes."""
    for batch in _slices(batches):
        row, key, text = batch.column(0), batch.column(1), batch.column(2)
        found = [set(line_hashes(t.as_py(), chars)) - {b""} for t in text]
        at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
        halves = np.frombuffer(b"".join(h for f in found for h in f), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([row.take(at), key.take(at), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], names=["row", "key", "hi", "lo"])


def _kept(batches, chars: int, names: list[str]):
    """Batches with the text and the closed hashes last -> without these, with n_lines, n_dropped, kept."""
    for batch in _slices(batches):
        lines_, dropped, kept = [], [], []
        for text, closed in zip(batch.column(-2), batch.column(-1), strict=True):
            t, gone = text.as_py() or "", closed.as_py()
            lines_.append(t.count("\n") + 1)
            if not gone:
                dropped.append(0)
                kept.append(t)
                continue
            gone = {r["hi"].to_bytes(8, "little", signed=True) + r["lo"].to_bytes(8, "little", signed=True) for r in gone}
            stay = [line for line, h in zip(t.split("\n"), line_hashes(t, chars), strict=True) if h not in gone]
            dropped.append(lines_[-1] - len(stay))
            kept.append("\n".join(stay))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(lines_, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], names=names)


def drop_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 10, chars: int = 1, batches: int = 4, fanout: int = 2) -> DataFrame:
    """All columns of `docs` and n_lines (before), n_dropped, kept (the text without lines that at least `least` documents have). The
    documents go through LineRuns in `batches` batches by a hash of their key."""
    row, found = fresh(docs, "row", "closed")
    spark = docs.sparkSession
    docs = docs.withColumn(row, F.xxhash64(F.col(key), F.coalesce(F.col(text), F.lit(""))))
    pairs = docs.select(row, key, text).mapInArrow(partial(_pairs, chars=chars), f"row long, key {docs.schema[key].dataType.simpleString()}, hi long, lo long")
    pairs = stored(pairs.withColumn("batch", F.pmod(F.hash("key"), F.lit(batches))))
    again = docs.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 OR key IS NULL").select("key")
    several = stored(again)
    repeated = not several.isEmpty()
    runs = LineRuns(spark, least, fanout)
    for k in range(batches):
        batch = pairs.where(F.col("batch") == k).select("key", "hi", "lo")
        if repeated:  # a document of several rows counts once
            same = batch["key"].eqNullSafe(several["key"])
            batch = batch.join(several, same, "left_anti").unionByName(batch.join(several, same, "left_semi").distinct())
        runs.add(batch.select("hi", "lo", F.lit(1).cast("long").alias("n")))
    closed = stored(runs.closed())
    have = pairs.select("row", "hi", "lo").join(closed, ["hi", "lo"], "left_semi").distinct()
    have = stored(have.groupBy("row").agg(F.collect_list(F.struct("hi", "lo")).alias(found)).withColumnRenamed("row", row))
    runs.drop()
    rest = [c for c in docs.columns if c != row]
    n_lines, n_dropped, kept = fresh(docs.select(*[f"`{c}`" for c in rest]), "n_lines", "n_dropped", "kept")
    joined = docs.join(have, row, "left")
    joined = joined.select(*columns(docs, row), docs[f"`{text}`"].alias(row), found)
    names = [*rest, n_lines, n_dropped, kept]
    schema = docs.select(*columns(docs, row)).withColumns({n_lines: F.lit(0).cast("long"), n_dropped: F.lit(0).cast("long"), kept: F.lit("")}).schema
    return joined.mapInArrow(partial(_kept, chars=chars, names=names), schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each document."""
    out = drop_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE key IN (SELECT key FROM common)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE key NOT IN (SELECT key FROM common)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id
"""
