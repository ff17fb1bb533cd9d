"""Token ids in binary shards with a minimal perfect hash index.

A shard is two files. `.bin` holds nothing but ids, little-endian, 2 or 4 bytes each, documents in ascending key order. `.idx`
maps a key to its record: levels of bit maps send n distinct keys to the numbers 0 .. n-1 without storing them; a 32-bit fingerprint
per number tells keys that are not there; a record number leads to the offset. One lookup takes a fixed number of steps in
the mean, whatever the size. The sorted keys lie at the end of the index, for walks over a shard only.

Documents are dealt out by key ranges, so a shard is a sorted run and shards follow each other; only shards' totals meet at the driver
(one row per shard of up to `shard_bytes`) for the running start. Tasks write under attempt names, see storage.created.

A null text counts as empty: the end id alone. Rows without a key cannot be looked up; they are written behind all others, into shards of
their own, and a walk finds them (key null, ordered by text within a shard). Rows that share a key are all written, ordered
by text; a lookup finds the first, a walk finds all.
"""
from __future__ import annotations

import struct
import uuid

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import RangeFile, created, shared_folder
from .text import SLICE, mix
from .tokens import encoder

MAGIC = b"LAMTID01"
GAMMA = 1.6


def _spots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xA24BAED4963EE407 * (level + 1) & (2**64 - 1))) % np.uint64(size)).astype(np.int64)


def _prints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys + np.uint64(0x9FB21C651E98DF25)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Levels of bit maps: a key sits at the first level where it is alone on its spot; its number is the rank of that bit."""

    def __init__(self, levels: list[tuple[int, np.ndarray]]):
        self.levels, self.ranks, base = levels, [], 0
        for _, bits in levels:
            below = np.cumsum(np.bitwise_count(bits).astype(np.int64))
            self.ranks.append(np.concatenate([[0], below[:-1]]) + base)
            base += int(below[-1])
        self.n = base

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest = [], keys
        while len(rest):
            size = -(-max(64, int(GAMMA * len(rest))) // 64) * 64
            at = _spots(rest, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append((size, np.packbits(alone, bitorder="little").view("<u8")))
            rest = rest[~alone[at]]
            if len(levels) > 200:
                raise ValueError("the keys are not distinct")
        return cls(levels)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """A number below n for each key; -1 for a key that no level takes, an arbitrary number for other strangers."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, ((size, bits), ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = _spots(keys[open_], level, size)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            under = np.bitwise_count(bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = (ranks[word] + under)[hit]
            open_ = open_[~hit]
        return out


def index_bytes(keys: np.ndarray, lengths: np.ndarray, width: int) -> bytes:
    """The index file of sorted keys (repeats allowed) and their lengths in ids."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    distinct, first = np.unique(keys, return_index=True)
    u = distinct.astype(np.int64).view(np.uint64)
    mph = PerfectHash.build(u)
    order = mph.numbers(u)
    prints, records = np.empty(len(u), "<u4"), np.empty(len(u), "<u4")
    prints[order], records[order] = _prints(u), first
    head = MAGIC + struct.pack("<IIQQ", width, len(mph.levels), len(u), len(keys))
    body = b"".join(struct.pack("<Q", size) + bits.tobytes() for size, bits in mph.levels)
    return head + body + prints.tobytes() + records.tobytes() + offsets.tobytes() + keys.astype("<i8").tobytes()


class Shard:
    """Keyed access to one shard."""

    def __init__(self, base: str):
        with RangeFile(base + ".idx") as f:
            raw = f.read(0, f.size)
        if raw[:8] != MAGIC:
            raise ValueError(f"{base}: not an id index")
        self.width, n_levels, n, n_records = struct.unpack_from("<IIQQ", raw, 8)
        at, levels = 32, []
        for _ in range(n_levels):
            (size,) = struct.unpack_from("<Q", raw, at)
            levels.append((size, np.frombuffer(raw, "<u8", size // 64, at + 8)))
            at += 8 + size // 8
        self.mph = PerfectHash(levels)
        self.prints = np.frombuffer(raw, "<u4", n, at)
        self.records = np.frombuffer(raw, "<u4", n, at + 4 * n)
        self.offsets = np.frombuffer(raw, "<u8", n_records + 1, at + 8 * n)
        self.keys = np.frombuffer(raw, "<i8", n_records, at + 8 * n + 8 * (n_records + 1))
        self.payload = RangeFile(base + ".bin")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Record number of each key, -1 where the shard does not hold it."""
        u = np.asarray(keys, np.int64).view(np.uint64)
        number = self.mph.numbers(u)
        known = number >= 0
        known[known] = self.prints[number[known]] == _prints(u[known])
        out = np.full(len(u), -1, np.int64)
        out[known] = self.records[number[known]]
        return out

    def ids(self, first: int, last: int | None = None) -> np.ndarray:
        """Ids of the records first .. last-1 (one record by default), as unsigned 32-bit."""
        a, b = int(self.offsets[first]), int(self.offsets[first + 1 if last is None else last])
        return np.frombuffer(self.payload.read(a * self.width, (b - a) * self.width), f"<u{self.width}").astype("<u4")

    def close(self) -> None:
        self.payload.close()


def write(docs: DataFrame, path: str, end_id: int, folder: str, shard_bytes: int = 1 << 26, width: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode and write all documents below `folder`; returns the stored manifest: shard, first_key (null for rows without a key), n_records, n_ids."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches, keyed: bool = True):
        enc, task = encoder(path, "word"), TaskContext.get()
        base = f"{folder}/shards/{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        out, keys, lengths, held, count, serial = None, [], [], 0, 0, 0

        def closed():
            out.close()
            k, n = np.array(keys, np.int64), np.array(lengths, np.int64)
            with created(f"{base}-{count}.idx") as f:
                f.write(index_bytes(k, n, width))
            return pd.DataFrame({"shard": [f"{base}-{count}"], "first_key": pd.array([int(k[0]) if keyed else None], "Int64"), "n_records": [len(k)], "n_ids": [int(n.sum())]})

        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.iloc[at : at + SLICE]
                numbers = part["doc_id"].tolist() if keyed else range(serial, serial + len(part))  # rows without a key are numbered through
                serial += len(part)
                for k, i in zip(numbers, enc.encode(part["text"].tolist()), strict=True):
                    if out is not None and held >= shard_bytes and k != keys[-1]:
                        yield closed()
                        out, keys, lengths, held, count = None, [], [], 0, count + 1
                    if out is None:
                        out = created(f"{base}-{count}.bin")
                    ids = np.frombuffer(i + end, "<u4")
                    if width == 2 and int(ids.max()) > 0xFFFF:
                        raise ValueError("an id needs more than two bytes; write with width=4")
                    out.write(ids.astype(f"<u{width}").tobytes())
                    keys.append(k)
                    lengths.append(len(ids))
                    held += width * len(ids)
        if out is not None:
            yield closed()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    manifest = "shard string, first_key long, n_records long, n_ids long"
    made = rows.where("doc_id IS NOT NULL").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInPandas(run, manifest)
    loose = rows.where("doc_id IS NULL").repartition(F.xxhash64("text")).sortWithinPartitions("text").mapInPandas(lambda batches: run(batches, False), manifest)
    made.unionByName(loose).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def numbered(shard: Shard, name: str) -> np.ndarray:
    """The record number that the hash gives for each stored key; the rows of a repeated key follow its first. Each record has to be reached once, by its key."""
    record = shard.find(shard.keys)
    if (record < 0).any():
        raise ValueError(f"{name}: the index does not lead to its records")
    _, first, which = np.unique(shard.keys, return_index=True, return_inverse=True)
    record = record + np.arange(len(record)) - first[which]
    if (np.sort(record) != np.arange(len(record))).any() or (shard.keys[record] != shard.keys).any():
        raise ValueError(f"{name}: the index does not lead to its records")
    return record


def walk(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Read every record back through the index: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit)."""
    shards, start = [], 0
    for r in sorted(manifest.collect(), key=lambda r: (r.first_key is None, r.first_key or 0, r.shard)):  # one row per shard
        shards.append((r.shard, start, r.first_key is not None))
        start += r.n_ids

    def run(batches):
        for batch in batches:
            for name, base, keyed in zip(batch["shard"], batch["base"], batch["keyed"], strict=True):
                shard = Shard(name)
                record = numbered(shard, name)
                for at in range(0, len(record), SLICE):
                    mine = record[at : at + SLICE]
                    low, high = int(mine.min()), int(mine.max()) + 1
                    ids = shard.ids(low, high)
                    begin, end = shard.offsets[mine].astype(np.int64), shard.offsets[mine + 1].astype(np.int64)
                    base_of = int(shard.offsets[low])
                    cut = [ids[a:b].tobytes() for a, b in zip(begin - base_of, end - base_of, strict=True)]
                    keys = shard.keys[at : at + SLICE]
                    yield pd.DataFrame({"doc_id": keys if keyed else pd.array([None] * len(keys), "Int64"), "start": base + begin, "n_tokens": end - begin, "ids": cut})
                shard.close()

    frame = spark.createDataFrame(shards, "shard string, base long, keyed boolean")
    return frame.repartition(max(1, len(shards))).mapInPandas(run, "doc_id long, start long, n_tokens long, ids binary")


def lookup(keys: DataFrame, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ids of the given keys: each key goes to the shard whose range holds it, one constant-time step finds the record there. Keys
    that no shard holds get null ids."""
    rows = sorted((r.first_key, r.shard) for r in manifest.where("first_key IS NOT NULL").collect())
    firsts, names = np.array([f for f, _ in rows], np.int64), [n for _, n in rows]

    def run(batches):
        shards: dict[int, Shard] = {}
        for batch in batches:
            k = batch["doc_id"].to_numpy(np.int64)
            at = np.searchsorted(firsts, k, side="right") - 1
            out: list = [None] * len(k)
            for s in np.unique(at[at >= 0]):
                if s not in shards:
                    shards = {s: Shard(names[s])}
                mine = np.flatnonzero(at == s)
                for j, record in zip(mine, shards[s].find(k[mine]), strict=True):
                    if record >= 0 and shards[s].keys[record] == k[j]:
                        out[j] = shards[s].ids(record).tolist()
            yield pd.DataFrame({"doc_id": k, "ids": out})

    rows_ = keys.select(F.col(key).cast("long").alias("doc_id")).where("doc_id IS NOT NULL")
    return rows_.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInPandas(run, "doc_id long, ids array<long>")


def digests(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """The contract's row per document, read back from the files."""
    spark = docs.sparkSession
    return walk(spark, write(docs, path, end_id, shared_folder(spark, "token-ids"))).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


__all__ = ["PerfectHash", "Shard", "digests", "index_bytes", "lookup", "walk", "write"]
