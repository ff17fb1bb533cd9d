"""Shared helpers: tables, words, word hashes, bounded memos."""
from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Rows taken from an Arrow batch at a time, so that what Python holds stays small whatever the batch size is.
SLICE = 256


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Texts go to Python in Arrow batches of at most `rows`: what a worker holds at a time stays small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8: bytes.split() knows just these six separators."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_hashes(ws: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), dtype=np.uint64, count=len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser over 64 bits (shift, multiply, shift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(h: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Hash of each window of `length` consecutive word hashes; no entry for sequences shorter than a window."""
    n = len(h) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    lane = mix(h ^ np.uint64(seed))
    out = np.zeros(n, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15 ^ (seed << 1))
    for j in range(length):  # Horner's rule over all windows at once, modulo 2^64
        out = out * factor + lane[j : j + n]
        if j % 4 == 3:  # mixing in between keeps the low bits as good as the high ones
            out = mix(out)
    return mix(out)


def shingles(ws: list[bytes], width: int) -> np.ndarray:
    """Distinct hashed `width`-word shingles; a shorter sequence is one shingle, no word none."""
    if not ws:
        return np.empty(0, np.uint64)
    h = word_hashes(ws)
    return np.unique(window_hashes(h, min(width, len(ws)), min(width, len(ws))))


_owner: str | None = None
#: What frees the large caches of this worker process.
caches: list = []


def own_memory(owner: str) -> None:
    """Called where an operator starts to work in a Python worker: caches that another operator left in the process are freed, and what
    the allocators hold of them goes back to the system."""
    global _owner
    if _owner not in (None, owner):
        for clear in caches:
            clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim:
            trim(0)
    _owner = owner


class Memo(dict):
    """A mapping from strings that computes what it lacks and holds two generations of at most `cap` entries; keys of over 64 characters
    are not held."""

    def __init__(self, make, cap: int = 250_000):
        super().__init__()
        self.make, self.cap, self.old = make, cap, {}
        gc.set_threshold(200_000, 50, 100)  # the entries are no containers; scanning them over and over would cost more than the work

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > 64:
                return value
        if len(self) >= self.cap:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until no column of `df` has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def columns(df: DataFrame, *without: str) -> list:
    """Columns of `df` but those named."""
    return [df[f"`{c}`"] for c in df.columns if c not in without]
