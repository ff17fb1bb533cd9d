"""Packing token ids into sequences by multiway differencing (Karmarkar and Karp).

A document is its ids and one end id. Whole windows are cut off its front; what is left is cut into pieces of at most `grain` ids.
A task pools pieces until they fill `windows` sequences but for a margin. The last 1/32 of a pool is cut into pieces of `fine` ids, which
level what the large ones leave uneven. The pool is split by differencing: partial partitions wait in a heap, keyed by the imbalance between their fullest and emptiest window; the two with the largest imbalances are merged so
that the full windows of one meet the empty windows of the other. If a window comes out above the capacity, the split is
made anew with one window more. Pools are local to a task and of fixed size; nothing is shuffled and no key gathers rows.

A null text counts as empty: one end id. Equal rows are packed each on its own. `sequence_id` is unique in the result.
"""
from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import SLICE
from .tokens import encoder

#: Sequence numbers of one task lie in a range of this size.
TASK_RANGE = 1 << 38


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Item numbers per window (the empty windows left out), sums as equal as differencing gets them."""
    heap = [(-s, k, [(s, [k])]) for k, s in enumerate(sizes)]
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free = windows - len(b)  # windows of b that are still empty meet the fullest of a
        merged = a[:free]
        for k, (s, items) in enumerate(a[free:]):
            s2, items2 = b[len(b) - 1 - k]
            merged.append((s + s2, items + items2))
        merged += b[: max(0, len(b) - max(0, len(a) - free))]
        merged.sort(key=lambda w: -w[0])
        low = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (low - merged[0][0], turn, merged))
        turn += 1
    return [items for _, items in heap[0][2]] if heap else []


def fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """As few near-equal windows as differencing gets below the capacity. Every size must be at most the capacity."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        split = differencing(sizes, windows)
        if all(sum(sizes[k] for k in w) <= capacity for w in split):
            return split
        windows += 1


class Packer:
    """Packs the documents of one task; rows are (doc number, start, length, sequence, offset)."""

    def __init__(self, capacity: int, windows: int, grain: int, fine: int, margin: int):
        self.capacity, self.full, self.grain, self.fine = capacity, windows * (capacity - margin), grain, fine
        self.coarse = self.full - self.full // 32
        self.pool: list[tuple] = []
        self.held, self.next = 0, 0

    def add(self, doc, total: int):
        start = 0
        while total - start >= self.capacity:
            yield doc, start, self.capacity, self.next, 0
            self.next += 1
            start += self.capacity
        while start < total:
            most, room = (self.grain, self.coarse) if self.held < self.coarse else (self.fine, self.full)
            n = min(most, total - start, room - self.held)
            self.pool.append((doc, start, n))
            self.held += n
            start += n
            if self.held == self.full:
                yield from self.flush()

    def rest(self):
        """The last, unfilled pool; its last pieces are made fine as well."""
        pool, self.pool, fine = self.pool, [], self.held // 32
        while pool and fine > 0:
            doc, start, n = pool.pop()
            self.pool += [(doc, start + k, min(self.fine, n - k)) for k in range(0, n, self.fine)]
            fine -= n
        self.pool = pool + self.pool
        yield from self.flush()

    def flush(self):
        for window in fit([p[2] for p in self.pool], self.capacity):
            offset = 0
            for k in window:
                doc, start, n = self.pool[k]
                yield doc, start, n, self.next, offset
                offset += n
            self.next += 1
        self.pool, self.held = [], 0


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, windows: int = 32, grain: int = 256, fine: int = 4, margin: int = 3, text: str = "text", key: str = "doc_id", held: int = 700_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset. `held`: see tokens.encoder."""
    if not 0 < fine <= grain <= capacity or not 0 <= margin < capacity:
        raise ValueError("0 < fine <= grain <= capacity and 0 <= margin < capacity")
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc, packer = encoder(path, "byte", held), Packer(capacity, windows, grain, fine, margin)
        first = TaskContext.get().partitionId() * TASK_RANGE
        names = [f.split(" ")[0] for f in schema.split(", ")]
        key_type = None

        def made(pieces):
            rows = [(d[0], s, n, d[1][4 * s : 4 * (s + n)], len(d[1]) // 4, first + q, o) for d, s, n, q, o in pieces]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [key_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            key_type = batch.column(0).type
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = enc.encode(part.column(1).to_pylist())
                yield made([p for k, i in zip(part.column(0).to_pylist(), ids, strict=True) for p in packer.add((k, i + end), len(i) // 4 + 1)])
        if packer.pool:
            yield made(packer.rest())

    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, held: int = 700_000) -> DataFrame:
    """The contract's row per piece."""
    return pack(docs, path, held=held).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
