"""Near-duplicate documents by MinHash bands, odd sketches and exact sets.

A text's set is its distinct word shingles. Texts with equal sets form a class, of which only the smallest document takes part
in the search. `k` MinHash values per set give bands (fixed choices of `rows` of the k values); documents with an equal band
meet in a bucket. The odd sketch folds the k values into a bitmap of parities; the bits in which two sketches differ
estimate how many of the values differ, most exactly where sets are alike, so pairs far below the limit never reach their texts.
What passes is confirmed on the full sets.

Buckets are not compared all against all, see graph.linked_in_buckets: a group of n copies costs about n comparisons, and every pair of
a bucket is either compared or linked through others. Bands miss a pair of exactly the limit with probability below 1e-4.

A text without words has an empty set and is linked with nothing. Rows that share a key count as one document that is linked with what any
of them is like. A row without a key is its own, with a null component. An empty table gives an empty result.
"""
from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import linked_in_buckets, sketched
from .storage import picked, stored
from .text import SLICE, mix, own_memory, shingles, words

K, BITS, BANDS, ROWS = 128, 512, 56, 6


@lru_cache(maxsize=1)
def _family() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of the hash permutations, and the values in each band; from a fixed seed."""
    rng = np.random.default_rng(20240607)
    a = rng.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, K, dtype=np.uint64)
    return a[:, None], b[:, None], np.array([rng.choice(K, ROWS, replace=False) for _ in range(BANDS)])


def signature(s: np.ndarray) -> np.ndarray:
    """K MinHash values of 32 bits of a non-empty set."""
    a, b, _ = _family()
    low = np.full(K, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(s), 1024):
        low = np.minimum(low, ((s[None, at : at + 1024] * a + b) >> np.uint64(32)).min(1))
    return low.astype(np.uint32)


def odd_sketch(signatures: np.ndarray) -> np.ndarray:
    """Parity bitmaps (rows of BITS / 8 bytes) of rows of MinHash values: each value flips the bit that it and its place hash to."""
    n = len(signatures)
    place = (np.arange(K, dtype=np.uint64) << np.uint64(32))[None]
    spots = (mix(signatures.astype(np.uint64) | place) % np.uint64(BITS)).astype(np.int64) + np.arange(n)[:, None] * BITS
    return np.packbits((np.bincount(spots.ravel(), minlength=n * BITS) & 1).astype(np.uint8).reshape(n, BITS), axis=1)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from rows of two sketches: of K values 2 K (1 - J) stand in one sketch alone, and m of these leave about
    BITS (1 - exp(-2 m / BITS)) / 2 bits different."""
    z = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
    with np.errstate(divide="ignore"):
        alone = np.where(2 * z < BITS, -BITS / 2 * np.log(np.maximum(1 - 2 * z / BITS, 1e-300)), np.inf)
    return 1 - alone / (2 * K)


def _set(text: str | None, width: int) -> np.ndarray:
    ws = words(text)
    return shingles([w.lower() for w in ws], width)  # bytes.lower() maps A-Z alone


def described(docs: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """doc, n, d1, d2 (128-bit digest of the set), sig, sketch; one row per document."""
    def run(batches):
        own_memory("near duplicates")
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.iloc[at : at + SLICE]
                sets = [_set(t, width) for t in part["text"]]
                some = [k for k, s in enumerate(sets) if len(s)]
                sigs = np.array([signature(sets[k]) for k in some], np.uint32).reshape(len(some), K)
                sk = odd_sketch(sigs)
                out = pd.DataFrame({"doc": part["doc"].array, "n": [len(s) for s in sets], "d1": 0, "d2": 0, "sig": None, "sketch": None})
                digests = [xxhash.xxh3_128_digest(sets[k].tobytes()) for k in some]
                half = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
                d1, d2, s1, s2 = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64), [None] * len(sets), [None] * len(sets)
                d1[some], d2[some] = half[:, 0], half[:, 1]
                for r, k in enumerate(some):
                    s1[k], s2[k] = sigs[r].tobytes(), sk[r].tobytes()
                yield out.assign(d1=d1, d2=d2, sig=pd.Series(s1, dtype=object), sketch=pd.Series(s2, dtype=object))

    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(run, "doc long, n long, d1 long, d2 long, sig binary, sketch binary")


def band_rows(reps: DataFrame) -> DataFrame:
    """band, doc: one row per document and band."""
    def run(batches):
        _, _, places = _family()
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.iloc[at : at + 2048]
                sig = np.frombuffer(b"".join(part["sig"]), np.uint32).reshape(-1, K).astype(np.uint64)
                h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS)).copy()
                for r in range(ROWS):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, places[:, r]])
                yield pd.DataFrame({"band": h.ravel().view(np.int64), "doc": np.repeat(part["doc"].to_numpy(), BANDS)})

    return reps.select("doc", "sig").mapInPandas(run, "band long, doc long")


def _alike(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches allow `percent`: estimates spread by the MinHash sample's deviation, of which five are granted."""
    j = percent / 100
    least = j - 5 * (j * (1 - j) / K) ** 0.5

    def run(batches):
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(len(batch), -1) for c in ("sa", "sb"))
                yield batch.loc[estimate(x, y) >= least, ["a", "b"]]

    both = pairs.join(sketches.select(F.col("doc").alias("a"), F.col("sketch").alias("sa")), "a").join(sketches.select(F.col("doc").alias("b"), F.col("sketch").alias("sb")), "b")
    return both.mapInPandas(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of which the full sets have at least `percent` of their union in common."""
    def run(batches):
        last, known = None, None
        for batch in batches:
            keep = []
            for b, ta, tb in zip(batch["b"], batch["ta"], batch["tb"], strict=True):
                x = _set(ta, width)
                if last != (b, tb):
                    last, known = (b, tb), _set(tb, width)
                common = len(np.intersect1d(x, known, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(known) - common))
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    both = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b")
    return both.mapInPandas(run, "a long, b long")


def linked(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, n_shingles, component: one row per row of `docs`."""
    seen = stored(described(docs, width, key, text))
    some = seen.where("n > 0 AND doc IS NOT NULL")
    classes = stored(some.groupBy("d1", "d2").agg(F.min("doc").alias("rep")))  # so that joins on it are of two plain shuffles, whose large partitions may be split
    reps = some.join(classes, ["d1", "d2"]).where("doc = rep").dropDuplicates(["d1", "d2"]).select("doc", "sig", "sketch")

    def prepare(wanted):
        texts = stored(picked(docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text")), wanted, ["doc"]))
        sketches = stored(picked(reps.select("doc", "sketch"), wanted, ["doc"]))
        return lambda pairs: _alike(pairs, sketches, percent), lambda pairs: _confirmed(pairs, texts, width, percent), lambda ids: sketched(texts, ids, lambda t: _set(t, width))

    final = linked_in_buckets(band_rows(reps), prepare, percent / 100)
    member = seen.where("doc IS NOT NULL").join(classes, ["d1", "d2"], "left").select("doc", "n", F.when(F.col("n") > 0, F.coalesce("rep", "doc")).otherwise(F.col("doc")).alias("rep"))
    nulls = seen.where("doc IS NULL").select("doc", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component"))
    out = member.join(final.toDF("rep", "component"), "rep", "left").select("doc", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component"))
    return out.unionByName(nulls)


def keep(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group: the smallest. Same columns as `docs`; rows without a key and rows that share one stay."""
    lost = linked(docs, width, percent).where("doc <> component").select(F.col("doc").alias("doc_id")).distinct()
    return docs.join(lost, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def components_of(docs: DataFrame) -> DataFrame:
    """The contract's row per document: two-word shingles."""
    out = linked(docs, width=2)
    return out.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc") == F.col("component"), F.lit(True)).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
c AS (SELECT min(doc_id) AS rep, list_sort(s) AS s, row_number() OVER () AS cls FROM s WHERE len(s) > 0 GROUP BY list_sort(s)),
e AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM c),
p AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.rep, b.rep HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT rep AS node, rep AS reach FROM c UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
k AS (SELECT node, min(reach) AS comp FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(k.comp, s.doc_id) AS component_id, coalesce(k.comp, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON len(s.s) > 0 AND list_sort(s.s) = c.s LEFT JOIN k ON k.node = c.rep
"""
