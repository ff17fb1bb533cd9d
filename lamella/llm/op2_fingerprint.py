"""Document fingerprints by MinHash: k universal hash permutations over word shingles, bands joined in Spark, Jaccard verified.

A fingerprint is the smallest value of each of `K` permutations h -> (a h + b) mod 2^64 over the distinct shingles of the whole
text, as hexadecimal text. Of each smallest value 16 bits are kept, after mixing: its own top bits run to 0 as texts grow. The likeness of two fingerprints is the share of equal values, freed of the equal
values that chance gives. Equal texts have equal fingerprints. A text with fewer words than a shingle is one shingle; a null, empty or blank
text has a fingerprint of its own kind (no shingle), like itself and unlike all others.

`near` joins documents on equal bands of their fingerprints. Equal texts form one class whose smallest document stands for it; who meets
whom in a bucket is settled by graph.linked_in_buckets; the full shingle sets decide.
`with_next` pairs each document with its neighbour in key order by sorted ranges: no global window, one shuffle of the texts.

Repeated rows are fingerprinted each on its own. Rows without a key sort below all keys. An empty table gives an empty result.
"""
from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import linked_in_buckets, sketched
from .storage import picked, stored
from .text import SLICE, columns, fresh, mix, shingles, words

K, WIDTH, BANDS = 128, 5, 32
#: Target rows of a sorted range.
RANGE_ROWS = 1000


@lru_cache(maxsize=1)
def _family() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of the permutations, from a fixed seed."""
    rng = np.random.default_rng(19970509)
    return rng.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, K, dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of K 16-bit values; all sets are worked on at once, some thousand shingles at a time. Empty sets have all bits set."""
    a, b = _family()
    out = np.full((len(sets), K), 0xFFFF, np.uint16)
    some = [k for k, s in enumerate(sets) if len(s)]
    if some:
        low = np.full((len(some), K), np.iinfo(np.uint64).max, np.uint64)
        flat, owner = np.concatenate([sets[k] for k in some]), np.repeat(np.arange(len(some)), [len(sets[k]) for k in some])
        for at in range(0, len(flat), 4096):
            part, own = flat[at : at + 4096], owner[at : at + 4096]
            cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            least = np.minimum.reduceat(part[None] * a[:, None] + b[:, None], cut, axis=1)
            low[own[cut]] = np.minimum(low[own[cut]], least.T)
        out[some] = np.minimum(mix(low) >> np.uint64(48), 0xFFFE).astype(np.uint16)
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows of signatures, 0 to 1."""
    chance = 2.0**-16
    return np.clip(((x == y).mean(1) - chance) / (1 - chance), 0, 1)


def _set(text: str | None) -> np.ndarray:
    return shingles(words(text), WIDTH)


def _hex(rows: np.ndarray) -> list[str]:
    return [r.astype(">u2").tobytes().hex() for r in rows]


def _from_hex(column) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(column)), ">u2").reshape(-1, K)


def fingerprints(rows: DataFrame, **texts: str) -> DataFrame:
    """`rows` with one column more per given text column: fingerprints(rows, fingerprint="text"). Columns of these names are replaced."""
    names = list(texts)

    def run(*columns: pd.Series) -> pd.DataFrame:
        out = {n: [] for n in names}
        for at in range(0, len(columns[0]), SLICE):
            for n, c in zip(names, columns, strict=True):
                out[n] += _hex(signatures([_set(t) for t in c.iloc[at : at + SLICE]]))
        return pd.DataFrame(out, columns=names, dtype=object)

    made = F.pandas_udf(run, ", ".join(f"`{n}` string" for n in names))
    (new,) = fresh(rows, "made")
    out = rows.withColumn(new, made(*[F.col(c).cast("string") for c in texts.values()]))
    return out.select(*columns(out, new, *names), f"{new}.*")


def compared(a, b):
    """Column: likeness of two fingerprint columns; null where one is null."""
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out, both = np.full(len(x), np.nan), (x.notna() & y.notna()).to_numpy()
        if both.any():
            out[both] = likeness(_from_hex(x[both]), _from_hex(y[both]))
        return pd.Series(out)

    return F.pandas_udf(run, "double")(a, b)


def with_next(docs: DataFrame, carry=lambda rows: rows, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text and what `carry` adds, and next_<name> of each but the key: that of the next smaller key; for the smallest, of the largest.

    Split points cut the keys into ranges of about RANGE_ROWS rows (ids alone are read for that; the driver gets a row per range). Each
    range also gets a copy of the row that follows it, so every range is worked on by itself. Texts and what `carry` adds are shuffled once."""
    spark = docs.sparkSession
    low = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(low)).alias("_k"), F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.count(F.lit(1)), F.min("_k"), F.max("_k")).first()
    ranges = max(1, -(-total[0] // RANGE_ROWS))
    points = rows.select("_k").stat.approxQuantile("_k", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)) if ranges > 1 else []
    splits = sorted({int(p) for p in points} - {total[1]})  # range i: splits[i-1] <= key < splits[i]
    table = spark.sparkContext.broadcast(np.array(splits, np.int64))  # one number per RANGE_ROWS rows

    def range_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(table.value, k.to_numpy(np.int64), side="right").astype(np.int32))

    placed = F.pandas_udf(range_of, "int")
    tops = {r["part"]: r["top"] for r in rows.select(placed("_k").alias("part"), "_k").groupBy("part").agg(F.max("_k").alias("top")).collect()}
    after, below = [], total[2]  # what follows the smallest row of a range is the largest of the range below; of the lowest, the largest of all
    for part in sorted(tops):
        after.append((below, part))
        below = tops[part]
    copies = spark.createDataFrame(after, "_k long, _to int")  # a row per range
    firsts = Window.partitionBy("_k").orderBy("text")
    led = rows.join(F.broadcast(copies.select("_k").distinct()), "_k").withColumn("_n", F.row_number().over(firsts)).where("_n = 1").select("_k", "text")
    tail = led.join(F.broadcast(copies), "_k").select(F.col("_to").alias("_part"), F.lit(None).cast(docs.schema[key].dataType).alias(key), "_k", "text", F.lit(1).alias("_copy"))
    body = rows.select(placed("_k").alias("_part"), key, "_k", "text", F.lit(0).alias("_copy"))
    order = Window.partitionBy("_part").orderBy("_copy", F.desc("_k"), "text")
    dealt = carry(body.unionByName(tail))
    carried = [c for c in dealt.columns if c not in ("_part", "_k", "_copy", key)]
    led = dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried])
    return led.where("_copy = 0").select(key, *carried, *[f"next_{c}" for c in carried])


def near(docs: DataFrame, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, class, component for every document with words and a key: class is its smallest document of equal fingerprint and equal
    shingles, component the smallest document reached over links of at least `least` true Jaccard similarity."""
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    marked = stored(fingerprints(rows, fingerprint="text").select("doc", "fingerprint", F.sha2("text", 256).alias("same")).where(F.col("fingerprint") != "ffff" * K))
    classes = marked.groupBy("fingerprint", "same").agg(F.min("doc").alias("class"))
    member = marked.join(classes, ["fingerprint", "same"]).select("doc", "class")
    wide = 4 * K // BANDS
    keys = F.array(*[F.concat_ws(":", F.lit(i), F.substring("fingerprint", 1 + i * wide, wide)) for i in range(BANDS)])
    bands = classes.select(F.col("class").alias("doc"), F.explode(F.transform(keys, lambda k: F.xxhash64(k))).alias("band")).select("band", "doc")
    prints = classes.select(F.col("class").alias("doc"), "fingerprint")

    def prepare(wanted):
        texts = stored(picked(rows, wanted, ["doc"]))

        def screen(pairs):
            both = pairs.join(prints.toDF("a", "fa"), "a").join(prints.toDF("b", "fb"), "b")
            return both.where(compared(F.col("fa"), F.col("fb")) >= least - 5 * (least * (1 - least) / K) ** 0.5).select("a", "b")

        def confirm(pairs):
            both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
            return both.where(jaccard(F.col("ta"), F.col("tb")) >= least).select("a", "b")

        return screen, confirm, lambda ids: sketched(texts, ids, _set)

    found = linked_in_buckets(bands, prepare, least)
    return member.join(found.toDF("class", "component"), "class", "left").select("doc", "class", F.coalesce("component", "class").alias("component"))


def jaccard(a, b):
    """Column: true Jaccard similarity of the shingle sets of two text columns; 0 for two empty sets."""
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for s, t in zip(x, y, strict=True):
            p, q = _set(s), _set(t)
            common = len(np.intersect1d(p, q, assume_unique=True))
            out.append(common / max(1, len(p) + len(q) - common))
        return pd.Series(out, dtype=float)

    return F.pandas_udf(run, "double")(a, b)


def digests(docs: DataFrame) -> DataFrame:
    """The contract's row per document."""
    rows = with_next(docs, lambda rows: fingerprints(rows, fingerprint="text")).withColumn("_n", F.length("text")).withColumn("_half", F.expr("CAST(floor(_n / 2) AS INT)"))
    rows = rows.select("doc_id", F.col("_n").cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", F.expr("concat(substring(text, 1, _n - _half), substring(next_text, 1, _half))").alias("edited"))
    made = fingerprints(rows, edited_fingerprint="edited")
    return made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                       compared(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), compared(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
