"""Links between documents that share buckets, and connected components, in tables."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import spread_join
from .sketch import allowed, fine_sketch
from .storage import picked, stored

#: Rows of one side of a pair of blocks.
BLOCK = 2048


def components(edges: DataFrame) -> DataFrame:
    """`edges` (a, b) -> node, component: the smallest node that can be reached. Large and small stars in turn until nothing changes;
    the rounds grow with the logarithm of the longest chain. A hub's edges are spread over salted parts of the join."""
    salt = F.pmod(F.xxhash64("v"), F.lit(64))
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = spread_join(both, low, ["u"], salt).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(e, low, ["u"], salt)
        e = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def linked_in_buckets(rows: DataFrame, prepare: Callable[[DataFrame], tuple], least: float) -> DataFrame:
    """node, component of the documents that links connect. `rows`: band, doc, one per document and band. `prepare` gets the documents that
    meet any other (column doc) and returns three functions: `screen` and `confirm` of pairs (a, b), and `sketched`
    of documents, which gives doc, size of the set and its sketch.fine_sketch.

    First every member of a bucket meets one centre: the member that meets most others over all buckets; in a group of copies that is
    the text they were made of, so this links most of the group. What then lies outside of its centre's component meets
    the centre's other members by their fine sketches, block by block inside the tasks; only pairs that may reach `least`
    become rows and go to `confirm`. Every pair of a bucket is thus linked through others, ruled out or confirmed."""
    multi = stored(rows.join(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "band").select("band", "doc", "n"))
    meet = stored(multi.groupBy("doc").agg(F.sum(F.col("n") - 1).alias("weight")))
    screen, confirm, sketched = prepare(meet.select("doc"))
    weighed = multi.select("band", "doc").join(meet, "doc")
    centre = weighed.groupBy("band").agg(F.max(F.struct("weight", (-F.col("doc")).alias("minus"))).alias("c")).select("band", (-F.col("c.minus")).alias("centre"))
    family = stored(multi.select("band", "doc").join(centre, "band").where("doc <> centre").select("doc", "centre").distinct())
    tried = stored(screen(family.toDF("a", "b")))
    edges = stored(confirm(tried))
    part = components(edges)
    placed = family.join(part.toDF("doc", "own"), "doc", "left").join(part.toDF("centre", "mid"), "centre", "left")
    placed = stored(placed.select("doc", "centre", F.coalesce("own", "doc").alias("own"), (F.coalesce("own", "doc") != F.coalesce("mid", "centre")).alias("outside")))
    counts = placed.groupBy("centre").agg(F.count(F.lit(1)).alias("members"), F.count_if("outside").alias("outsiders")).where("outsiders > 0 AND members > 1")
    open_ = stored(placed.join(counts, "centre"))
    if open_.isEmpty():
        return part
    known = stored(sketched(open_.select("doc").distinct()))
    second = _across(open_.join(known, "doc"), least)
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = stored(confirm(stored(second.distinct().join(done, ["a", "b"], "left_anti"))))
    return part if more.isEmpty() else components(edges.unionByName(more))


def sketched(texts: DataFrame, ids: DataFrame, shingled: Callable[[str | None], np.ndarray]) -> DataFrame:
    """doc, size, sketch of the documents among `texts` (doc, text) that `ids` names."""
    def run(batches):
        for batch in batches:
            sets = [shingled(t) for t in batch["text"]]
            yield pd.DataFrame({"doc": batch["doc"].array, "size": [len(s) for s in sets], "sketch": [fine_sketch(s) for s in sets]})

    return picked(texts.select("doc", "text"), ids, ["doc"]).mapInPandas(run, "doc long, size long, sketch binary")


def _across(rows: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b), a < b, of an outsider and another member of one centre, of different components, that may reach `least`. Members and
    outsiders of a centre are dealt into blocks of about BLOCK rows; each pair of blocks is one bounded group."""
    blocks = rows.withColumn("no", F.ceil(F.col("outsiders") / BLOCK).cast("int")).withColumn("nm", F.ceil(F.col("members") / BLOCK).cast("int"))
    place = F.xxhash64("doc")
    out = blocks.where("outside").withColumn("o", F.pmod(place, "no").cast("int")).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("nm") - 1))).withColumn("asks", F.lit(True))
    all_ = blocks.withColumn("m", F.pmod(place, "nm").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("no") - 1))).withColumn("asks", F.lit(False))
    dealt = out.unionByName(all_).select("centre", "o", "m", "asks", "doc", "own", "outside", "size", "sketch")
    dealt = dealt.repartition("centre", "o", "m").sortWithinPartitions("centre", "o", "m")

    def compared(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy(bool)
        if not asks.any() or asks.all():
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        doc, own, outside, size = (group[c].to_numpy() for c in ("doc", "own", "outside", "size"))
        bits = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(len(group), -1)
        others, a, b = np.flatnonzero(~asks), [], []
        theirs = np.ascontiguousarray(bits[others])
        for k in np.flatnonzero(asks):
            hit = others[allowed(bits[k], theirs, size[k], size[others], least) & (own[others] != own[k]) & ~(outside[others] & (doc[others] < doc[k]))]
            a.append(np.minimum(doc[hit], doc[k]))
            b.append(np.maximum(doc[hit], doc[k]))
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    def run(batches):
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            keys = rows[["centre", "o", "m"]].to_numpy()
            cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist()] if len(keys) else []
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                yield compared(rows.iloc[x:y])
            held = rows.iloc[cut[-1] :] if cut else None  # the last group may go on in the next batch
        if held is not None:
            yield compared(held)

    return dealt.mapInPandas(run, "a long, b long")
