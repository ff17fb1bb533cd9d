"""Holdout partition (train / val / test) per dataset, in closed form.

The rule gives each new block, in hash order, to the partition with the largest remaining deficit (train wins ties, then
val, then test). Deficits d1 >= d2 >= d3 therefore fill in three phases: only the largest until it equals the second, then
the two alternate, then all three rotate. The partition of the k-th block is a formula of k and the three deficits."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import ordinal, spread_join
from .sampling import hash_bucket, seeded_hash

PARTITIONS = ("train", "val", "test")
USABLE = ("A", "B", "C")


def parse_ratios(spec) -> tuple[float, float, float]:
    """Shares of train, val and test from "8:1:1", "0.8, 0.1, 0.1" or three numbers; they may be given in any unit."""
    weights = [float(w) for w in (re.findall(r"[^\s,:]+", spec) if isinstance(spec, str) else spec)]
    total = sum(weights)
    if len(weights) != len(PARTITIONS) or any(w < 0 for w in weights) or not total > 0:
        raise ValueError(f"three non-negative shares are needed, one each for {', '.join(PARTITIONS)}")
    train, val, test = (w / total for w in weights)
    return train, val, test


def target_columns(n: Column, ratios) -> dict[str, Column]:
    """Largest-remainder targets; val and test get at least one block once there are three."""
    r = dict(zip(PARTITIONS, ratios))
    raw = {p: n * F.lit(r[p]) for p in PARTITIONS}
    floor = {p: F.floor(raw[p]).cast("long") for p in PARTITIONS}
    frac = {p: raw[p] - floor[p] for p in PARTITIONS}
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    base = {"train": floor["train"]}
    for p in ("val", "test"):
        base[p] = F.greatest(floor[p], one) if r[p] > 0 else floor[p]
    over = F.greatest(base["train"] + base["val"] + base["test"] - n, zero)
    # an overshoot is at most two (two minimums of one): train gives first, then a partition above one
    from_train = F.least(over, base["train"], one)
    left = over - from_train
    from_val = F.least(left, F.greatest(base["val"] - 1, zero), one)
    left = left - from_val
    from_test = F.least(left, F.greatest(base["test"] - 1, zero), one)
    again = left - from_test
    out = {"train": base["train"] - from_train - F.least(again, base["train"] - from_train), "val": base["val"] - from_val, "test": base["test"] - from_test}
    short = n - (out["train"] + out["val"] + out["test"])
    for i, p in enumerate(PARTITIONS):
        ahead = zero
        for j, q in enumerate(PARTITIONS):
            if q != p:
                ahead = ahead + F.when((frac[q] > frac[p]) | ((frac[q] == frac[p]) & F.lit(j < i)), one).otherwise(zero)
        out[p] = F.when(n <= 0, zero).when(n < 3, n if p == "train" else zero).otherwise(out[p] + F.when(ahead < short, one).otherwise(zero))
    return out


def slot_of(k: Column, d: dict[str, Column]) -> Column:
    """Partition of the k-th (0-based) new block for remaining deficits `d`."""
    zero = F.lit(0).cast("long")
    order = F.sort_array(F.array(*[F.struct((-F.greatest(d[p], zero)).alias("nd"), F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(PARTITIONS)]))
    d1, d2, d3 = (-order[i]["nd"] for i in range(3))
    pair = F.sort_array(F.array(*[F.struct(order[j]["i"].alias("i"), order[j]["p"].alias("p")) for j in (0, 1)]))
    a, b = d1 - d2, 2 * (d2 - d3)
    rotate = F.array(*[F.lit(p) for p in PARTITIONS])
    return (
        F.when(k < a, order[0]["p"]).when(k < a + b, F.get(pair, ((k - a) % 2).cast("int"))["p"])
        .when(k < a + b + 3 * d3, F.get(rotate, ((k - a - b) % 3).cast("int"))).otherwise("train")
    )


def assign_partitions(blocks: DataFrame, ratios=(0.8, 0.1, 0.1), seed: int = 42, force: bool = False, key: str = "dataset_id") -> DataFrame:
    """Adds `new_partition`. Eligible blocks keep theirs unless `force`; D is excluded; everything else is none."""
    r = parse_ratios(ratios)
    train_split = F.col("split").isin("train", "train_sample")
    eligible = train_split & F.col("grade").isin(*USABLE)
    old = F.coalesce("partition", F.lit("none"))
    keeps = eligible & F.lit(not force) & old.isin(*PARTITIONS)
    state = F.when(keeps, "keep").when(eligible, "new").when(train_split & (F.col("grade") == "D"), "excluded").otherwise("none")
    b = blocks.withColumn("_state", state).withColumn("_h", seeded_hash(seed, F.col("block_id")))
    per = b.groupBy(key).agg(F.count_if(F.col("_state").isin("keep", "new")).alias("_n"),
                             *[F.count_if((F.col("_state") == "keep") & (F.col("partition") == p)).alias(f"_have_{p}") for p in PARTITIONS])
    t = target_columns(F.col("_n"), r)
    per = per.select(key, *[(t[p] - F.col(f"_have_{p}")).alias(f"_d_{p}") for p in PARTITIONS])
    fresh = ordinal(b.where("_state = 'new'"), [key], ["_h", "block_id"], hash_bucket(F.col("_h")), "_k")
    fresh = spread_join(fresh, per, [key], hash_bucket(F.col("_h")))
    fresh = fresh.withColumn("new_partition", slot_of(F.col("_k"), {p: F.col(f"_d_{p}") for p in PARTITIONS})).drop("_k", *[f"_d_{p}" for p in PARTITIONS])
    rest = b.where("_state <> 'new'").withColumn("new_partition", F.when(F.col("_state") == "keep", F.col("partition")).otherwise(F.col("_state")))
    return rest.unionByName(fresh).drop("_state", "_h")
