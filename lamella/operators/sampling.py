"""Block and window sampling. Random choices are hash-ordered: uniform, repeatable and independent of row order."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import ordinal, spread_join

GRADES = ("A", "B", "C")


def parse_strata(spec: str) -> dict[str, float]:
    """'A:0.5,B:0.3,C:0.2' -> weights summing to one; unknown grades ignored."""
    got = {}
    for part in filter(str.strip, (spec or "").split(",")):
        g, _, w = part.partition(":")
        if g.strip().upper() in GRADES:
            got[g.strip().upper()] = max(0.0, float(w or 0))
    total = sum(got.values())
    return {g: w / total for g, w in got.items()} if total > 0 else {"A": 0.5, "B": 0.3, "C": 0.2}


def seeded_hash(seed: int, key: Column) -> Column:
    return F.sha1(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_bucket(h: Column) -> Column:
    """4096 equal buckets that follow the order of a hex digest."""
    return F.conv(F.substring(h, 1, 3), 16, 10).cast("long")


def select_train_blocks(blocks: DataFrame, n: int = 8, strata: str = "A:0.5,B:0.3,C:0.2", seed: int = 42, policy: str = "stratified",
                        key: str = "dataset_id") -> DataFrame:
    """Training sample per dataset. D never qualifies; a short stratum passes its shortfall to the next grade, then back to the first."""
    usable = blocks.where(F.col("grade").isin(*GRADES))
    if policy == "best":
        order = [F.col("grade"), F.coalesce("retention", F.lit(0.0)).desc(), F.coalesce("quality", F.lit(0.0)).desc(), F.col("block_id")]
        w = Window.partitionBy(key).orderBy(*order)
        return usable.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
    h = usable.withColumn("_h", seeded_hash(seed, F.col("block_id")))
    if policy == "random_usable":
        w = Window.partitionBy(key).orderBy("_h", "block_id")
        return h.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r", "_h")
    weights = parse_strata(strata)
    fix = max(weights, key=weights.get)
    have = usable.groupBy(key).agg(*[F.count_if(F.col("grade") == g).alias(f"_have_{g}") for g in GRADES])
    have = have.withColumn("_want", F.least(F.lit(n).cast("long"), sum(F.col(f"_have_{g}") for g in GRADES)))
    for g in GRADES:
        have = have.withColumn(f"_q_{g}", F.bround(F.col("_want") * F.lit(weights.get(g, 0.0))).cast("long"))
    have = have.withColumn(f"_q_{fix}", F.col(f"_q_{fix}") + F.col("_want") - sum(F.col(f"_q_{g}") for g in GRADES))
    carry = F.lit(0).cast("long")
    for g in GRADES:
        want = F.col(f"_q_{g}") + carry
        have = have.withColumn(f"_take_{g}", F.greatest(F.lit(0), F.least(want, F.col(f"_have_{g}")))).withColumn(f"_carry_{g}", want - F.least(want, F.col(f"_have_{g}")))
        carry = F.col(f"_carry_{g}")
    have = have.withColumn("_left", carry)
    for g in GRADES:
        more = F.least(F.col("_left"), F.col(f"_have_{g}") - F.col(f"_take_{g}"))
        have = have.withColumn("_more", more).withColumn(f"_take_{g}", F.col(f"_take_{g}") + F.col("_more")).withColumn("_left", F.col("_left") - F.col("_more"))
    takes = have.select(key, F.explode(F.array(*[F.struct(F.lit(g).alias("grade"), F.col(f"_take_{g}").alias("_take")) for g in GRADES])).alias("t")).select(key, "t.*")
    # one row per (dataset, grade) of takes; the rank filter keeps only `n` rows per group before the join
    w = Window.partitionBy(key, "grade").orderBy("_h", "block_id")
    ranked = h.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return ranked.join(takes, [key, "grade"]).where(F.col("_r") <= F.col("_take")).drop("_r", "_h", "_take")


def even_spread(df: DataFrame, n: int, order_by: list, bucket: Column) -> DataFrame:
    """`n` rows spread evenly over the ordered rows: positions are half-even rounded, duplicates collapse."""
    ranked = ordinal(df, [], order_by, bucket, "_pos")
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    p = F.when(F.lit(n > 1), F.bround(F.col("_k") * (F.col("_n") - 1) / F.lit(max(n - 1, 1)))).otherwise(F.lit(0)).cast("long")
    wanted = total.where(F.col("_n") > n).select(F.col("_n"), F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("_k")).select(p.alias("_pos")).distinct()
    few = total.where(F.col("_n") <= n).select(F.explode(F.when(F.col("_n") > 0, F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).alias("_pos"))
    return ranked.join(F.broadcast(wanted.unionByName(few)), "_pos", "left_semi").drop("_pos")  # at most n positions


def balance_failed_and_clean(slices: DataFrame, max_slices: int, clean_ratio: float = 1.0) -> DataFrame:
    """Half failed sections, as many clean ones times `clean_ratio`, both spread evenly over (block, z)."""
    half = max(1, max_slices // 2)
    order, bucket = ["_bucket", "block_id", "z"], F.col("_bucket")
    keyed = slices.withColumn("_bucket", F.conv(F.substring(F.md5("block_id"), 1, 3), 16, 10).cast("long"))
    bad = even_spread(keyed.where("NOT passed"), half, order, bucket).withColumn("cls", F.lit("fail"))
    n_bad = min(half, keyed.where("NOT passed").count())
    n_good = round(n_bad * clean_ratio) or (half if not n_bad else 0)
    good = even_spread(keyed.where("passed"), n_good, order, bucket).withColumn("cls", F.lit("clean"))
    return bad.unionByName(good).drop("_bucket")


def thin_clean(slices: DataFrame, max_points: int) -> DataFrame:
    """Keep every failed section and each step-th clean one."""
    counts = slices.agg(F.count(F.lit(1)).alias("_n"), F.count_if("passed").alias("_good"))
    step = F.when(F.col("_n") <= max_points, F.lit(1).cast("long")).otherwise(
        F.greatest(F.lit(1).cast("long"), F.floor(F.col("_good") / F.greatest(F.lit(1).cast("long"), F.lit(max_points) - (F.col("_n") - F.col("_good")))).cast("long")))
    ranked = ordinal(slices.where("passed"), [], ["z", "block_id"], F.col("z").cast("long"), "_pos")
    good = ranked.join(F.broadcast(counts.select(step.alias("_step"))), F.col("_pos") % F.col("_step") == 0).drop("_step", "_pos")
    return slices.where("NOT passed").unionByName(good)


def draw_hash(seed: int, *key: Column) -> Column:
    """60 bits of a digest of seed and key, as other systems can compute them as well."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key])), 1, 15), 16, 10).cast("long")


def random_offset(seed: int, lo: Column, hi: Column, *key: Column) -> Column:
    """Uniform integer in [lo, hi) from a hash of the key."""
    return lo + F.pmod(draw_hash(seed, *key), F.greatest(hi - lo, F.lit(1)))


def sample_windows(blocks: DataFrame, windows: DataFrame, size: tuple[int, int, int], n: int, seed: int = 0) -> DataFrame:
    """`n` windows drawn uniformly from the allowed ones with random y / x inside the tile; with repeats only when there are fewer than `n`."""
    dz, dy, dx = size
    fit = blocks.where((F.col("y_end") - F.col("y_start") >= dy) & (F.col("x_end") - F.col("x_start") >= dx))
    cand = spread_join(windows, fit, ["block_id"], F.floor(F.col("z0") / 4096).cast("long"))
    key = [F.col("block_id"), F.col("z0"), F.col("_round")]
    order = ["_round", draw_hash(seed, *key), "block_id", "z0"]
    pick = cut_lineage(cand.withColumn("_round", F.lit(0)).orderBy(*order).limit(n))  # n rows; the candidates are computed once
    total = pick.count()
    if 0 < total < n:  # these are all there are
        again = pick.drop("_round").withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(-(-n // total) - 1))))
        pick = again.orderBy(*order).limit(n)
    y0 = random_offset(seed + 1, F.col("y_start"), F.col("y_end") - dy + 1, *key)
    x0 = random_offset(seed + 2, F.col("x_start"), F.col("x_end") - dx + 1, *key)
    return with_box(pick.withColumn("y0", y0).withColumn("x0", x0), size).drop("_round")


def with_box(df: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    dz, dy, dx = size
    return df.withColumn("z1", F.col("z0") + dz).withColumn("y1", F.col("y0") + dy).withColumn("x1", F.col("x0") + dx)


def raw_windows(blocks: DataFrame, windows: DataFrame, size: tuple[int, int, int], n: int, seed: int = 0) -> DataFrame:
    """Random windows that overlap each other by at most about half a patch: one per half-patch cell, first `n` in hash order."""
    dz, dy, dx = size
    fit = blocks.where((F.col("y_end") - F.col("y_start") >= dy) & (F.col("x_end") - F.col("x_start") >= dx))
    key = [F.col("block_id"), F.col("z0")]
    c = spread_join(windows, fit, ["block_id"], F.floor(F.col("z0") / 4096).cast("long")).withColumn("_h", draw_hash(seed, *key))
    c = c.withColumn("y0", random_offset(seed + 1, F.col("y_start"), F.col("y_end") - dy + 1, *key)).withColumn("x0", random_offset(seed + 2, F.col("x_start"), F.col("x_end") - dx + 1, *key))
    cell = [F.floor(F.col(a) / max(1, d // 2)).alias(f"_{a}") for a, d in (("z0", dz), ("y0", dy), ("x0", dx))]
    first = c.groupBy("block_id", *cell).agg(F.min(F.struct("_h", "z0", "y0", "x0", "grade")).alias("f"))
    return with_box(first.select("block_id", "f.*").orderBy("_h", "block_id", "z0").limit(n), size).drop("_h")


def shard_patches(shards: DataFrame, size: tuple[int, int, int], stride: tuple[int, int, int]) -> DataFrame:
    """Deterministic tiling of every shard (z0, z1, y_start.., x_start..)."""
    from .ordered import range_rows

    dz, dy, dx = size
    fit = shards.where((F.col("z1") - F.col("z0") >= dz) & (F.col("y_end") - F.col("y_start") >= dy) & (F.col("x_end") - F.col("x_start") >= dx))
    t = range_rows(fit, F.col("z0"), F.col("z1") - dz + 1, stride[0], "pz")
    t = range_rows(t, F.col("y_start"), F.col("y_end") - dy + 1, stride[1], "py")
    return range_rows(t, F.col("x_start"), F.col("x_end") - dx + 1, stride[2], "px")


def weighted_shard_draws(shards: DataFrame, dz: int, n: int, seed: int = 0) -> DataFrame:
    """`n` draws of a shard with weight (sections - dz + 1), plus a random start.

    Weight w means w equally likely starts, so a draw is one position in the concatenated list of starts. Draw positions
    are matched to shards by bucket of the running weight."""
    width = 1 << 20
    s = shards.where(F.col("z1") - F.col("z0") >= dz).withColumn("_w", F.col("z1") - F.col("z0") - dz + 1)
    s = s.withColumn("_hb", hash_bucket(F.sha1(F.concat_ws(":", "block_id", F.col("z0").cast("string")))))
    per = s.groupBy("_hb").agg(F.sum("_w").alias("_bw"))
    top = Window.partitionBy(F.lit(0)).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)  # at most 4096 rows
    per = per.withColumn("_before", F.coalesce(F.sum("_bw").over(top), F.lit(0).cast("long")))
    inside = Window.partitionBy("_hb").orderBy("block_id", "z0").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_end", F.sum("_w").over(inside)).join(F.broadcast(per.select("_hb", "_before")), "_hb")
    s = s.withColumn("_hi", F.col("_before") + F.col("_end")).withColumn("_lo", F.col("_hi") - F.col("_w"))
    total = s.agg(F.max("_hi")).first()[0]
    if not total:
        return s.select("block_id", "z0").withColumn("draw", F.lit(0)).limit(0)
    draws = shards.sparkSession.range(n).select(F.col("id").alias("draw"), F.pmod(draw_hash(seed, F.col("id")), F.lit(int(total))).alias("_at"))
    cells = s.withColumn("_c", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor((F.col("_hi") - 1) / width))))
    d = draws.withColumn("_c", F.floor(F.col("_at") / width))
    j = d.join(cells, "_c").where((F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi")))
    return j.select("draw", "block_id", (F.col("z0") + F.col("_at") - F.col("_lo")).alias("z0"))
