"""Order-dependent building blocks that stay parallel inside one group.

A plain `Window.partitionBy(key)` puts a whole group into one task. Everything here first cuts a group into
ordered buckets (by position, time or hash prefix), works per (key, bucket), and carries only one summary row per
bucket across the group, so a key that holds a third of all rows still spreads over the cluster.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 4096
FOLD_ROWS = 256
TASK_ROWS = 1 << 18


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df` dealt by `keys` over so many tasks that each holds about TASK_ROWS of `rows` rows; left as it is where the session's shuffles are that fine anyway."""
    n = -(-rows // TASK_ROWS)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def position_bucket(pos: str, width: int = BUCKET_ROWS) -> Column:
    return F.floor(F.col(pos) / F.lit(width)).cast("long")


def _group_window(keys: list[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def spread_join(fact: DataFrame, dim: DataFrame, keys: list[str], bucket: Column, how: str = "inner") -> DataFrame:
    """Join one `dim` row per key onto many `fact` rows without sending a hot key to one task.

    `dim` is repeated once per (key, bucket) that occurs in `fact`, and the big join runs on (key, bucket)."""
    fact = fact.withColumn("_sb", bucket)
    spread = fact.select(*keys, "_sb").distinct().join(dim, keys)
    return fact.join(spread, [*keys, "_sb"], how).drop("_sb")


def _rows_before(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _ob, _on) -> (keys, _ob, _before): rows in earlier buckets. Without keys the bucket list itself is summed in two levels."""
    zero = F.lit(0).cast("long")
    if keys:
        prefix = Window.partitionBy(*keys).orderBy("_ob").rowsBetween(Window.unboundedPreceding, -1)
        return sizes.select(*keys, "_ob", F.coalesce(F.sum("_on").over(prefix), zero).alias("_before"))
    coarse = F.floor(F.col("_ob") / BUCKET_ROWS).cast("long")
    sizes = sizes.withColumn("_cb", coarse)
    tops = sizes.groupBy("_cb").agg(F.sum("_on").alias("_cn"))
    over_tops = Window.partitionBy(F.lit(0)).orderBy("_cb").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_cb", F.coalesce(F.sum("_cn").over(over_tops), zero).alias("_top"))
    within = Window.partitionBy("_cb").orderBy("_ob").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_in", F.coalesce(F.sum("_on").over(within), zero)).join(tops, "_cb").select("_ob", (F.col("_top") + F.col("_in")).alias("_before"))


def ordinal(df: DataFrame, keys: list[str], order_by: list, bucket: Column, out: str = "ordinal") -> DataFrame:
    """0-based position of each row in its group. `bucket` must not decrease along `order_by`."""
    tagged = df.withColumn("_ob", bucket)
    sizes = tagged.groupBy(*keys, "_ob").agg(F.count(F.lit(1)).alias("_on"))
    offsets = _rows_before(sizes, keys)
    local = Window.partitionBy(*keys, "_ob").orderBy(*order_by)
    return (
        tagged.withColumn("_local", F.row_number().over(local) - 1)
        .join(offsets, [*keys, "_ob"])
        .withColumn(out, (F.col("_before") + F.col("_local")).cast("long"))
        .drop("_ob", "_before", "_local")
    )


def running_total(df: DataFrame, keys: list[str], pos: str, value: Column, out: str, width: int = BUCKET_ROWS,
                  inclusive: bool = True) -> DataFrame:
    """Running sum of `value` along the integer position `pos` (distinct inside a group)."""
    tagged = df.withColumn("_rb", position_bucket(pos, width)).withColumn("_rv", value)
    sums = tagged.groupBy(*keys, "_rb").agg(F.sum("_rv").alias("_rs"))
    prefix = _group_window(keys).orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offsets = sums.select(*keys, "_rb", F.coalesce(F.sum("_rs").over(prefix), zero).alias("_before"))
    local = Window.partitionBy(*keys, "_rb").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return (
        tagged.withColumn("_local", F.coalesce(F.sum("_rv").over(local), zero))
        .join(offsets, [*keys, "_rb"])
        .withColumn(out, F.col("_before") + F.col("_local"))
        .drop("_rb", "_rv", "_before", "_local")
    )


def islands(df: DataFrame, keys: list[str], pos: str = "z", width: int = BUCKET_ROWS) -> DataFrame:
    """Runs of consecutive positions: one row (keys, run_start, run_end exclusive, run_length). `df` is read once.

    Runs are found per bucket; only those that end at a bucket's border, at most two per bucket, are put together across the group."""
    tagged = df.select(*keys, pos).where(F.col(pos).isNotNull()).withColumn("_ob", position_bucket(pos, width))
    local = Window.partitionBy(*keys, "_ob").orderBy(pos)
    parts = (
        tagged.withColumn("_island", F.col(pos) - F.row_number().over(local))
        .groupBy(*keys, "_ob", "_island")
        .agg(F.min(pos).alias("run_start"), (F.max(pos) + 1).alias("run_end"), F.count(F.lit(1)).alias("run_length"))
    )
    border = (F.pmod("run_start", F.lit(width)) == 0) | (F.pmod("run_end", F.lit(width)) == 0)
    parts = parts.withColumn("_inner", F.when(border, F.lit(None)).otherwise(F.col("_ob")))
    along = Window.partitionBy(*keys, "_inner").orderBy("run_start")
    new = F.coalesce((F.lag("run_end").over(along) != F.col("run_start")).cast("long"), F.lit(1).cast("long"))
    parts = parts.withColumn("_new", new).withColumn("_run", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        parts.groupBy(*keys, "_inner", "_run")
        .agg(F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"), F.sum("run_length").alias("run_length"))
        .drop("_inner", "_run")
    )


def range_rows(df: DataFrame, start: Column, end: Column, step: int, out: str, block: int = 4096) -> DataFrame:
    """One row per start, start + step, ... below `end`. Two explode levels, so one long range is never one huge array."""
    big = step * block
    outer = df.withColumn("_r0", F.explode(
        F.when(end > start, F.sequence(start.cast("long"), (end - 1).cast("long"), F.lit(big).cast("long"))).otherwise(F.array().cast("array<bigint>"))))
    stop = F.least(F.col("_r0") + big, end) - 1
    return outer.withColumn(out, F.explode(F.sequence(F.col("_r0"), stop.cast("long"), F.lit(step).cast("long")))).drop("_r0")


def with_halo(df: DataFrame, pos: str, back: int, ahead: int, width: int = BUCKET_ROWS) -> DataFrame:
    """Tag rows with a window cell `_cell`; rows near a cell edge are repeated in the neighbour cell (`_own` false),
    so windows over (key, _cell) that reach `back` / `ahead` positions are exact. `pos` must be dense."""
    own = position_bucket(pos, width)
    inside = F.pmod(F.col(pos), F.lit(width))
    cells = F.array_compact(F.array(
        own,
        F.when(inside >= width - back, own + 1) if back else F.lit(None).cast("long"),
        F.when((inside < ahead) & (own > 0), own - 1) if ahead else F.lit(None).cast("long"),
    ))
    return df.withColumn("_cell", F.explode(cells)).withColumn("_own", F.col("_cell") == own)


def value_bin(v: Column, per_octave: int = 1024) -> Column:
    """A bin number that never falls as the double `v` rises, whatever its unit: `per_octave` equal bins between neighbouring powers of two,
    mirrored for negative numbers. A group has at most 2 * 2100 * per_octave bins, in practice a few thousand."""
    size = F.abs(v)
    octave = F.floor(F.log2(size))
    # where the logarithm is rounded to the next power the remainder is just below 0 or at its top, which gives the same bin
    step = (octave + 1100) * per_octave + F.floor((size / F.pow(F.lit(2.0), octave) - 1) * per_octave)
    top = F.lit(3000 * per_octave)
    code = F.when(size == 0, F.lit(0)).when(size == float("inf"), top).when(size < 2.3e-308, F.lit(1)).otherwise(step)
    return F.when(v < 0, -code).otherwise(code).cast("long")


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], resolution: int = 1024,
                      count_as: str | None = None) -> DataFrame:
    """Exact, linearly interpolated percentiles per group, NULLs ignored: one row per group, one column per entry of `probs`.

    Values are counted per (group, value), binned by value_bin (`resolution` bins per octave), and only the bins that hold a wanted rank are sorted. The
    group is never collected; its bins, whose number is bounded whatever the values are, are counted in one window."""
    v = (
        df.where(F.col(value).isNotNull() & ~F.isnan(value))
        .groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_w"))
        .withColumn("_vb", value_bin(F.col("_v"), resolution))
    )
    whole = _group_window(keys)
    upto = whole.orderBy("_vb").rowsBetween(Window.unboundedPreceding, 0)
    bins = v.groupBy(*keys, "_vb").agg(F.sum("_w").alias("_bn")).select(
        *keys, "_vb", "_bn", (F.sum("_bn").over(upto) - F.col("_bn")).alias("_before"), F.sum("_bn").over(whole).alias("_total"))

    def rank(q):  # (fractional rank, lower rank, upper rank); a callable gives the 0-based rank from the row count
        p = q(F.col("_total")).cast("double") if callable(q) else F.lit(float(q)) * (F.col("_total") - 1)
        return p, F.floor(p), F.ceil(p)

    wanted = F.lit(False)
    for q in probs.values():
        _, lo, hi = rank(q)
        wanted = wanted | ((F.col("_before") <= hi) & (F.col("_before") + F.col("_bn") > lo))
    inside = Window.partitionBy(*keys, "_vb").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    hits = (
        v.join(bins.where(wanted), [*keys, "_vb"])
        .withColumn("_end", F.col("_before") + F.sum("_w").over(inside))
        .withColumn("_start", F.col("_end") - F.col("_w"))
    )
    aggs = [F.max("_total").alias("_total")]
    for name, q in probs.items():
        _, lo, hi = rank(q)
        aggs.append(F.max(F.when((F.col("_start") <= lo) & (lo < F.col("_end")), F.col("_v"))).alias(f"_lo_{name}"))
        aggs.append(F.max(F.when((F.col("_start") <= hi) & (hi < F.col("_end")), F.col("_v"))).alias(f"_hi_{name}"))
    found = hits.groupBy(*keys).agg(*aggs) if keys else hits.agg(*aggs)
    cols = []
    for name, q in probs.items():
        p, lo, _ = rank(q)
        cols.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (p - lo)).alias(name))
    if count_as:
        cols.append(F.col("_total").alias(count_as))
    return found.select(*keys, *cols)


# ----------------------------------------------------------------------------- two-back walk
#
# A section is compared with the previous chain section unless that one was flagged, then with the one before it, else
# the walk resets. Whether a section is flagged depends on which reference was picked, so the scan looks sequential.
# But the only memory is two bits (was the previous / the second previous chain section flagged), so every section is a
# map from 4 states to 4 states. Maps compose associatively: fold fixed-size chunks in parallel, combine the chunk maps
# the same way, then replay every chunk from its incoming state.

_START = 3  # before the first chain section both references count as unusable


def transition(pre: Column, hit1: Column, hit2: Column) -> Column:
    """Map of one chain section: bit 0 of the state = previous flagged, bit 1 = second previous flagged."""
    a = (F.coalesce(pre, F.lit(False)) | F.coalesce(hit1, F.lit(False))).cast("int")
    b = (F.coalesce(pre, F.lit(False)) | F.coalesce(hit2, F.lit(False))).cast("int")
    c = F.coalesce(pre, F.lit(False)).cast("int")
    return F.array(a, b + 2, a, c + 2)


def _incoming(maps: DataFrame, keys: list[str], depth: int, width: int) -> DataFrame:
    """(keys, _pos, _map) -> (keys, _pos, _state): the state just before every position."""
    chunk = (F.floor(F.col("_pos") / width) if depth else F.lit(0)).cast("long")
    lists = maps.groupBy(*keys, chunk.alias("_chunk")).agg(F.sort_array(F.collect_list(F.struct("_pos", "_map"))).alias("_rows"))
    if depth:
        identity = F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(3))
        coarse = lists.select(*keys, F.col("_chunk").alias("_pos"), F.aggregate(
            "_rows", identity, lambda acc, r: F.transform(acc, lambda s: F.get(r["_map"], s))).alias("_map"))
        above = _incoming(coarse, keys, depth - 1, width).withColumnRenamed("_pos", "_chunk")
        lists = lists.join(above, [*keys, "_chunk"])
    else:
        lists = lists.withColumn("_state", F.lit(_START))
    empty = F.transform(F.slice("_rows", 1, 0), lambda r: F.struct(r["_pos"].alias("_pos"), F.lit(0).alias("_state")))
    walked = F.aggregate(
        "_rows", F.struct(F.col("_state").alias("s"), empty.alias("out")),
        lambda acc, r: F.struct(F.get(r["_map"], acc["s"]).alias("s"),
                                F.array_append(acc["out"], F.struct(r["_pos"].alias("_pos"), acc["s"].alias("_state"))).alias("out")))
    return lists.select(*keys, F.explode(walked["out"]).alias("_o")).select(*keys, "_o._pos", "_o._state")


def fold_depth(span: int, width: int = FOLD_ROWS) -> int:
    """How many chunk levels keep every fold below `width` rows when positions run up to `span`."""
    depth, span = 0, max(1, int(span))
    while span > width:
        span, depth = -(-span // width), depth + 1
    return depth


def two_back_walk(df: DataFrame, keys: list[str], pos: str, span: int, in_chain: str = "in_chain", k: str = "k",
                  pre: Column | None = None, hit1: Column | None = None, hit2: Column | None = None, width: int = FOLD_ROWS) -> DataFrame:
    """Adds `pick`: -1 first chain section, 1 previous chain section, 2 second previous, 0 reset; `flagged` for chain rows.

    `k` counts chain sections strictly before the row, `pos` is unique per group and below `span`, `hit1` / `hit2` say
    whether the row is flagged against the previous / second previous chain section, `pre` whether it was before."""
    pre = F.lit(False) if pre is None else pre
    stay = F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(3))
    maps = df.select(*keys, F.col(pos).alias("_pos"), F.when(F.col(in_chain), transition(pre, hit1, hit2)).otherwise(stay).alias("_map"))
    states = _incoming(maps, keys, fold_depth(span, width), width).withColumnRenamed("_pos", pos)
    s = F.col("_state")
    pick = (
        F.when(F.col(k) == 0, F.lit(-1))
        .when((s.bitwiseAND(F.lit(1)) == 0), F.lit(1))
        .when((F.col(k) >= 2) & (s.bitwiseAND(F.lit(2)) == 0), F.lit(2))
        .otherwise(F.lit(0))
    )
    out = df.join(states, [*keys, pos]).withColumn("pick", pick)
    hit = F.when(F.col("pick") == 1, hit1).when(F.col("pick") == 2, hit2).otherwise(F.lit(False))
    return out.withColumn("flagged", F.coalesce(pre, F.lit(False)) | F.coalesce(hit, F.lit(False))).drop("_state")
