"""Section checks that read stored statistics: one projection per check, block baselines joined back."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import CHECKS, HIGH, Config, clip01
from ..session import cut_lineage
from .ordered import exact_percentiles, position_bucket, running_total, spread_join, two_back_walk

STAT_CHECKS = ("missing_slice", "corrupt_slice", "blank_slice", "severe_blur", "saturation", "crack")


def blank_score(p: dict) -> Column:
    by_std = clip01(F.col("std") / p["std_ref"])
    start = p["mode_frac_start"]
    by_mode = clip01(F.lit(1.0) - F.greatest(F.col("frac_mode") - start, F.lit(0.0)) / (1.0 - start))
    return F.least(by_std, by_mode)


def crack_score(p: dict) -> Column:
    frac, lo, hi = F.col("frac_fill"), p["area_ref"], p["area_full"]
    drop = F.ln(F.greatest(frac, F.lit(lo)) / lo) / F.ln(F.lit(hi) / lo)
    return F.when(frac < p["min_frac"], F.lit(1.0)).otherwise(F.lit(1.0) - clip01(drop))


def crack_type(p: dict, largest: Column) -> Column:
    """Bulk fill on an edge is uncovered canvas, a thin band is a crack, anything else a missing region."""
    elong = F.coalesce(F.col("fill_elongation"), F.lit(1.0))
    return (
        F.when((F.coalesce(F.col("fill_sides"), F.lit(0)) >= 1) & (largest >= p["no_coverage_min_frac"]) & (elong < p["no_coverage_max_elong"]), "no_coverage")
        .when(elong >= p["elongation_crack"], "crack").otherwise("missing_region")
    )


def score_sections(sections: DataFrame, config: Config | None = None, key: str = "block_id") -> DataFrame:
    """Adds one score column per statistic-based check. NULL means not evaluated."""
    c = config or Config()
    ok = F.col("status") == "ok"
    s = sections.withColumn("blank_slice", F.when(ok, blank_score(c.params("blank_slice"))))
    usable = ok & (c.severity("blank_slice", F.col("blank_slice")) < HIGH)
    base = exact_percentiles(s.where(usable), [key], "sharpness", {"ref_sharp": 0.5})
    s = spread_join(s, base, [key], position_bucket("z"), "left")
    pb, ps = c.params("severe_blur"), c.params("saturation")
    sharp, ref = F.col("sharpness"), F.col("ref_sharp")
    relative = clip01(sharp / ref)
    absolute = clip01(sharp / pb["absolute_floor"]) if pb["absolute_floor"] > 0 else F.lit(1.0)
    blur = F.when(usable, F.when(ref.isNull() | (ref < pb["min_reference"]), F.lit(1.0)).otherwise(F.least(relative, absolute)))
    pc = c.params("crack")
    return (
        s.withColumn("missing_slice", F.when(F.col("status") == "missing", F.lit(0.0)).otherwise(F.lit(1.0)))
        .withColumn("corrupt_slice", F.when(F.col("status") == "corrupt", F.lit(0.0)).when(ok, F.lit(1.0)))
        .withColumn("severe_blur", blur)
        .withColumn("saturation", F.when(ok, F.lit(1.0) - clip01(F.col("frac_sat") / ps["frac_ref"])))
        .withColumn("crack", F.when(ok, crack_score(pc)))
        .withColumn("crack_type", crack_type(pc, F.col("frac_fill")))
    )


def notes(check: str) -> Column:
    """Why a score is NULL: every unevaluated section carries a reason."""
    blank = F.col("status") == "ok"
    return F.when(F.col(check).isNull(), F.when(blank, F.lit("blank")).otherwise(F.col("status")))


def add_severities(scored: DataFrame, config: Config | None = None, checks=STAT_CHECKS) -> DataFrame:
    c = config or Config()
    return scored.withColumns({f"sev_{k}": c.severity(k, F.col(k)) for k in checks})


def roll_up_sections(scored: DataFrame, config: Config | None = None, checks=STAT_CHECKS) -> DataFrame:
    """Per section: quality (worst score, 0 when unreadable), worst severity, passed, usable as reference."""
    c = config or Config()
    s = add_severities(scored, c, checks)
    worst = F.greatest(*[F.col(f"sev_{k}") for k in checks]).cast("int")
    quality = F.when(F.col("status") != "ok", F.lit(0.0)).otherwise(F.least(*[F.col(k) for k in checks]))
    passed = (F.col("status") == "ok") & (F.col("max_sev") < c.pass_max)
    return s.withColumn("quality", quality).withColumn("max_sev", worst).withColumn("passed", passed).withColumn("in_chain", passed)


def findings(rolled: DataFrame, config: Config | None = None, checks=STAT_CHECKS, keep: tuple = ("dataset_id", "block_id", "z")) -> DataFrame:
    """Long table of findings at or above the recording severity, exploded from the wide scores in one pass."""
    c = config or Config()
    order = {k: i for i, k in enumerate(CHECKS)}
    entries = []
    for k in checks:
        ftype = F.col("crack_type") if k == "crack" else F.lit(CHECKS[k][0])
        entries.append(F.struct(F.lit(k).alias("check_name"), F.lit(order[k]).alias("check_order"), ftype.alias("failure_type"),
                                F.col(f"sev_{k}").alias("sev"), F.col(k).alias("score")))
    long = rolled.select(*keep, F.explode(F.array(*entries)).alias("f")).select(*keep, "f.*")
    return long.where(F.col("sev") >= c.finding_min)


# ----------------------------------------------------------------------------- neighbour based checks


def chain_positions(sections: DataFrame, key: str = "block_id") -> DataFrame:
    """`k` = number of chain sections strictly before each section (its own index for a chain section)."""
    return running_total(sections, [key], "z", F.col("in_chain").cast("long"), "k", inclusive=False)


def with_references(positioned: DataFrame, cols: list[str], key: str = "block_id") -> DataFrame:
    """As-of join to the reference chain: previous (`p1_*`) and second previous (`p2_*`) chain section of every row.

    The chain ordinal turns "latest earlier usable section" into two equality joins on (block, ordinal). Arrays are larger than the
    optimizer takes them for, so references that hold some are never sent to all tasks."""
    chain = positioned.where("in_chain").select(key, F.col("k").alias("_ord"), "z", *cols)
    wide = any(kind.startswith("array") for _, kind in chain.dtypes)
    for back in (1, 2):
        ref = chain.select(key, (F.col("_ord") + back).alias("k"), F.col("z").alias(f"p{back}_z"), *[F.col(c).alias(f"p{back}_{c}") for c in cols])
        positioned = positioned.join(ref.hint("merge") if wide else ref, [key, "k"], "left")
    return positioned


def with_boundary_sections(sections: DataFrame, blocks: DataFrame, tile: list[str], key: str = "block_id") -> DataFrame:
    """Give every block the section just before its z range as a reference: in the chain, never scored (`reference_only`).

    `blocks`: key, z_start and the XY tile columns; the section is looked up by (tile, z), so only one row per block is added."""
    want = blocks.where("z_start > 0").select(F.col(key).alias("_next"), *tile, (F.col("z_start") - 1).alias("z"))
    own = blocks.select(key, *tile)
    edge = want.select(*tile, "z").distinct()
    at_edge = spread_join(sections.where("status = 'ok'"), own, [key], position_bucket("z")).join(edge, [*tile, "z"], "left_semi")
    extra = at_edge.drop(key).join(want, [*tile, "z"]).withColumnRenamed("_next", key).drop(*tile).withColumn("in_chain", F.lit(True)).withColumn("reference_only", F.lit(True))
    return sections.withColumn("reference_only", F.lit(False)).unionByName(extra.select(*sections.columns, "reference_only"))


def brightness_jump(rolled: DataFrame, span: int, config: Config | None = None, key: str = "block_id") -> DataFrame:
    """Mean grey level against the reference section; a flagged reference is stepped over once, then the walk resets."""
    c = config or Config()
    ref = c.params("brightness_jump")["jump_ref"]
    ok = F.col("status") == "ok"
    rows = with_references(chain_positions(rolled.select(key, "z", "status", "mean", "in_chain"), key), ["mean"], key)

    def score(back):
        return F.lit(1.0) - clip01(F.abs(F.col("mean") - F.col(f"p{back}_mean")) / ref)

    def hit(back):
        return c.severity("brightness_jump", score(back)) >= HIGH

    walked = two_back_walk(rows, [key], "z", span, hit1=hit(1), hit2=hit(2))
    pick = F.col("pick")
    value = F.when(~ok, F.lit(None).cast("double")).when(pick == -1, F.lit(1.0)).when(pick == 1, score(1)).when(pick == 2, score(2))
    return walked.select(
        key, "z", value.alias("brightness_jump"),
        F.when(ok & (pick == 1), F.col("p1_z")).when(ok & (pick == 2), F.col("p2_z")).alias("ref_z"),
        F.when(ok & (pick == 0), "reference_reset").when(~ok, F.col("status")).alias("note"))


def contrast_drift(rolled: DataFrame, config: Config | None = None, key: str = "block_id") -> tuple[DataFrame, DataFrame]:
    """(section scores, block trend findings): log2 deviation from the block median std, and its slope along z."""
    c = config or Config()
    p = c.params("contrast_drift")
    chain = rolled.where("in_chain")
    base = exact_percentiles(chain.where("std > 0"), [key], "std", {"ref_std": 0.5})
    j = spread_join(rolled.select(key, "z", "status", "std", "in_chain"), base, [key], position_bucket("z"), "left")
    flat = F.col("ref_std").isNull() | (F.col("ref_std") <= 0) | (F.col("std") <= 0)
    l2 = F.log2(F.col("std") / F.col("ref_std"))
    slices = j.select(key, "z", F.when(F.col("in_chain"), F.when(flat, F.lit(1.0)).otherwise(F.lit(1.0) - clip01(F.abs(l2) / p["log2_ref"]))).alias("contrast_drift"))
    fit = j.where(F.col("in_chain") & ~flat).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(l2, F.col("z").cast("double")).alias("slope"), F.regr_r2(l2, F.col("z").cast("double")).alias("r2"),
        (F.var_pop(l2) * F.count(F.lit(1))).alias("ss"), F.first("ref_std").alias("ref_std"))
    per100 = F.col("slope") * 100
    r2 = F.when(F.col("ss") > 1e-12, F.col("r2")).otherwise(F.lit(0.0))
    score = F.lit(1.0) - clip01(F.abs(per100) / p["trend_ref_per_100z"])
    trend = fit.where(F.col("n") >= p["min_slices_for_trend"]).select(
        key, "n", per100.alias("log2_per_100z"), r2.alias("r2"), score.alias("score"), F.least(F.lit(2), c.severity("contrast_drift", score)).alias("sev"))
    return slices, trend.withColumn("is_finding", (F.col("r2") >= p["min_trend_r2"]) & (F.col("sev") >= c.finding_min))


def severity_long(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Severity of a long score table (check, score) through the broadcast threshold table (one row per check)."""
    t = F.broadcast(thresholds)
    s = F.col("score")
    rank = F.when(s < F.col("t_critical"), 4).when(s < F.col("t_high"), 3).when(s < F.col("t_medium"), 2).when(s < F.col("t_low"), 1).otherwise(0)
    return scores.join(t, "check").withColumn("sev", rank)


def excess_over_baseline(df: DataFrame, key: str | list[str], col: str, k_mad: float, min_spread: float | Column) -> DataFrame:
    """max(0, x - median - k * max(MAD * 1.4826, floor)) against the block's own values. `df` is read several times: store it first.
    Medians and spreads, one row per group, are stored, so that none of the plans repeats another."""
    keys = [key] if isinstance(key, str) else list(key)
    med = cut_lineage(exact_percentiles(df, keys, col, {"_med": 0.5}))
    j = spread_join(df, med, keys, position_bucket("z"), "left").withColumn("_dev", F.abs(F.col(col) - F.col("_med")))
    mad = cut_lineage(exact_percentiles(j, keys, "_dev", {"_mad": 0.5}))
    j = spread_join(j, mad, keys, position_bucket("z"), "left")
    spread = F.greatest(F.col("_mad") * 1.4826, min_spread if isinstance(min_spread, Column) else F.lit(float(min_spread)))
    return j.withColumn(f"excess_{col}", F.greatest(F.lit(0.0), F.col(col) - F.col("_med") - k_mad * spread)).drop("_med", "_mad", "_dev")


def any_of(conds) -> Column:
    return reduce(lambda a, b: a | b, conds)
