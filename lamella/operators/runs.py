"""Clean runs, shards, training windows and per-section views."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import islands, range_rows


def accepted(min_quality: float | None, only_passed: bool = True) -> Column:
    ok = F.col("passed") if only_passed else F.lit(True)
    return ok if min_quality is None else ok & (F.coalesce(F.col("quality"), F.lit(0.0)) >= min_quality)


def clean_runs(slices: DataFrame, keys: list[str], min_run: int = 1, min_quality: float | None = None) -> DataFrame:
    """Half-open runs of consecutive accepted sections with at least `min_run` sections."""
    return islands(slices.where(accepted(min_quality)), keys, "z").where(F.col("run_length") >= min_run)


def split_shards(run_rows: DataFrame, shard_z: int) -> DataFrame:
    """Cut runs into shards of at most `shard_z` sections (0 = no limit)."""
    if shard_z <= 0:
        return run_rows.withColumn("z0", F.col("run_start")).withColumn("z1", F.col("run_end"))
    return range_rows(run_rows, F.col("run_start"), F.col("run_end"), shard_z, "z0").withColumn("z1", F.least(F.col("z0") + shard_z, F.col("run_end")))


def latest_run_per_block(run_blocks: DataFrame, keys=("dataset_id", "block_id")) -> DataFrame:
    return run_blocks.groupBy(*keys).agg(F.max("run_id").alias("run_id"))


def allowed_windows(blocks: DataFrame, slices: DataFrame | None, dz: int, only_passed: bool = True, min_quality: float | None = None) -> DataFrame:
    """(block_id, z0): every window of `dz` consecutive sections that all pass. A section without a QC row does not pass.

    Without QC rows, or with no filter, every window of every block is allowed. A run of length n gives n - dz + 1 windows,
    so no sliding frame is needed."""
    if slices is None or not (only_passed or min_quality is not None):
        whole = blocks.select("block_id", F.col("z_start").alias("run_start"), F.col("z_end").alias("run_end"))
        return range_rows(whole, F.col("run_start"), F.col("run_end") - (dz - 1), 1, "z0").select("block_id", "z0")
    inside = slices.join(blocks.select("block_id"), "block_id", "left_semi")
    run_rows = islands(inside.where(accepted(min_quality, only_passed)), ["block_id"], "z").where(F.col("run_length") >= dz)
    return range_rows(run_rows, F.col("run_start"), F.col("run_end") - (dz - 1), 1, "z0").select("block_id", "z0")


def export_codes(blocks: DataFrame, slices: DataFrame, min_run: int = 1, min_quality: float | None = None) -> DataFrame:
    """Verdict per section of every block: K delivered, Q failed, L low quality, S run too short, M no record."""
    grid = range_rows(blocks.select("block_id", "z_start", "z_end"), F.col("z_start"), F.col("z_end"), 1, "z").select("block_id", "z")
    kept = range_rows(clean_runs(slices, ["block_id"], min_run, min_quality), F.col("run_start"), F.col("run_end"), 1, "z").select(
        "block_id", "z", F.lit(True).alias("_inside"))
    rec = slices.select("block_id", "z", "passed", "quality", F.lit(True).alias("_rec"))
    ok = accepted(min_quality)
    code = F.when(F.col("_rec").isNull(), "M").when(F.col("_inside"), "K").when(ok, "S").when(F.col("passed"), "L").otherwise("Q")
    return grid.join(rec, ["block_id", "z"], "left").join(kept, ["block_id", "z"], "left").select("block_id", "z", code.alias("code"))


def code_strips(codes: DataFrame, width: int = 1024) -> DataFrame:
    """Codes as text, `width` sections per row, so a long block is many short strips."""
    strip = F.floor(F.col("z") / width).cast("long")
    return codes.groupBy("block_id", strip.alias("strip")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("z", "code"))), lambda s: s["code"]), "").alias("codes"))


def excluded_sections(slices: DataFrame, min_quality: float | None = None) -> DataFrame:
    """Evaluated sections that are not delivered candidates (set difference on the section key)."""
    return slices.select("block_id", "z").exceptAll(slices.where(accepted(min_quality)).select("block_id", "z"))


def worst_per_z(slices: DataFrame, keys=("dataset_id",)) -> DataFrame:
    """Collapse tiles: the worst tile of each z (unreadable beats any severity; ties go to the first block id)."""
    rank = F.when(F.col("status") != "ok", F.lit(5)).otherwise(F.col("max_sev"))
    pick = F.min(F.struct((-rank).alias("r"), "block_id", "status", "quality", "passed"))
    return slices.groupBy(*keys, "z").agg(pick.alias("w")).select(*keys, "z", (-F.col("w.r")).alias("rank"), "w.block_id", "w.status", "w.quality", "w.passed")


def grade_bands(blocks: DataFrame) -> DataFrame:
    return blocks.where("grade IS NOT NULL").groupBy("z_start", "z_end").agg(F.max("grade").alias("grade"))


def gallery(findings: DataFrame, per_type: int = 4, keys=("dataset_id",), min_sev: int = 3) -> DataFrame:
    """First shots per failure type, one per section, with the number of affected sections."""
    one = findings.where(F.col("sev") >= min_sev).groupBy(*keys, "failure_type", "z").agg(F.min(F.struct("block_id", "check_order", "sev")).alias("s"))
    n = one.groupBy(*keys, "failure_type").agg(F.count(F.lit(1)).alias("n_sections"))
    top = one.withColumn("shot", F.row_number().over(Window.partitionBy(*keys, "failure_type").orderBy("z"))).where(F.col("shot") <= per_type)
    return top.join(n, [*keys, "failure_type"]).select(*keys, "failure_type", "shot", "z", "s.block_id", "s.sev", "n_sections")


def example_per_type(shots: DataFrame) -> DataFrame:
    """One example per failure type, most frequent first, preferring a section no earlier example used.

    At most one row per failure type is decided in order; `shots` holds as many candidates per type as there are types."""
    per = shots.groupBy("failure_type", "n_sections").agg(F.sort_array(F.collect_list(F.struct("shot", "dataset_id", "z", "block_id"))).alias("c"))
    rows = per.groupBy().agg(F.sort_array(F.collect_list(F.struct((-F.col("n_sections")).alias("o"), "failure_type", "c"))).alias("types"))
    empty = F.array().cast("array<struct<failure_type:string,dataset_id:string,z:bigint,block_id:string>>")

    def pick(acc, t):
        free = F.filter(t["c"], lambda s: ~F.exists(acc, lambda u: (u["dataset_id"] == s["dataset_id"]) & (u["z"] == s["z"])))
        s = F.coalesce(F.get(free, F.lit(0)), F.get(t["c"], F.lit(0)))
        return F.array_append(acc, F.struct(t["failure_type"].alias("failure_type"), s["dataset_id"].alias("dataset_id"), s["z"].alias("z"), s["block_id"].alias("block_id")))

    return rows.select(F.explode(F.aggregate("types", empty, pick)).alias("e")).select("e.*")


def passed_everywhere(slices: DataFrame) -> DataFrame:
    """A z is clean when it passed in every tile."""
    return slices.groupBy("dataset_id", "z").agg(F.bool_and("passed").alias("passed_all"), F.count(F.lit(1)).alias("n_tiles"))


def volumes_from_crops(crops: DataFrame, min_run: int) -> DataFrame:
    """Runs of consecutive z at one window position."""
    return islands(crops.select("y0", "x0", "z").distinct(), ["y0", "x0"], "z").where(F.col("run_length") >= min_run)
