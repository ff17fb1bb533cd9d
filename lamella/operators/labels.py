"""Label planes: derived maps, resampling, validation against the image, exclusive masks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edge_flags(pixels: DataFrame, height: int, width: int, col: str = "id") -> DataFrame:
    """(z, y, x, rdiff, ddiff): the label differs from the right / lower neighbour. Absent pixels are background 0.

    Each labelled pixel announces itself to both pairs it belongs to per direction; a pair differs when its two sides
    do, or when only one side was announced."""
    p = pixels.where(F.col(col) != 0).select("z", "y", "x", F.col(col).alias("v"))
    ends = F.explode(F.array(
        F.struct(F.lit("r").alias("d"), F.col("y").alias("py"), F.col("x").alias("px")), F.struct(F.lit("r").alias("d"), F.col("y").alias("py"), (F.col("x") - 1).alias("px")),
        F.struct(F.lit("d").alias("d"), F.col("y").alias("py"), F.col("x").alias("px")), F.struct(F.lit("d").alias("d"), (F.col("y") - 1).alias("py"), F.col("x").alias("px"))))
    e = p.select("z", "v", ends.alias("e")).select("z", "v", "e.*").where(
        (F.col("px") >= 0) & (F.col("py") >= 0) & ((F.col("d") != "r") | (F.col("px") < width - 1)) & ((F.col("d") != "d") | (F.col("py") < height - 1)))
    pair = e.groupBy("z", "py", "px", "d").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
    pair = pair.where((F.col("n") == 1) | (F.col("a") != F.col("b")))
    return pair.groupBy("z", F.col("py").alias("y"), F.col("px").alias("x")).agg(F.bool_or(F.col("d") == "r").alias("rdiff"), F.bool_or(F.col("d") == "d").alias("ddiff"))


def boundary_map(pixels: DataFrame, height: int, width: int, col: str = "id") -> DataFrame:
    """Pixels whose label differs from the right or lower neighbour."""
    return edge_flags(pixels, height, width, col).select("z", "y", "x")


def mask(pixels: DataFrame, col: str = "id") -> DataFrame:
    return pixels.where(F.col(col) != 0).select("z", "y", "x")


def downsample_labels(pixels: DataFrame, k: int) -> DataFrame:
    """Stride k, ids untouched."""
    return pixels.where((F.col("y") % k == 0) & (F.col("x") % k == 0)).withColumn("y", F.floor(F.col("y") / k)).withColumn("x", F.floor(F.col("x") / k))


def upsample_labels(pixels: DataFrame, k: int) -> DataFrame:
    """Repeat every pixel k x k."""
    step = F.sequence(F.lit(0), F.lit(k - 1))
    return pixels.withColumn("_i", F.explode(step)).withColumn("_j", F.explode(step)).withColumn("y", F.col("y") * k + F.col("_i")).withColumn("x", F.col("x") * k + F.col("_j")).drop("_i", "_j")


def label_scale(eh: Column, lh: Column) -> Column:
    """Image : label ratio; negative when the label is finer, NULL when neither divides the other."""
    return F.when((lh > 0) & (eh >= lh) & (eh % lh == 0), F.floor(eh / lh)).when((lh > eh) & (lh % eh == 0), -F.floor(lh / eh))


def plane_scale(ey: Column, ex: Column, ly: Column, lx: Column) -> Column:
    """Common integer factor of both axes, NULL when the planes do not fit."""
    ok = (ly > 0) & (lx > 0) & (ey % ly == 0) & (ex % lx == 0)
    return F.when(ok & (F.floor(ey / ly) == F.floor(ex / lx)), F.floor(ey / ly))


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def section_label_stats(pixels: DataFrame, fill: DataFrame, height: int, width: int) -> DataFrame:
    """Per section: background fraction, distinct ids (background counts as one), fraction of the label painted over image fill."""
    total = height * width
    fg = pixels.where("id <> 0").join(fill.select("z", "y", "x", F.lit(1).alias("_f")), ["z", "y", "x"], "left")
    a = fg.groupBy("z").agg(F.count(F.lit(1)).alias("n_fg"), F.count("_f").alias("n_fg_fill"))
    # distinct ids: first distinct (z, id), so one frequent id is one row
    ids = fg.select("z", "id").distinct().groupBy("z").agg(F.count(F.lit(1)).alias("n_id"))
    f = fill.groupBy("z").agg((F.count(F.lit(1)) / total).alias("fill_frac"))
    j = a.join(ids, "z", "left").join(f, "z", "left")
    return j.select("z", (1 - F.col("n_fg") / total).alias("frac_background"), (F.coalesce("n_id", F.lit(0)) + (F.col("n_fg") < total).cast("int")).cast("long").alias("n_ids"),
                    F.when(F.col("n_fg") > 0, F.col("n_fg_fill") / F.col("n_fg")).otherwise(F.lit(0.0)).alias("frac_label_in_fill"), F.coalesce("fill_frac", F.lit(0.0)).alias("fill_frac"))


def section_issues(in_fill_max: float = 0.02, empty_bg: float = 0.999) -> Column:
    """Issue list of a joined (image section, label section) row: em_status, present, corrupt, frac_background, fill_frac, frac_label_in_fill."""
    ok = F.col("em_status") == "ok"
    here = F.col("present") & ~F.col("corrupt")
    return F.array_compact(F.array(
        F.when(~F.col("present") & ok, "label_missing"), F.when(F.col("present") & F.col("corrupt"), "label_corrupt"),
        F.when(here & ok & (F.col("fill_frac") > 0.001) & (F.col("frac_label_in_fill") > in_fill_max), "label_in_fill"),
        F.when(here & ok & (F.col("frac_background") >= empty_bg), "label_empty"),
        F.when(here & ~ok & (1 - F.col("frac_background") > 0.01), "label_without_image")))


def asset_verdict(checked: DataFrame, key: str, alignable: Column) -> DataFrame:
    """Per label asset: fail when it cannot be aligned or a section is corrupt, warn when any section is flagged.

    `alignable` is an aggregate over the asset's rows; a varying `dtype` is reported as inconsistent encoding."""
    flagged = F.size("issues") > 0
    kinds = checked.where("dtype IS NOT NULL").select(key, "dtype").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n_dtypes"))
    a = checked.groupBy(key).agg(F.count(F.lit(1)).alias("n_sections"), F.count_if(flagged).alias("n_flagged"), F.bool_or(F.array_contains("issues", "label_corrupt")).alias("_bad"), alignable.alias("aligned"))
    a = a.join(kinds, key, "left")
    status = F.when(~F.col("aligned") | F.col("_bad"), "fail").when(F.col("n_flagged") > 0, "warn").otherwise("ok")
    return a.select(key, "n_sections", "n_flagged", status.alias("status"), (status != "fail").alias("usable_for_patches"), (F.coalesce("n_dtypes", F.lit(0)) > 1).alias("encoding_inconsistent"))


def mask_conflicts(masks: DataFrame, n_sections: Column | int | None, plane_px: int) -> tuple[DataFrame, DataFrame]:
    """(per section, summary) fraction of pixels claimed by more than one exclusive mask (rows: mask, z, y, x). The mean is over
    `n_sections`, or over the sections that have masks."""
    claimed = masks.select("mask", "z", "y", "x").distinct().groupBy("z", "y", "x").agg(F.count(F.lit(1)).alias("n"))
    per = claimed.groupBy("z").agg((F.count_if(F.col("n") > 1) / plane_px).alias("conflict_frac"))
    worst = F.max("conflict_frac")
    return per, per.agg((F.sum("conflict_frac") / (F.count(F.lit(1)) if n_sections is None else n_sections)).alias("conflict_frac_mean"), worst.alias("conflict_frac_max"), F.when(worst < 0.001, "ok").otherwise("warn").alias("status"))


def readiness(datasets: DataFrame, assets: DataFrame) -> DataFrame:
    """Per dataset and patch type: ready or the reason why not. `assets`: dataset_id, asset_type, path, class, validated, usable."""
    groups = {"gt": ("gt_segmentation",), "pred": ("model_prediction",), "syn": ("synapse_prediction", "gt_annotation"),
              "mito": ("mitochondria_prediction", "organelle_prediction", "gt_annotation")}
    hint = {"gt": None, "pred": None, "syn": "synapse", "mito": "mito"}

    def match(g):
        m = F.col("asset_type").isin(*groups[g])
        if hint[g]:
            m = m & (F.lower("path").contains(hint[g]) | (F.lower(F.coalesce("class", F.lit(""))) == hint[g]))
        return m

    per = assets.groupBy("dataset_id").agg(*[x for g in groups for x in (F.count_if(match(g)).alias(f"{g}_n"), F.count_if(match(g) & F.col("usable")).alias(f"{g}_ok"),
                                                                      F.count_if(match(g) & ~F.col("validated")).alias(f"{g}_new"))])
    d = datasets.select("dataset_id", "has_qc").join(per, "dataset_id", "left").fillna(0)

    def reason(g):
        return F.when(F.col(f"{g}_ok") > 0, F.lit(None)).when(F.col(f"{g}_n") == 0, "not_registered").when(F.col(f"{g}_new") > 0, "not_validated").otherwise("not_usable")

    need = {"failure": None, "segmentation": "gt", "membrane": "gt", "synapse": "syn", "mitochondria": "mito", "hard_negative": "both", "proofreading": "both"}
    rows = []
    for t, g in need.items():
        why = F.when(~F.col("has_qc"), "run_qc_first") if g is None else (
            F.when(F.col("gt_ok") == 0, reason("gt")).otherwise(reason("pred")) if g == "both" else reason(g))
        rows.append(F.struct(F.lit(t).alias("patch_type"), (F.col("has_qc") & why.isNull()).alias("ready"), why.alias("reason")))
    return d.select("dataset_id", F.explode(F.array(*rows)).alias("r")).select("dataset_id", "r.*")
