"""Plane operations on pixel rows or small arrays: downsampling, seams, dark lines, crop packing, mask consolidation and linking."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..session import cut_lineage
from .ordered import range_rows
from .windows import in_windows


def block_mean(pixels: DataFrame, factor: int, height: int, width: int, top: float, col: str = "id") -> DataFrame:
    """Mean of factor x factor cells of a sparse plane (absent pixels count as 0), cropped to whole cells, scaled by `top`."""
    p = pixels.where((F.col("y") < height // factor * factor) & (F.col("x") < width // factor * factor))
    cell = [F.floor(F.col(a) / factor).cast("long").alias(a) for a in "yx"]
    return p.groupBy("z", *cell).agg((F.sum(col) / float(factor * factor) / top).alias("v"))


def pixel_rows(planes: DataFrame, keys: list[str]) -> DataFrame:
    """Row-major arrays (`px`, `w`) as pixel rows y, x, v."""
    e = planes.select(*keys, "w", F.posexplode("px").alias("i", "v"))
    return e.select(*keys, F.floor(F.col("i") / F.col("w")).cast("long").alias("y"), (F.col("i") % F.col("w")).cast("long").alias("x"), F.col("v").cast("double").alias("v"))


def saturation_boxes(planes: DataFrame, keys: list[str], low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Bounding box of the saturated thumbnail pixels of each section."""
    p = pixel_rows(planes, keys).where((F.col("v") <= low) | (F.col("v") >= high))
    return p.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_px"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))


def _per_plane(planes: DataFrame, keys: list[str], out: str, fn) -> DataFrame:
    types = dict(planes.dtypes)

    def run(batches):
        for pdf in batches:
            vals = [fn(np.asarray(px, dtype=np.float64).reshape(h, w)) for px, h, w in zip(pdf["px"], pdf["h"], pdf["w"])]
            yield pdf[keys].assign(**{out.split()[0]: vals})

    return planes.select(*keys, "h", "w", F.col("px").cast("array<double>").alias("px")).mapInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", " + out)


def seam_steps(planes: DataFrame, keys: list[str], band: int = 16) -> DataFrame:
    """Strongest step between adjacent bands of the row and column profiles (255 = full scale)."""
    return _per_plane(planes, keys, "seam double", lambda a: K.seam_step(a, band))


def dark_lines(planes: DataFrame, keys: list[str], window: int = 63, sigma: float = 1.0, eps: float = 4.0) -> DataFrame:
    """How much darker each pixel is than its neighbourhood, in local standard deviations."""
    def score(a):
        f = K.gaussian(a, sigma) if sigma else a
        mu = K.box_mean(f, window)
        sd = np.sqrt(np.maximum(K.box_mean(f * f, window) - mu * mu, 0.0))
        return ((mu - f) / (sd + eps)).ravel().tolist()

    return _per_plane(planes, keys, "score array<double>", score)


# ----------------------------------------------------------------------------- crop packing


def crop_candidates(sections: DataFrame, forbidden: DataFrame, height: int, width: int, size: int, stride: int | None = None) -> DataFrame:
    """Candidate windows of each section with the number of forbidden pixels inside and their greedy order key."""
    step = stride or max(size // 8, 64)
    g = range_rows(range_rows(sections.select("z").distinct(), F.lit(0), F.lit(height - size + 1), step, "y0"), F.lit(0), F.lit(width - size + 1), step, "x0")
    g = g.withColumn("y1", F.col("y0") + size).withColumn("x1", F.col("x0") + size)
    hit = in_windows(forbidden.select("z", "y", "x"), g.withColumnRenamed("z", "zc"), max(size, 16)).groupBy("z", "y0", "x0").agg(F.count(F.lit(1)).alias("n_bad"))
    g = g.join(hit, ["z", "y0", "x0"], "left").fillna(0, ["n_bad"])
    oy, ox = F.col("y0") % size, F.col("x0") % size
    return g.withColumn("aligned", (oy == 0) & (ox == 0)).withColumn("offset", oy + ox)


def pack_crops(candidates: DataFrame, size: int) -> DataFrame:
    """Greedy non-overlapping choice per section, grid-aligned windows first.

    Only valid candidates travel, at most (plane / stride)^2 per section, which bounds the group."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["aligned", "offset", "y0", "x0"], ascending=[False, True, True, True])
        taken: list[tuple[int, int]] = []
        for y, x in zip(pdf["y0"], pdf["x0"]):
            if all(abs(y - a) >= size or abs(x - b) >= size for a, b in taken):
                taken.append((y, x))
        return pd.DataFrame({"z": pdf["z"].iloc[0], "y0": [t[0] for t in taken], "x0": [t[1] for t in taken]})

    ok = candidates.where("n_bad = 0").select("z", "y0", "x0", "aligned", "offset")
    return ok.groupBy("z").applyInPandas(run, "z long, y0 long, x0 long")


def crop_report(crops: DataFrame, candidates: DataFrame, size: int, plane_px: int) -> DataFrame:
    """Kept fraction of the used sections, sections without any crop, sections with forbidden areas."""
    s = candidates.groupBy("z").agg(F.max("n_bad").alias("worst"))
    c = crops.groupBy("z").agg(F.count(F.lit(1)).alias("n"))
    j = s.join(c, "z", "left").fillna(0, ["n"])
    return j.agg(F.count(F.lit(1)).alias("n_sections"), F.count_if(F.col("n") == 0).alias("n_dropped"), F.count_if(F.col("worst") > 0).alias("n_cut"), F.sum("n").alias("n_crops"),
                 (F.sum(F.col("n") * float(size * size)) / F.sum(F.when(F.col("n") > 0, F.lit(float(plane_px))))).alias("kept_frac"))


# ----------------------------------------------------------------------------- mask consolidation


def consolidate_masks(masks: DataFrame, allowed: DataFrame | None, min_area: int = 300, min_frac: float = 0.5, keys: tuple[str, ...] = ("block_id", "z")) -> DataFrame:
    """One label per pixel from overlapping masks: largest mask first, each pixel once, only where allowed.

    Masks mostly outside the allowed area are dropped before anything is grouped; then a section of a block (a bounded
    plane tile and its masks) is painted in order. `masks`: keys, mask, y, x; `allowed`: keys, y, x or None for everywhere."""
    keys = list(keys)
    px = [*keys, "mask", "y", "x"]
    m = masks.select(*px).distinct()
    m = m.join(allowed.select(*keys, "y", "x", F.lit(True).alias("_ok")), [*keys, "y", "x"], "left") if allowed is not None else m.withColumn("_ok", F.lit(True))
    area = m.groupBy(*keys, "mask").agg(F.count(F.lit(1)).alias("area"), F.count("_ok").alias("inside"))
    live = area.where(F.col("inside") / F.col("area") >= min_frac).select(*keys, "mask", "area")
    m = m.where("_ok").drop("_ok").join(live, [*keys, "mask"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["area", "mask"], ascending=[False, True])
        taken: set[tuple[int, int]] = set()
        out, label = [], 0
        for _, g in pdf.groupby(["area", "mask"], sort=False):
            free = [(y, x) for y, x in zip(g["y"], g["x"]) if (y, x) not in taken]
            if len(free) >= min_area:
                label += 1
                taken.update(free)
                out.extend((y, x, label) for y, x in free)
        res = pd.DataFrame(out, columns=["y", "x", "label"])
        for k in keys:
            res[k] = pdf[k].iloc[0]
        return res

    return m.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {dict(masks.dtypes)[k]}" for k in keys) + ", y long, x long, label long")


def overlap_iou(cur: DataFrame, ref: DataFrame, keys: list[str], cur_id: str, ref_id: str) -> DataFrame:
    """IoU of every overlapping (current, reference) object pair on one plane; sizes are counted over the whole plane."""
    cs = cur.groupBy(*keys, cur_id).agg(F.count(F.lit(1)).alias("_cn"))
    rs = ref.groupBy(*keys, ref_id).agg(F.count(F.lit(1)).alias("_rn"))
    both = cur.join(ref, [*keys, "y", "x"]).groupBy(*keys, cur_id, ref_id).agg(F.count(F.lit(1)).alias("_n"))
    j = both.join(cs, [*keys, cur_id]).join(rs, [*keys, ref_id])
    return j.select(*keys, cur_id, ref_id, (F.col("_n") / (F.col("_cn") + F.col("_rn") - F.col("_n"))).alias("iou"))


def best_links(iou: DataFrame, keys: list[str], cur_id: str, ref_id: str, min_iou: float) -> DataFrame:
    """One-to-one links: each object's best partner, kept by the first object (smallest label) that claims it."""
    best = iou.groupBy(*keys, cur_id).agg(F.max(F.struct("iou", (-F.col(ref_id)).alias("_r"))).alias("b"))
    best = best.select(*keys, cur_id, (-F.col("b._r")).alias(ref_id), F.col("b.iou").alias("iou")).where(F.col("iou") >= min_iou)
    return best.groupBy(*keys, ref_id).agg(F.min(cur_id).alias(cur_id), F.min_by("iou", cur_id).alias("iou"))


def link_sections(labels: DataFrame, z_values: list[int], min_iou: float = 0.3, gap: int = 2, key: str = "block_id") -> DataFrame:
    """Global ids for section labels: an object continues the object it overlaps most in the section before; where that section
    is background, the one `gap` back counts. Steps along z are inherently ordered; each step is one distributed join over all blocks.

    `labels`: key, z, y, x, label. Returns key, z, label, gid."""
    lab = cut_lineage(labels)
    known = None
    recent: list[int] = []
    for z in z_values:
        cur = lab.where(F.col("z") == z).select(key, "y", "x", "label")
        fresh = F.lit(z).cast("long") * (1 << 32) + F.col("label")
        objects = cur.select(key, "label").distinct()
        ref = None
        for back in recent:  # newest first; an older section only fills background
            part = lab.where(F.col("z") == back).join(known.where(F.col("z") == back).select(key, "label", "gid"), [key, "label"]).select(key, "y", "x", "gid")
            ref = part if ref is None else ref.unionByName(part.join(ref.select(key, "y", "x"), [key, "y", "x"], "left_anti"))
        if ref is None:
            now = objects.select(key, F.lit(z).cast("long").alias("z"), "label", fresh.alias("gid"))
        else:
            links = best_links(overlap_iou(cur, ref, [key], "label", "gid"), [key], "label", "gid", min_iou)
            now = objects.join(links.select(key, "label", F.col("gid").alias("_g")), [key, "label"], "left").select(
                key, F.lit(z).cast("long").alias("z"), "label", F.coalesce("_g", fresh).alias("gid"))
        known = cut_lineage(now if known is None else known.unionByName(now))
        recent = ([z] + recent)[:gap]
    return lab.select(key, "z", "label", F.col("label").alias("gid")) if known is None else known
