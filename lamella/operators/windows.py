"""Training windows: around findings, over labels, on mask components; counters and manifests."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import component_stats
from .labels import edge_flags
from .ordered import spread_join
from .sampling import draw_hash, random_offset, with_box


def clamp(v: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo, F.least(v, hi)).cast("long")


def in_windows(points: DataFrame, windows: DataFrame, cell: int = 64) -> DataFrame:
    """Points (z, y, x) met with every window (zc, y0..x1) that holds them, through an equality join on (section, grid cell)."""
    def span(a):
        return F.explode(F.sequence(F.floor(F.col(f"{a}0") / cell).cast("long"), F.floor((F.col(f"{a}1") - 1) / cell).cast("long")))

    w = windows.withColumn("_cy", span("y")).withColumn("_cx", span("x"))
    p = points.withColumn("_cy", F.floor(F.col("y") / cell).cast("long")).withColumn("_cx", F.floor(F.col("x") / cell).cast("long"))
    inside = (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))
    return p.join(w.withColumnRenamed("zc", "z"), ["z", "_cy", "_cx"]).where(inside).drop("_cy", "_cx")


def failure_windows(findings: DataFrame, blocks: DataFrame | None, size: tuple[int, int, int], n: int | None = None, min_sev: int = 1, seed: int = 0) -> DataFrame:
    """Windows centred on findings; boxes (bx0..by1) centre the window, findings without one get a random spot.

    Only the first of equal (block, window, failure) survives; with `n`, the best `n` over all blocks, worst first. Without `blocks` the findings
    have their block's columns already."""
    dz, dy, dx = size
    fits = (F.col("z_end") - F.col("z_start") >= dz) & (F.col("y_end") - F.col("y_start") >= dy) & (F.col("x_end") - F.col("x_start") >= dx)
    f = findings.where((F.col("sev") >= min_sev) & F.col("z").isNotNull())
    j = f.where(fits) if blocks is None else spread_join(f, blocks.where(fits), ["block_id"], F.floor(F.col("z") / 1024).cast("long"))
    key = [F.col("block_id"), F.col("z"), F.col("failure_type")]
    z0 = clamp(F.col("z") - dz // 2, F.col("z_start"), F.col("z_end") - dz)
    y0 = F.when(F.col("by0").isNotNull(), clamp((F.col("by0") + F.col("by1")) / 2 - dy / 2, F.col("y_start"), F.col("y_end") - dy)).otherwise(random_offset(seed, F.col("y_start"), F.col("y_end") - dy + 1, *key))
    x0 = F.when(F.col("bx0").isNotNull(), clamp((F.col("bx0") + F.col("bx1")) / 2 - dx / 2, F.col("x_start"), F.col("x_end") - dx)).otherwise(random_offset(seed + 1, F.col("x_start"), F.col("x_end") - dx + 1, *key))
    j = j.withColumn("z0", z0).withColumn("y0", y0).withColumn("x0", x0)
    first = j.groupBy("block_id", "z0", "y0", "x0", "failure_type").agg(F.min(F.struct((-F.col("sev")).alias("o"), "z", "check_name", "score", "grade")).alias("f"))
    flat = first.select("block_id", "z0", "y0", "x0", "failure_type", (-F.col("f.o")).alias("sev"), F.col("f.z").alias("z_center"), F.col("f.check_name").alias("check_name"),
                        F.col("f.score").alias("score"), F.col("f.grade").alias("grade"))
    if n is not None:
        flat = flat.orderBy(F.col("sev").desc(), "z_center", "check_name", "block_id", "failure_type").limit(n)
    return with_box(flat, size)


def candidate_windows(windows: DataFrame, blocks: DataFrame, size: tuple[int, int, int], budget: int, seed: int = 0, dedupe: int = 8) -> DataFrame:
    """At most `budget` random windows over the allowed (block, z0), one per `dedupe`-pixel cell; few windows are drawn several times."""
    dz, dy, dx = size
    fit = blocks.where((F.col("y_end") - F.col("y_start") >= dy) & (F.col("x_end") - F.col("x_start") >= dx))
    key = [F.col("block_id"), F.col("z0"), F.col("_round")]
    cand = spread_join(windows, fit, ["block_id"], F.floor(F.col("z0") / 4096).cast("long"))
    rounds = max(1, -(-budget // max(1, cand.count())))
    c = cand.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("_h", draw_hash(seed, *key))
    c = c.withColumn("y0", random_offset(seed + 1, F.col("y_start"), F.col("y_end") - dy + 1, *key)).withColumn("x0", random_offset(seed + 2, F.col("x_start"), F.col("x_end") - dx + 1, *key))
    c = c.orderBy("_round", "_h", "block_id", "z0").limit(budget)
    first = c.groupBy("block_id", "z0", F.floor(F.col("y0") / dedupe), F.floor(F.col("x0") / dedupe)).agg(F.min(F.struct("_h", "y0", "x0")).alias("f"))
    c = first.select("block_id", "z0", "f.*")
    return with_box(c, size).withColumn("zc", F.col("z0") + dz // 2).withColumn("window_id", F.concat_ws(":", "block_id", "z0", "y0", "x0"))


def drawn(windows: DataFrame, blocks: DataFrame, size: tuple[int, int, int], accepted, n: int, seed: int = 0, dedupe: int = 8) -> DataFrame:
    """The first `n` windows that `accepted` (candidates -> accepted candidates) lets through. Draws are made anew with four times the budget
    until `n` are accepted or a larger budget brings no new candidate; earlier candidates come first in every round."""
    budget, seen = 8 * n, -1
    while True:
        candidates = cut_lineage(candidate_windows(windows, blocks, size, budget, seed, dedupe))
        good = cut_lineage(accepted(candidates))
        now = candidates.count()
        if now == seen or good.count() >= n:
            return good.orderBy("_h", "window_id").limit(n)
        budget, seen = 4 * budget, now


def label_evidence(candidates: DataFrame, pixels: DataFrame, height: int, width: int, col: str = "id") -> DataFrame:
    """Per window, from its centre section: foreground fraction, distinct ids, boundary fraction."""
    w = candidates.select("window_id", "zc", "y0", "y1", "x0", "x1")
    area = (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))

    def within(p):
        return in_windows(p, w)

    fg = within(pixels.where(F.col(col) != 0).select("z", "y", "x", F.col(col).alias("v")))
    per_id = fg.groupBy("window_id", "v").agg(F.count(F.lit(1)).alias("n"))
    ids = per_id.groupBy("window_id").agg(F.sum("n").alias("n_fg"), F.count(F.lit(1)).alias("n_ids"))
    e = within(edge_flags(pixels, height, width, col))
    inner = (F.col("rdiff") & (F.col("x") + 1 < F.col("x1"))) | (F.col("ddiff") & (F.col("y") + 1 < F.col("y1")))
    bd = e.where(inner).groupBy("window_id").agg(F.count(F.lit(1)).alias("n_bd"))
    j = candidates.join(ids, "window_id", "left").join(bd, "window_id", "left")
    return j.withColumn("fg_frac", F.coalesce(F.col("n_fg"), F.lit(0)) / area).withColumn("n_ids", F.coalesce("n_ids", F.lit(0)).cast("long")).withColumn(
        "boundary_frac", F.coalesce(F.col("n_bd"), F.lit(0)) / area).drop("n_fg", "n_bd")


def accept_windows(evidence: DataFrame, patch_type: str, min_fg: float = 0.3, min_ids: int = 2, min_boundary: float = 0.02) -> DataFrame:
    """Windows whose evidence holds for the patch type."""
    ok = (F.col("fg_frac") >= min_fg) & (F.col("n_ids") >= min_ids) if patch_type == "segmentation" else F.col("boundary_frac") >= min_boundary
    return evidence.where(ok)


def disagreement(candidates: DataFrame, truth: DataFrame, prediction: DataFrame, height: int, width: int) -> DataFrame:
    """Per window: half foreground disagreement plus half boundary disagreement between two label planes (rows z, y, x, id)."""
    w = candidates.select("window_id", "zc", "y0", "y1", "x0", "x1")
    area = (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))

    def within(p):
        return in_windows(p, w)

    px = ["z", "y", "x"]
    a = truth.where("id <> 0").select(*px, F.lit(True).alias("a"))
    b = prediction.where("id <> 0").select(*px, F.lit(True).alias("b"))
    fg = within(a.join(b, px, "full_outer").where(F.col("a").isNull() | F.col("b").isNull())).groupBy("window_id").agg(F.count(F.lit(1)).alias("n_fg"))
    ea = edge_flags(truth, height, width).select(*px, F.col("rdiff").alias("ar"), F.col("ddiff").alias("ad"))
    eb = edge_flags(prediction, height, width).select(*px, F.col("rdiff").alias("br"), F.col("ddiff").alias("bd"))
    e = within(ea.join(eb, px, "full_outer"))

    def on(r, d):
        return (F.coalesce(F.col(r), F.lit(False)) & (F.col("x") + 1 < F.col("x1"))) | (F.coalesce(F.col(d), F.lit(False)) & (F.col("y") + 1 < F.col("y1")))

    bd = e.where(on("ar", "ad") != on("br", "bd")).groupBy("window_id").agg(F.count(F.lit(1)).alias("n_bd"))
    j = candidates.join(fg, "window_id", "left").join(bd, "window_id", "left")
    fgd, bdd = F.coalesce(F.col("n_fg"), F.lit(0)) / area, F.coalesce(F.col("n_bd"), F.lit(0)) / area
    return j.withColumn("fg_disagreement", fgd).withColumn("boundary_disagreement", bdd).withColumn("disagreement", 0.5 * fgd + 0.5 * bdd).drop("n_fg", "n_bd")


def proofreading(scored: DataFrame, n: int) -> DataFrame:
    """The `n` most disagreeing windows with their rank."""
    top = scored.orderBy(F.col("disagreement").desc(), "window_id").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("disagreement").desc(), "window_id")))  # at most n rows


def mask_component_windows(labelled: DataFrame, mask_px: DataFrame, windows: DataFrame, blocks: DataFrame, size: tuple[int, int, int], n: int, min_mask: float = 0.002, dedupe: int = 16, cell: int = 1024) -> DataFrame:
    """Windows centred on mask components of an allowed window's centre section, largest first.

    `labelled` holds (block_id, z, y, x, component) in block coordinates of the same frame as `blocks`."""
    dz, dy, dx = size
    at = lambda v: F.floor(v / cell).cast("long")  # noqa: E731 - a component meets the blocks of its own grid cell only
    c = component_stats(labelled).withColumn("_gy", at(F.col("my"))).withColumn("_gx", at(F.col("mx")))
    zs = spread_join(windows.select((F.col("z0") + dz // 2).alias("z"), "block_id", "z0"), blocks, ["block_id"], F.floor(F.col("z0") / 4096).cast("long"))
    for a in "yx":
        zs = zs.withColumn(f"_g{a}", F.explode(F.sequence(at(F.col(f"{a}_start")), at(F.col(f"{a}_end") - 1))))
    cand = c.join(zs, ["z", "_gy", "_gx"])
    inside = (F.col("my") >= F.col("y_start")) & (F.col("my") < F.col("y_end")) & (F.col("mx") >= F.col("x_start")) & (F.col("mx") < F.col("x_end"))
    y0 = clamp(F.col("my") - dy / 2, F.col("y_start"), F.col("y_end") - dy)
    x0 = clamp(F.col("mx") - dx / 2, F.col("x_start"), F.col("x_end") - dx)
    cand = cand.where(inside).withColumn("wy", y0).withColumn("wx", x0)
    one = cand.groupBy("block_id", "z0", F.floor(F.col("wy") / dedupe).alias("_a"), F.floor(F.col("wx") / dedupe).alias("_b")).agg(
        F.min(F.struct((-F.col("size")).alias("o"), "component", "wy", "wx", "z")).alias("f"))
    # the mask fraction only needs the pixels near the chosen windows: meet them on (z, 64-pixel cell)
    w = one.select("block_id", "z0", (-F.col("f.o")).alias("component_px"), F.col("f.component").alias("component"), F.col("f.wy").alias("y0"), F.col("f.wx").alias("x0"), F.col("f.z").alias("z"))
    cells = w.withColumn("_cy", F.explode(F.sequence(F.floor(F.col("y0") / 64), F.floor((F.col("y0") + dy - 1) / 64)))).withColumn(
        "_cx", F.explode(F.sequence(F.floor(F.col("x0") / 64), F.floor((F.col("x0") + dx - 1) / 64))))
    m = mask_px.select("z", F.col("y").alias("_y"), F.col("x").alias("_x"), F.floor(F.col("y") / 64).alias("_cy"), F.floor(F.col("x") / 64).alias("_cx"))
    hits = cells.join(m, ["z", "_cy", "_cx"]).where(F.col("_y").between(F.col("y0"), F.col("y0") + dy - 1) & F.col("_x").between(F.col("x0"), F.col("x0") + dx - 1))
    frac = hits.groupBy("block_id", "z0", "y0", "x0", "z", "component", "component_px").agg((F.count(F.lit(1)) / float(dy * dx)).alias("mask_frac"))
    return with_box(frac.where(F.col("mask_frac") >= min_mask).orderBy(F.col("component_px").desc(), "component", "z0", "block_id").limit(n), size)


def set_counters(patches: DataFrame) -> DataFrame:
    """Counts by partition, block, failure type and grade in one pass."""
    dims = ["partition", "block_id", "failure_type", "grade"]
    g = patches.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    name = F.when(F.col("_g") == 7, "partition").when(F.col("_g") == 11, "block").when(F.col("_g") == 13, "failure_type").otherwise("grade")
    return g.select(name.alias("counter"), F.coalesce(*dims).alias("value"), "n").where("value IS NOT NULL")


def manifest_urls(patches: DataFrame, label_asset: Column | None) -> DataFrame:
    """Image and label request paths; the label is derived as boundary, mask or ids by patch type."""
    q = F.format_string("z0=%d&z1=%d&y0=%d&y1=%d&x0=%d&x1=%d", "z0", "z1", "y0", "y1", "x0", "x1")
    derive = F.when(F.col("patch_type") == "membrane", "boundary").when(F.col("patch_type").isin("synapse", "mitochondria"), "mask").otherwise("ids")
    base = F.concat(F.lit("/api/v1/data/"), "dataset_id")
    out = patches.withColumn("url_em", F.concat(base, F.lit("/cutout?"), q, F.lit("&fmt=npy")))
    if label_asset is not None:
        out = out.withColumn("url_label", F.when(label_asset.isNotNull(), F.concat(base, F.lit("/labels/"), label_asset.cast("string"), F.lit("/cutout?"), q, F.lit("&derive="), derive)))
    return out


PACK_LEVELS = {"raw": ("slice", "segment", "patch"), "qc": ("slice", "patch"), "segmentation": ("slice", "segment", "patch"), "membrane": ("slice", "segment", "patch"),
               "synapse": ("slice", "segment", "patch"), "mitochondria": ("slice", "segment", "patch"), "hard_negative": ("patch",), "proofreading": ("patch",)}


def pack_plan(capacity: DataFrame, ready: DataFrame, label_bytes: dict | None = None) -> DataFrame:
    """Task x level matrix: applicable, reason, count, bytes.

    `capacity`: (dataset_id, level, n, n_qc, px) sample counts and pixels per level; `ready`: (dataset_id, patch_type, ready, reason)."""
    extra = label_bytes or {"raw": 0, "qc": 0, "segmentation": 4, "membrane": 1, "synapse": 1, "mitochondria": 1, "hard_negative": 4, "proofreading": 4}
    tasks = F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.array(*[F.lit(lv) for lv in lvs]).alias("_lv"), F.lit(extra[t]).alias("_lb"),
                                         F.lit("failure" if t in ("raw", "qc") else t).alias("patch_type")) for t, lvs in PACK_LEVELS.items()]))
    m = capacity.select("*", tasks.alias("t")).select("dataset_id", "level", "n", "n_qc", "px", "t.*")
    m = m.join(ready.withColumnRenamed("reason", "_why"), ["dataset_id", "patch_type"], "left")
    ok = F.array_contains("_lv", F.col("level"))
    count = F.when(ok & F.col("ready"), F.when(F.col("task") == "qc", F.col("n_qc")).otherwise(F.col("n"))).otherwise(F.lit(0))
    m = m.withColumn("count", count)
    why = F.when(~ok, "no_such_level").when(~F.col("ready"), F.col("_why")).when(F.col("count") == 0, "nothing_fits")
    return m.select("dataset_id", "task", "level", ok.alias("applicable"), (F.col("count") > 0).alias("ready"), why.alias("reason"), F.col("count").alias("n"), (F.col("count") * F.col("px") * (1 + F.col("_lb"))).alias("est_bytes"))
