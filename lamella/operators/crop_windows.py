"""Square crops of planes of a volume: forbidden areas as runs, sums over grid cells, greedy packing by rounds, seams of what was chosen."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from .label_runs import PLANE


def candidates(planes: DataFrame, forbidden: DataFrame, size: int, stride: int) -> DataFrame:
    """plane, y0, x0, n_bad of every window on the grid of `stride`. `planes`: dataset, block, z, height, width; `forbidden`: runs. `size` is a
    multiple of `stride`.

    Forbidden pixels are counted per grid cell (runs are cut at cell borders, no pixel is a row); a window's count is a sum over
    rows and then over columns of cells, so its cost does not grow with size / stride."""
    if size % stride:
        raise ValueError("size must be a multiple of stride")
    k = size // stride
    cell = F.explode(F.sequence(F.floor(F.col("x0") / stride), F.floor((F.col("x1") - 1) / stride)))
    cut = forbidden.select(*PLANE, F.floor(F.col("y") / stride).alias("cy"), "x0", "x1", cell.alias("cx"))
    part = F.least("x1", (F.col("cx") + 1) * stride) - F.greatest("x0", F.col("cx") * stride)
    bad = cut.groupBy(*PLANE, "cy", "cx").agg(F.sum(part).alias("bad"))
    rows = planes.where((F.col("height") >= size) & (F.col("width") >= size))
    rows = rows.withColumn("cy", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("height") / stride) - 1)))
    grid = rows.withColumn("cx", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("width") / stride) - 1)))
    grid = grid.join(bad, [*PLANE, "cy", "cx"], "left").fillna(0, ["bad"])
    along = Window.partitionBy(*PLANE, "cy").orderBy("cx").rowsBetween(0, k - 1)
    down = Window.partitionBy(*PLANE, "cx").orderBy("cy").rowsBetween(0, k - 1)
    grid = grid.withColumn("bad", F.sum("bad").over(along)).withColumn("n_bad", F.sum("bad").over(down))
    y0, x0 = F.col("cy") * stride, F.col("cx") * stride
    return grid.where((y0 <= F.col("height") - size) & (x0 <= F.col("width") - size)).select(*PLANE, y0.alias("y0"), x0.alias("x0"), "n_bad")


def _spread(grid: np.ndarray, k: int) -> np.ndarray:
    """Minimum over the neighbours that a window overlaps: less than k grid steps away on both axes."""
    for axis in (0, 1):
        out, n = grid.copy(), grid.shape[axis]
        for d in range(1, min(k, n)):
            a, b = [slice(None)] * 2, [slice(None)] * 2
            a[axis], b[axis] = slice(d, None), slice(None, n - d)
            out[tuple(a)] = np.minimum(out[tuple(a)], grid[tuple(b)])
            out[tuple(b)] = np.minimum(out[tuple(b)], grid[tuple(a)])
        grid = out
    return grid


def pack(valid: DataFrame, size: int, stride: int) -> DataFrame:
    """The greedy choice of windows that do not overlap (aligned to `size` first, then by distance from alignment, then y0, x0): plane, y0, x0.

    A window is taken as soon as it precedes every open window that overlaps it; all such windows of a round are taken together, what they
    overlap is closed, and rounds go on until none is open. That is the result of the loop over all windows. A group is
    the grid of one plane."""
    k = size // stride

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y0"].to_numpy(), pdf["x0"].to_numpy()
        oy, ox = y % size, x % size
        rank = np.empty(len(y), np.int64)
        rank[np.lexsort((x, y, oy + ox, ~((oy == 0) & (ox == 0))))] = np.arange(len(y))
        none = len(y)
        gy, gx = y // stride, x // stride
        grid = np.full((gy.max() + 1, gx.max() + 1), none)
        grid[gy, gx] = rank
        taken = np.zeros(grid.shape, bool)
        while (grid < none).any():
            now = (grid < none) & (grid == _spread(grid, k))
            taken |= now
            grid[_spread(np.where(now, 0, 1), k) == 0] = none
        cy, cx = np.nonzero(taken)
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in PLANE}, "y0": cy * stride, "x0": cx * stride})

    return valid.select(*PLANE, "y0", "x0").groupBy(*PLANE).applyInPandas(run, "dataset string, block string, z long, y0 long, x0 long")


def seams(crops: DataFrame, images: DataFrame, size: int, band: int = 16) -> DataFrame:
    """crops with `seam`, the strongest brightness step between neighbouring bands. `images`: plane, h, w, payload (8 bit). A plane meets the
    list of its crops, whose length its grid bounds."""
    listed = crops.groupBy(*PLANE).agg(F.collect_list(F.struct("y0", "x0")).alias("crops"))

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                a = np.frombuffer(r.payload, np.uint8).reshape(r.h, r.w)
                rows += [(r.dataset, r.block, r.z, c["y0"], c["x0"], K.seam_step(a[c["y0"] : c["y0"] + size, c["x0"] : c["x0"] + size], band)) for c in r.crops]
            yield pd.DataFrame(rows, columns=[*PLANE, "y0", "x0", "seam"])

    j = images.select(*PLANE, "h", "w", "payload").join(listed, PLANE)
    return j.mapInPandas(run, "dataset string, block string, z long, y0 long, x0 long, seam double")


def report(planes: DataFrame, found: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """Per block: sections, those without a crop, those with forbidden areas, crops, kept fraction of the used sections, median and largest seam.
    `found`: candidates(); `chosen`: seams()."""
    from .ordered import exact_percentiles

    worst = found.groupBy(*PLANE).agg(F.max("n_bad").alias("worst"))
    n = chosen.groupBy(*PLANE).agg(F.count(F.lit(1)).alias("n"))
    j = planes.join(worst, PLANE, "left").join(n, PLANE, "left").fillna(0, ["n", "worst"])
    used = F.when(F.col("n") > 0, F.col("height") * F.col("width"))
    out = j.groupBy("dataset", "block").agg(F.count(F.lit(1)).alias("n_sections"), F.count_if(F.col("n") == 0).alias("n_dropped"), F.count_if(F.col("worst") > 0).alias("n_cut"),
                                            F.sum("n").alias("n_crops"), (F.sum("n") * float(size * size) / F.sum(used)).alias("kept_frac"))
    middle = exact_percentiles(chosen, ["dataset", "block"], "seam", {"seam_median": 0.5})
    top = chosen.groupBy("dataset", "block").agg(F.max("seam").alias("seam_max"))
    return out.join(middle, ["dataset", "block"], "left").join(top, ["dataset", "block"], "left")
