"""Connected components of labelled pixels.

Pixels are first joined inside fixed tiles (bounded groups, NumPy), so only components that touch a tile edge remain
open. Their edges go through alternating large-star / small-star rounds, checkpointed, until nothing changes."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import spread_join

TILE = 128
_Y, _Z = 1 << 24, 1 << 44  # pixel code: z, y, x packed into one long (x and y below 2^20, z below 2^18)


def pixel_code(z: Column, y: Column, x: Column) -> Column:
    """One long per pixel; a coordinate that does not fit fails the query instead of meeting another pixel's code."""
    fits = z.between(0, (1 << 18) - 1) & y.between(0, (1 << 20) - 1) & x.between(0, (1 << 20) - 1)
    code = z.cast("long") * _Z + y.cast("long") * _Y + x.cast("long")
    return F.when(fits, code).otherwise(F.raise_error(F.concat(F.lit("pixel out of range: "), F.concat_ws(",", z, y, x))).cast("long"))


def id_code(v: Column) -> Column:
    """Unsigned 64-bit ids, shifted into a signed long."""
    return (v.cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")


def id_of(code: Column, kind: str) -> Column:
    return (code.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast(kind)


def _label_tile(connectivity: int):
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        v = pdf["v"].to_numpy()
        y0, x0 = y.min(), x.min()
        grid = np.full((y.max() - y0 + 3, x.max() - x0 + 3), -1, dtype=np.int64)
        # visit in raster order, so the root of a component is its first pixel
        order = np.lexsort((x, y))
        y, x, v = y[order], x[order], v[order]
        idx = np.arange(len(y))
        grid[y - y0 + 1, x - x0 + 1] = idx
        a, b = [], []
        for dy, dx in steps:
            other = grid[y - y0 + 1 + dy, x - x0 + 1 + dx]
            hit = (other >= 0) & (v[np.maximum(other, 0)] == v)
            a.append(idx[hit])
            b.append(other[hit])
        a, b = np.concatenate(a), np.concatenate(b)
        root = idx.copy()
        while len(a):
            ra, rb = root[a], root[b]
            open_ = ra != rb
            if not open_.any():
                break
            hi, lo = np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_]
            np.minimum.at(root, hi, lo)
            while True:
                nxt = root[root]
                if (nxt == root).all():
                    break
                root = nxt
        code = pdf["code"].to_numpy()[order]
        return pd.DataFrame({"code": code, "z": pdf["z"].to_numpy()[order], "y": y, "x": x, "v": v, "local": code[root]})

    return run


def _star_rounds(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root) with root the smallest node of the component."""
    salt = F.pmod(F.xxhash64("v"), F.lit(64))
    e = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(both, low, ["u"], salt).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, low, ["u"], salt)
        e = cut_lineage(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def label_components(pixels: DataFrame, connectivity: int = 8, value: str | None = None, tile: int = TILE) -> DataFrame:
    """(z, y, x[, value]) -> the same pixels with `component`, the code of the component's first pixel in raster order.

    Only pixels with equal `value` connect; without `value` every listed pixel is foreground."""
    v = id_code(F.col(value)) if value else F.lit(1).cast("long")
    p = pixels.select(F.col("z").cast("long").alias("z"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), v.alias("v"))
    p = p.withColumn("code", pixel_code(F.col("z"), F.col("y"), F.col("x")))
    tiles = [F.floor(F.col("y") / tile).alias("ty"), F.floor(F.col("x") / tile).alias("tx")]
    local = p.groupBy("z", *tiles).applyInPandas(_label_tile(connectivity), "code long, z long, y long, x long, v long, local long")
    local = cut_lineage(local)  # read three times below
    edge = (F.pmod("y", F.lit(tile)).isin(0, tile - 1)) | (F.pmod("x", F.lit(tile)).isin(0, tile - 1))
    rim = local.where(edge)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in steps]))
    near = rim.select("z", "y", "x", "v", F.col("local").alias("a"), moves.alias("m")).select(
        "z", (F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x"), "v", "a")
    cross = near.join(rim.select("z", "y", "x", "v", F.col("local").alias("b")), ["z", "y", "x", "v"]).select("a", "b").where("a <> b")
    roots = _star_rounds(cross)
    salt = F.pmod(F.xxhash64("code"), F.lit(64))
    named = spread_join(local, roots.select(F.col("node").alias("local"), "root"), ["local"], salt, "left")
    return named.select("z", "y", "x", *([id_of(F.col("v"), pixels.schema[value].dataType.simpleString()).alias(value)] if value else []), F.coalesce("root", "local").alias("component"))


def component_stats(labelled: DataFrame, extra: list | None = None) -> DataFrame:
    """Per component: size, box, centroid, elongation (ratio of principal axes of the coordinates)."""
    y, x = F.col("y").cast("double"), F.col("x").cast("double")
    s = labelled.groupBy("z", "component").agg(
        F.count(F.lit(1)).alias("size"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"),
        F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_samp(y).alias("vy"), F.var_samp(x).alias("vx"), F.covar_samp(y, x).alias("cyx"), *(extra or []))
    half = (F.col("vy") + F.col("vx")) / 2
    root = F.sqrt(F.pow((F.col("vy") - F.col("vx")) / 2, F.lit(2.0)) + F.pow(F.col("cyx"), F.lit(2.0)))
    ratio = F.sqrt(F.greatest(half + root, F.lit(1e-9)) / F.greatest(half - root, F.lit(1e-9)))
    return s.withColumn("elongation", F.when(F.col("size") > 2, ratio).otherwise(F.lit(1.0))).drop("vy", "vx", "cyx")


def fill_statistics(labelled: DataFrame, height: int, width: int, min_frac: float = 0.001) -> DataFrame:
    """Per section: covered fraction and count of components of at least `min_frac`, shape of the largest."""
    total = float(height * width)
    s = component_stats(labelled).where(F.col("size") / total >= min_frac)
    top = F.min(F.struct((-F.col("size")).alias("o"), "component", "x0", "y0", "x1", "y1", "elongation"))
    g = s.groupBy("z").agg(F.sum("size").alias("px"), F.count(F.lit(1)).alias("n_components"), top.alias("t"))
    sides = (F.col("t.y0") == 0).cast("int") + (F.col("t.x0") == 0).cast("int") + (F.col("t.y1") == height).cast("int") + (F.col("t.x1") == width).cast("int")
    span = F.hypot((F.col("t.x1") - F.col("t.x0")).cast("double"), (F.col("t.y1") - F.col("t.y0")).cast("double")) / F.hypot(F.lit(float(width)), F.lit(float(height)))
    return g.select("z", (F.col("px") / total).alias("frac_fill"), "n_components", (-F.col("t.o") / total).alias("largest_frac"), F.col("t.x0").alias("x0"), F.col("t.y0").alias("y0"),
                    F.col("t.x1").alias("x1"), F.col("t.y1").alias("y1"), F.col("t.elongation").alias("elongation"), span.alias("span"), sides.alias("border_sides"))
