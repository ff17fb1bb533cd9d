"""Masks to labels and labels to objects, as runs (see label_runs): priority painting in rounds, links of all sections at once."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .label_runs import PLANE, ROW, _length, painted


def _px():
    return F.sum(_length()).cast("long")


def _overlapping(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Runs of `a` and `b` (x0, x1 there named u0, u1) that share pixels of a row, with the pixels shared."""
    j = a.join(b, on).where("x0 < u1 AND x1 > u0")
    return j.withColumn("px", F.least("x1", "u1") - F.greatest("x0", "u0"))


def consolidate(masks: DataFrame, min_area: int = 300) -> DataFrame:
    """One mask per pixel: masks (row columns, x0, x1, mask; runs of one mask are disjoint) are taken largest first, ties by number; a mask keeps
    the pixels that no mask taken before has, and is left out if these are fewer than `min_area`. -> row columns, x0, x1, mask.

    Rounds instead of a loop over masks: of all open masks the first in order owns a pixel. A mask that owns enough is taken for good, as
    others can only go. One that does not is out once no undecided mask stands before it on its pixels. The first undecided mask
    is always decided, so the rounds end; each is one painting and one join among the undecided."""
    area = masks.groupBy(*PLANE, "mask").agg(_px().alias("area"))
    # the painting rank: larger areas win, then smaller numbers
    runs = cut_lineage(masks.join(area.where(F.col("area") >= min_area), [*PLANE, "mask"]))
    while True:
        n = F.struct("area", (-F.col("mask")).alias("m"))
        ranked = runs.select(*ROW, "x0", "x1", "mask", "area", F.dense_rank().over(_by(n)).cast("long").alias("n"))
        owned = cut_lineage(painted(ranked))
        kept = owned.groupBy(*PLANE, "mask").agg(_px().alias("own"))
        open_ = runs.select(*PLANE, "mask", "area").distinct().join(kept, [*PLANE, "mask"], "left")
        doubt = cut_lineage(open_.where(F.coalesce("own", F.lit(0)) < min_area).select(*PLANE, "mask", "area"))
        if doubt.isEmpty():
            return owned.select(*ROW, "x0", "x1", "mask")
        mine = runs.join(doubt.select(*PLANE, "mask"), [*PLANE, "mask"], "left_semi")
        other = mine.select(*ROW, F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("mask").alias("m2"), F.col("area").alias("a2"))
        before = (F.col("a2") > F.col("area")) | ((F.col("a2") == F.col("area")) & (F.col("m2") < F.col("mask")))
        waits = _overlapping(mine, other, ROW).where(before).select(*PLANE, "mask").distinct()
        out = doubt.join(waits, [*PLANE, "mask"], "left_anti")
        runs = cut_lineage(runs.join(out, [*PLANE, "mask"], "left_anti"))


def _by(order):
    from pyspark.sql import Window

    return Window.partitionBy(*PLANE).orderBy(order)


def pair_iou(labels: DataFrame, gap: int) -> DataFrame:
    """IoU of the objects of each section with those `gap` sections before: dataset, block, z, label, ref, iou."""
    size = labels.groupBy(*PLANE, "label").agg(_px().alias("size"))
    back = labels.select("dataset", "block", (F.col("z") + gap).alias("z"), "y", F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("label").alias("ref"))
    both = _overlapping(labels.select(*ROW, "x0", "x1", "label"), back, ROW).groupBy(*PLANE, "label", "ref").agg(F.sum("px").alias("both"))
    j = both.join(size, [*PLANE, "label"]).join(size.select("dataset", "block", (F.col("z") + gap).alias("z"), F.col("label").alias("ref"), F.col("size").alias("ref_size")), [*PLANE, "ref"])
    return j.select(*PLANE, "label", "ref", (F.col("both") / (F.col("size") + F.col("ref_size") - F.col("both"))).alias("iou"))


def one_to_one(iou: DataFrame, least: float) -> DataFrame:
    """Every object's best partner (ties: smallest), which the smallest object that asks for it keeps."""
    best = iou.groupBy(*PLANE, "label").agg(F.max(F.struct("iou", (-F.col("ref")).alias("r"))).alias("b")).select(*PLANE, "label", (-F.col("b.r")).alias("ref"), F.col("b.iou").alias("iou"))
    return best.where(F.col("iou") >= least).groupBy(*PLANE, "ref").agg(F.min("label").alias("label"), F.min_by("iou", "label").alias("iou"))


def objects(labels: DataFrame, least: float = 0.3) -> DataFrame:
    """dataset, block, z, label, root_z, root_label: the object that a section's label belongs to, named by its first appearance.

    A label continues the one that it overlaps most in the section before; a label without one continues, by the same rule, a label of the
    section before that which the section in between does not continue. All sections are linked at once and chains are
    shortened by pointer jumping, so a stack of n sections takes about log2(n) joins."""
    labels = cut_lineage(labels.select(*ROW, "x0", "x1", "label"))
    near = cut_lineage(one_to_one(pair_iou(labels, 1), least))
    gone = near.select("dataset", "block", (F.col("z") + 1).alias("z"), "ref")  # labels two sections back that the section in between continues
    far = pair_iou(labels, 2).join(near.select(*PLANE, "label"), [*PLANE, "label"], "left_anti").join(gone, [*PLANE, "ref"], "left_anti")
    far = one_to_one(far, least)
    links = near.select(*PLANE, "label", (F.col("z") - 1).alias("pz"), F.col("ref").alias("pl")).unionByName(far.select(*PLANE, "label", (F.col("z") - 2).alias("pz"), F.col("ref").alias("pl")))
    links = cut_lineage(links)
    while True:
        ahead = links.select("dataset", "block", F.col("z").alias("pz"), F.col("label").alias("pl"), F.col("pz").alias("qz"), F.col("pl").alias("ql"))
        moved = cut_lineage(links.join(ahead, ["dataset", "block", "pz", "pl"], "left"))
        links = moved.select(*PLANE, "label", F.coalesce("qz", "pz").alias("pz"), F.coalesce("ql", "pl").alias("pl"))
        if moved.where("qz IS NOT NULL").isEmpty():
            break
    return labels.select(*PLANE, "label").distinct().join(links, [*PLANE, "label"], "left").select(*PLANE, "label", F.coalesce("pz", "z").alias("root_z"), F.coalesce("pl", "label").alias("root_label"))
