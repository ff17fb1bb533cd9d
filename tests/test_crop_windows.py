"""Crop windows over runs against loops over pixels and windows."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.functions import kernels as K
from lamella.operators import crop_windows as C

RUN = "dataset string, block string, z long, y long, x0 long, x1 long"


def planes_of(spark, sizes):
    return spark.createDataFrame([("d", b, 0, h, w) for b, (h, w) in sizes.items()], "dataset string, block string, z long, height long, width long")


@pytest.mark.parametrize(("size", "stride"), [(16, 4), (12, 12), (32, 8)])
def test_candidates_and_packing(spark, size, stride):
    rng = random.Random(size)
    sizes = {"a": (70, 101), "b": (40, 40), "c": (9, 50)}
    runs = [("d", b, 0, rng.randrange(h), x := rng.randrange(w - 1), min(w, x + rng.randint(1, 9))) for b, (h, w) in sizes.items() for _ in range(12)]
    bad = {b: np.zeros(hw, int) for b, hw in sizes.items()}
    for _, b, _, y, x0, x1 in set(runs):
        bad[b][y, x0:x1] += 1
    found = C.candidates(planes_of(spark, sizes), spark.createDataFrame(sorted(set(runs)), RUN), size, stride)
    got = {(r.block, r.y0, r.x0): r.n_bad for r in found.collect()}
    want = {(b, y, x): int(bad[b][y : y + size, x : x + size].sum()) for b, (h, w) in sizes.items() for y in range(0, h - size + 1, stride) for x in range(0, w - size + 1, stride)}
    assert got == want
    chosen = {(r.block, r.y0, r.x0) for r in C.pack(found.where("n_bad = 0"), size, stride).collect()}
    expected = []
    for b, y, x in sorted((k for k, n in want.items() if n == 0), key=lambda k: (k[0], not (k[1] % size == 0 and k[2] % size == 0), k[1] % size + k[2] % size, k[1], k[2])):
        if all(b != c or abs(y - v) >= size or abs(x - u) >= size for c, v, u in expected):
            expected.append((b, y, x))
    assert chosen == set(expected) and chosen


def test_report_with_seams_and_sections_without_a_crop(spark):
    image = np.tile(np.where(np.arange(64) < 20, 10, 250).astype(np.uint8), (64, 1))
    images = spark.createDataFrame([("d", "a", z, 64, 64, image.tobytes()) for z in (0, 1)], "dataset string, block string, z long, h int, w int, payload binary")
    planes = images.select("dataset", "block", "z", F.lit(64).alias("height"), F.lit(64).alias("width"))
    forbidden = spark.createDataFrame([("d", "a", 1, y, 0, 64) for y in range(64)], RUN)
    found = C.candidates(planes, forbidden, 32, 32)
    crops = C.seams(C.pack(found.where("n_bad = 0"), 32, 32), images, 32, 8)
    seam = {(r.y0, r.x0): r.seam for r in crops.collect()}
    assert seam == {(y, x): K.seam_step(image[y : y + 32, x : x + 32], 8) for y in (0, 32) for x in (0, 32)}
    r = C.report(planes, found, crops, 32).first()
    assert (r.n_sections, r.n_dropped, r.n_cut, r.n_crops, r.kept_frac, r.seam_max) == (2, 1, 1, 4, 1.0, max(seam.values())) and r.seam_median == np.median(list(seam.values()))
