"""Masks and objects as runs against loops over pixels."""
import random
from collections import Counter

import pytest

from lamella.operators import label_runs as R
from lamella.operators import object_links as L

RUN = "dataset string, block string, z long, y long, x0 long, x1 long, mask long"


def boxes(seed, n):
    """Rectangular masks on two planes of two volumes; some equal areas, some covered by others."""
    rng = random.Random(seed)
    out = []
    for m in range(n):
        d, z, y, x, h, w = rng.choice("ab"), rng.choice([0, 1]), rng.randrange(20), rng.randrange(60), rng.randint(1, 12), rng.randint(1, 20)
        out += [(d, "k", z, yy, x, x + w, m) for yy in range(y, y + h)]
    return out


def greedy(rows, least):
    px = {}
    for d, b, z, y, x0, x1, m in rows:
        px.setdefault((d, b, z), {}).setdefault(m, set()).update((y, x) for x in range(x0, x1))
    out = {}
    for plane, masks in px.items():
        taken = set()
        for m in sorted(masks, key=lambda m: (-len(masks[m]), m)):
            free = masks[m] - taken
            if len(free) >= least:
                taken |= free
                out.update({(*plane, *p): m for p in free})
    return out


@pytest.mark.parametrize(("seed", "least"), [(1, 1), (2, 15), (3, 40)])
def test_consolidation_equals_the_greedy_loop(spark, seed, least):
    rows = boxes(seed, 120)
    got = {}
    for r in L.consolidate(spark.createDataFrame(rows, RUN).repartition(4), least).collect():
        got.update({(r.dataset, r.block, r.z, r.y, x): r.mask for x in range(r.x0, r.x1)})
    assert got == greedy(rows, least)


def test_a_chain_of_masks_that_cover_each_other_ends(spark):
    """Each mask hides most of the next smaller one: whether one stays depends on all before it."""
    rows = [("a", "k", 0, y, 3 * m, 3 * m + 40 - m, m) for m in range(25) for y in range(2)]
    got = Counter()
    for r in L.consolidate(spark.createDataFrame(rows, RUN), 20).collect():
        got[r.mask] += r.x1 - r.x0
    assert got == Counter(greedy(rows, 20).values())


def test_objects_cross_one_missing_section_and_long_stacks(spark):
    lab = lambda z, y, x0, x1, label, d="a": (d, "k", z, y, x0, x1, label)
    rows = [lab(z, 0, 0, 10, 1 + z % 3) for z in range(40) if z != 20]  # one object through the stack, a gap at 20
    rows += [lab(z, 5, 0, 10, 9) for z in (0, 1, 4, 5)]  # a gap of two ends it
    rows += [lab(10, 5, 0, 10, 9), lab(11, 5, 0, 5, 7), lab(11, 5, 5, 10, 8)]  # splits: the smaller label goes on
    rows += [lab(z, 0, 0, 10, 5, "b") for z in range(3)]
    got = {(r.dataset, r.z, r.label): (r.root_z, r.root_label) for r in L.objects(spark.createDataFrame(rows, RUN.replace("mask", "label")), 0.3).collect()}
    assert all(got["a", z, 1 + z % 3] == (0, 1) for z in range(40) if z != 20)
    assert got["a", 1, 9] == (0, 9) and got["a", 4, 9] == (4, 9) and got["a", 5, 9] == (4, 9)
    assert got["a", 11, 7] == (10, 9) and got["a", 11, 8] == (11, 8)
    assert got["b", 2, 5] == (0, 5)
