"""Labels as runs: kernels and operators against pixel-by-pixel results."""
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.operators import label_runs as R

STROKE = "dataset string, block string, z long, y long, x0 long, x1 long, n long, id long"


def strokes_of(seed, n=1500, height=200, width=90, volumes=("a", "b")):
    """Two volumes with the same section numbers, some empty runs, two sections, rows over several bands."""
    rng = random.Random(seed)
    out = []
    for k in range(1, n + 1):
        x = rng.randrange(width)
        out.append((rng.choice(volumes), "b0", rng.choice([0, 7]), rng.randrange(height), x, min(width, x + rng.choice([0, 1, 2, 5, 30])), k, rng.randint(1, 4)))
    rng.shuffle(out)
    return out


def paint(rows):
    px = {}
    for d, b, z, y, x0, x1, n, i in sorted(rows, key=lambda r: r[6]):
        for x in range(x0, x1):
            px[d, b, z, y, x] = (n, i)
    return px


def pixels(rows, *cols):
    out = {}
    for r in rows:
        for x in range(r.x0, r.x1):
            key = (r.dataset, r.block, r.z, r.y, x)
            assert key not in out
            out[key] = tuple(r[c] for c in cols)
    return out


def test_cover_takes_the_largest_rank():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = rng.integers(1, 40)
        a = rng.integers(0, 60, n)
        b = a + rng.integers(1, 40, n)
        rank = rng.permutation(n) * 3
        points = np.unique(np.concatenate([a, b]))
        got = R.cover(points, a, b, rank)
        for p, g in zip(points[:-1], got, strict=True):
            over = np.flatnonzero((a <= p) & (p < b))
            assert g == (over[np.argmax(rank[over])] if len(over) else -1)


def test_painted_equals_pixels_and_a_hot_row_is_combined_before_the_shuffle(spark):
    rows = strokes_of(1) + [("a", "b0", 0, 3, 0, 90, 10_000 + k, 9) for k in range(3000)]
    df = spark.createDataFrame(rows, STROKE).repartition(6)
    assert pixels(R.painted(df).collect(), "n", "id") == paint(rows)
    plan = R.painted(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInPandas") < plan.index("RepartitionByExpression") < plan.rindex("MapInPandas")
    assert R.painted(df.limit(0)).count() == 0


def test_overlay_and_merge(spark):
    one, two = strokes_of(2, 700), strokes_of(3, 700)
    a, b = (R.painted(spark.createDataFrame(r, STROKE)) for r in (one, two))
    big = (1 << 60) + 1  # ids beyond what a float holds stay exact
    b = b.withColumn("id", F.col("id") + big)
    got = R.overlaid({"p": a, "q": b}, {"p": {"id": "long"}, "q": {"id": "long"}})
    pa, pb = paint(one), paint(two)
    want = {k: (pa.get(k, (0, None))[1], pb[k][1] + big if k in pb else None) for k in pa.keys() | pb.keys()}
    assert pixels(got.collect(), "p_id", "q_id") == want
    joined = R.merged(a, "id").collect()
    assert pixels(joined, "id") == {k: (v[1],) for k, v in pa.items()}
    ends = {(r.dataset, r.z, r.y, r.x1): r.id for r in joined}
    assert all(ends.get((r.dataset, r.z, r.y, r.x0)) != r.id for r in joined)


def flood(px, connectivity):
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if connectivity == 8 else [])
    out = {}
    for key in sorted(px):
        if key in out:
            continue
        out[key], todo = key, [key]
        while todo:
            d, b, z, y, x = todo.pop()
            for dy, dx in steps:
                k = (d, b, z, y + dy, x + dx)
                if k in px and k not in out and px[k] == px[key]:
                    out[k] = key
                    todo.append(k)
    return out


@pytest.mark.parametrize(("connectivity", "by_value"), [(4, True), (8, True), (8, False)])
def test_components_over_bands_and_volumes(spark, connectivity, by_value):
    rows = strokes_of(4, 2500)
    # a snake through every band of one plane, in volume a alone
    rows += [("a", "b0", 0, y, x, x + 1, 50_000 + y * 2 + x, 77) for y in range(200) for x in ([88, 89] if y % 4 == 0 else [88] if y % 4 < 2 else [89] if y % 4 == 2 else [89])]
    labels = R.painted(spark.createDataFrame(rows, STROKE))
    got = pixels(R.components(labels, connectivity, by_value).collect(), "cy", "cx")
    px = {k: v[1] if by_value else 1 for k, v in paint(rows).items()}
    assert got == {k: (o[3], o[4]) for k, o in flood(px, connectivity).items()}
    table = R.component_table(R.components(labels, connectivity, by_value)).collect()
    assert Counter(flood(px, connectivity).values()) == {(r.dataset, r.block, r.z, r.cy, r.cx): r.px for r in table}


def test_edges_equal_differences_of_pixels(spark):
    height, width = 200, 90
    rows = strokes_of(5, 900, height, width)
    px = {k: v[1] for k, v in paint(rows).items()}
    got = pixels(R.edges(R.painted(spark.createDataFrame(rows, STROKE)), height, width).collect(), "rdiff", "ddiff")
    want = {}
    for d in "ab":
        for z in (0, 7):
            at = lambda y, x: px.get((d, "b0", z, y, x), 0)
            for y in range(height):
                for x in range(width):
                    r, u = x + 1 < width and at(y, x) != at(y, x + 1), y + 1 < height and at(y, x) != at(y + 1, x)
                    if r or u:
                        want[d, "b0", z, y, x] = (r, u)
    assert got == want


def test_mask_overlap_counts_masks_not_runs(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), "b", 1, rng.randrange(70), x := rng.randrange(50), x + rng.randint(1, 20), rng.choice(["m", "n", "o"])) for _ in range(800)]
    got = pixels(R.mask_overlap(spark.createDataFrame(rows, "dataset string, block string, z long, y long, x0 long, x1 long, mask string")).collect(), "n")
    claimed = defaultdict(set)
    for d, b, z, y, x0, x1, m in rows:
        for x in range(x0, x1):
            claimed[d, b, z, y, x].add(m)
    assert got == {k: (len(v),) for k, v in claimed.items()}


def test_replay_keeps_the_order_of_strokes_and_merges(spark):
    rng = random.Random(7)
    base = [("a", "b0", z, y, 0, 20, 0, 1 + y % 4) for z in (1, 2) for y in range(6)]
    log = []
    for n in range(1, 300):
        if rng.random() < 0.5:
            x = rng.randrange(18)
            log.append(("stroke", ("a", "b0", rng.choice([1, 2]), rng.randrange(6), x, x + rng.randint(1, 6), n, rng.randint(0, 5))))
        else:
            log.append(("merge", ("a", "b0", n, rng.choice([None, 1, 2]), rng.randint(1, 5), rng.randint(0, 6))))
    undone = [("a", "b0", n, rng.choice([None, 1, 2])) for n in rng.sample(range(1, 300), 60)]
    off = {(n, z) for _, _, n, z in undone}
    px = {(d, b, z, y, x): i for d, b, z, y, x0, x1, _, i in base for x in range(x0, x1)}
    for kind, e in log:
        if kind == "stroke":
            d, b, z, y, x0, x1, n, i = e
            if (n, None) not in off and (n, z) not in off:
                px.update({(d, b, z, y, x): i for x in range(x0, x1)})
        else:
            _, _, n, z, old, new = e
            for k, v in px.items():
                if v == old and z in (None, k[2]) and (n, None) not in off and (n, k[2]) not in off:
                    px[k] = new
    run = "dataset string, block string, z long, y long, x0 long, x1 long"
    got = R.replay(spark.createDataFrame([(*r[:6], r[7]) for r in base], f"{run}, id long"), spark.createDataFrame([e for k, e in log if k == "stroke"], STROKE),
                   spark.createDataFrame([e for k, e in log if k == "merge"], "dataset string, block string, n long, z long, from_id long, to_id long"),
                   spark.createDataFrame(undone, "dataset string, block string, n long, z long"))
    assert pixels(got.collect(), "id") == {k: (v,) for k, v in px.items() if v}


def test_provenance_of_strokes_in_one_pass_equals_the_layers_laid_over_each_other(spark):
    """Random strokes and a hot row; some conditions are null, some strokes belong to no layer."""
    rows = strokes_of(8) + [("a", "b0", 0, 3, 0, 90, 10_000 + k, 1 + k % 3) for k in range(2000)]
    df = spark.createDataFrame(rows, STROKE).repartition(5)
    df = df.withColumn("author", F.when(F.col("n") % 4 != 0, F.concat(F.lit("p"), F.col("n") % 3))).withColumn("kind", F.element_at(F.array(*map(F.lit, ("paint", "sam", "repair", "other"))), (F.col("n") % 4 + 1).cast("int")))
    was, now, edit = F.expr("CASE WHEN n % 5 <> 0 THEN n % 3 = 0 END"), F.expr("n % 3 = 0 OR n % 11 <> 0"), F.expr("n % 3 = 1")
    layer = lambda c: R.painted(df.where(c).select(*R.ROW, "x0", "x1", "n", "id"))
    cols = ("before", "after", "source", "author")
    want = pixels(R.provenance(layer(was), layer(now), df.where(edit)).collect(), *cols)
    assert pixels(R.stroke_provenance(df, was, now, edit).collect(), *cols) == want
    few = R.stroke_provenance(df.where("n >= 10000"), was, now, edit)
    assert pixels(few.collect(), *cols) == {k: v for k, v in pixels(R.provenance(*[R.painted(df.where("n >= 10000").where(c).select(*R.ROW, "x0", "x1", "n", "id")) for c in (was, now)], df.where("n >= 10000").where(edit)).collect(), *cols).items()}


def test_components_keep_the_columns_of_their_runs(spark):
    df = spark.createDataFrame([("a", "b", 0, y, 0, 2, 1, f"w{y}") for y in range(60, 70)], "dataset string, block string, z long, y long, x0 long, x1 long, id long, who string")
    got = R.components(df, 8, by_value=False, keep=("who",)).collect()
    assert {(r.y, r.who, r.cy, r.cx) for r in got} == {(y, f"w{y}", 60, 0) for y in range(60, 70)}


def test_edges_take_one_shuffle_beyond_the_painting(spark):
    runs = spark.createDataFrame([("a", "b", 1, y, 3 * k, 3 * k + 2, k % 3 + 1) for y in range(70) for k in range(4)], "dataset string, block string, z long, y long, x0 long, x1 long, id long")
    edges = R.edges(runs, 80, 20)
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and plan.count("MapInPandas") == 1
    assert edges.count() > 0
