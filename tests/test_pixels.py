"""Pixel operators and kernels against brute force."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.functions import kernels as K
from lamella.operators import annotation as A
from lamella.operators import components as C
from lamella.operators import labels as L
from lamella.operators import planes as P
from lamella.operators import serial_checks as Z
from lamella.operators import similar as N
from lamella.operators import windows as W


def flood(pixels, conn):
    left, out = dict(pixels), {}
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if conn == 8 else [])
    for p in sorted(pixels):
        if p not in left:
            continue
        v, todo = left.pop(p), [p]
        while todo:
            z, y, x = todo.pop()
            out[z, y, x] = p
            for dy, dx in steps:
                q = (z, y + dy, x + dx)
                if left.get(q) == v:
                    left.pop(q)
                    todo.append(q)
    return out


def snake(n):
    """One path that winds through every second row: the longest diameter a plane can have."""
    px = {}
    for i in range(0, n, 2):
        for x in range(n):
            px[0, i, x] = 1
        if i + 1 < n:
            px[0, i + 1, (n - 1) if (i // 2) % 2 == 0 else 0] = 1
    return px


@pytest.mark.parametrize("conn", [4, 8])
def test_components_across_tiles(spark, conn):
    rnd = random.Random(conn)
    px = {(z, y, x): rnd.randint(1, 2) for z in range(2) for y in range(40) for x in range(40) if rnd.random() < 0.6}
    px.update({(5, y, x): v for (_, y, x), v in snake(33).items()})
    want = flood(px, conn)
    df = spark.createDataFrame([(*k, v) for k, v in px.items()], "z long, y long, x long, id long").repartition(4)
    got = C.label_components(df, conn, "id", tile=8).collect()
    assert len(got) == len(px)
    code = lambda p: p[0] * C._Z + p[1] * C._Y + p[2]
    assert all(r.component == code(want[r.z, r.y, r.x]) for r in got)


def test_components_of_a_long_snake_converge(spark):
    px = snake(161)  # tiles of 2 pixels: a chain of thousands of open edges
    df = spark.createDataFrame(list(px), "z long, y long, x long")
    assert C.label_components(df, 4, tile=2).select("component").distinct().count() == 1


def test_pixel_codes_do_not_overflow_silently(spark):
    for z, y, x in ((1 << 18, 0, 0), (0, 1 << 20, 0), (0, 0, 1 << 20), (-1, 0, 0)):
        with pytest.raises(Exception, match="pixel out of range"):
            C.label_components(spark.createDataFrame([(z, y, x)], "z long, y long, x long"), 8).collect()


def test_unsigned_ids_stay_apart(spark):
    from decimal import Decimal

    big = [Decimal(2**63), Decimal(2**64 - 1), Decimal(1)]
    df = spark.createDataFrame([(0, 0, k, v) for k, v in enumerate(big)], "z long, y long, x long, id decimal(20,0)")
    got = sorted((r.x, r.id, r.component) for r in C.label_components(df, 8, "id").collect())
    assert got == [(k, v, k) for k, v in enumerate(big)]


def test_label_mask_kernel():
    rnd = np.random.default_rng(0)
    m = rnd.random((30, 31)) < 0.5
    for conn in (4, 8):
        lab = K.label_mask(m, conn)
        want = flood({(0, int(y), int(x)): 1 for y, x in zip(*np.nonzero(m))}, conn)
        roots = {}
        for (_, y, x), r in want.items():
            assert roots.setdefault(r, lab[y, x]) == lab[y, x] > 0
        assert len(set(roots.values())) == len(roots) == lab.max()


def test_boundary_and_resampling(spark):
    ids = np.array([[1, 1, 2], [1, 70000, 2], [0, 0, 0]])
    rows = [(0, y, x, int(ids[y, x])) for y in range(3) for x in range(3) if ids[y, x]]
    df = spark.createDataFrame(rows, "z long, y long, x long, id long")
    want = {(y, x) for y in range(3) for x in range(3) if (x < 2 and ids[y, x] != ids[y, x + 1]) or (y < 2 and ids[y, x] != ids[y + 1, x])}
    assert {(r.y, r.x) for r in L.boundary_map(df, 3, 3).collect()} == want
    up = L.upsample_labels(df, 2)
    assert up.count() == 4 * len(rows)
    assert sorted(map(tuple, L.downsample_labels(up, 2).select("z", "y", "x", "id").collect())) == sorted(rows)
    rgb = spark.createDataFrame([(1, 17, 112)], "r int, g int, b int").select(L.pack_rgb(F.col("r"), F.col("g"), F.col("b")).alias("v")).first().v
    assert rgb == 1 * 65536 + 17 * 256 + 112


def test_windows_meet_their_pixels(spark):
    rnd = random.Random(2)
    px = [(rnd.randint(0, 1), rnd.randint(0, 99), rnd.randint(0, 99), rnd.randint(1, 4)) for _ in range(1500)]
    px = list({p[:3]: p for p in px}.values())
    wins = [(f"w{i}", rnd.randint(0, 1), y, y + 40, x, x + 30) for i in range(8) for y, x in [(rnd.randint(0, 59), rnd.randint(0, 69))]]
    p = spark.createDataFrame(px, "z long, y long, x long, id long")
    w = spark.createDataFrame(wins, "window_id string, zc long, y0 long, y1 long, x0 long, x1 long")
    plane = np.zeros((2, 100, 100), int)
    for z, y, x, v in px:
        plane[z, y, x] = v
    for r in W.label_evidence(w, p, 100, 100).collect():
        c = plane[r.zc, r.y0:r.y1, r.x0:r.x1]
        b = np.zeros(c.shape, bool)
        b[:, :-1] |= c[:, :-1] != c[:, 1:]
        b[:-1] |= c[:-1] != c[1:]
        assert np.isclose(r.fg_frac, (c != 0).mean()) and np.isclose(r.boundary_frac, b.mean()) and r.n_ids == len(np.unique(c[c != 0]))


def test_provenance_conserves_pixels(spark):
    rnd = random.Random(3)
    cells = [(z, y, x) for z in range(2) for y in range(12) for x in range(12)]
    before = {c: rnd.randint(0, 3) for c in cells}
    after, edits = dict(before), []
    for n in range(1, 80):
        c, v = rnd.choice(cells), rnd.randint(0, 4)
        edits.append((n, *c, v, rnd.choice("xy"), rnd.choice(["paint", "sam", "seed", "repair", "odd"])))
        after[c] = v
    after[cells[0]] = 9  # a change nobody recorded
    mk = lambda d: spark.createDataFrame([(*c, v) for c, v in d.items()], "z long, y long, x long, id long")
    e = spark.createDataFrame(edits, "n long, z long, y long, x long, new_id long, author string, kind string")
    prov = A.pixel_provenance(mk(before), mk(after), e).cache()
    assert prov.count() == len(cells)
    tot = {r.z: r for r in A.provenance_totals(prov).collect()}
    assert tot[None].px == len(cells) and sum(tot[None][f"{s}_px"] for s in A.SOURCES) == len(cells)
    assert tot[None].changed_px == sum(before[c] != after[c] for c in cells) == tot[None].added_px + tot[None].removed_px + tot[None].relabeled_px
    assert prov.where("z = 0 AND y = 0 AND x = 0").first().source == "unknown"
    # undoing everything restores the baseline, undoing one section only that section
    undo = e.select("n", F.lit(None).cast("long").alias("z"))
    back = {(r.z, r.y, r.x): r.id for r in A.replay(mk(before), e, undo).collect()}
    assert back == before
    half = {(r.z, r.y, r.x): r.id for r in A.replay(mk(before), e, e.where("z = 1").select("n", "z")).collect()}
    expect = {**before, **{c: v for c, v in after.items() if c[0] == 0 and c != cells[0]}}
    last = {(z, y, x): v for n, z, y, x, v, _, _ in edits}
    expect[cells[0]] = last.get(cells[0], before[cells[0]])
    assert half == expect


def test_knn_join_is_exact_with_a_hot_cell(spark):
    rng = np.random.default_rng(1)
    pts = np.vstack([rng.normal(0, 0.01, (70, 3)), rng.normal(0, 1, (140, 3)), np.zeros((30, 3))])  # copies and a dense spot
    rows = [(i, str(i % 100), [float(v) for v in p]) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "pid long, grp string, fv array<double>")
    got = N.knn_join(df, df.withColumnRenamed("pid", "qid"), 6, n_pivots=5, chunk=16).collect()
    have = {}
    for r in got:
        have.setdefault(r.qid, []).append((r.distance, r.pid))
    for i, g, p in rows:
        d = sorted((float(np.sqrt(((np.array(q) - np.array(p)) ** 2).sum())), j) for j, h, q in rows if h != g)[:6]
        assert np.allclose([x[0] for x in sorted(have[i])], [x[0] for x in d])
        assert [x[1] for x in sorted(have[i])] == [x[1] for x in d]


def test_knn_join_sends_no_copy_of_a_query_per_cell(spark, monkeypatch):
    """Without structure no cell is ruled out; a worker must still not make a frame with a row per query and cell."""
    rng = np.random.default_rng(3)
    rows = [(i, str(i), [float(v) for v in p]) for i, p in enumerate(rng.normal(0, 1, (400, 24)))]
    df = spark.createDataFrame(rows, "pid long, grp string, fv array<double>").coalesce(1)
    plain, made = type(df).mapInPandas, spark.sparkContext.accumulator(0)

    def counted(self, f, schema, *a, **b):
        def g(batches):
            for out in f(batches):
                made.add(len(out))
                yield out

        return plain(self, g, schema, *a, **b)

    monkeypatch.setattr(type(df), "mapInPandas", counted)
    got = {}
    for r in N.knn_join(df, df.withColumnRenamed("pid", "qid"), 5, n_pivots=40, chunk=64).collect():
        got.setdefault(r.qid, []).append((r.rank, r.pid))
    assert made.value <= 12 * len(rows), made.value  # a few passes over points and queries; before, 40 rows a query
    m = np.array([r[2] for r in rows])
    for i in range(0, 400, 20):
        d = ((m - m[i]) ** 2).sum(1)
        d[i] = np.inf
        assert [p for _, p in sorted(got[i])] == list(np.argsort(d, kind="stable")[:5])


def test_registration_finds_a_known_shift():
    rng = np.random.default_rng(2)
    big = K.gaussian(rng.random((160, 160)), 1.5)
    a, b = K.prepare(big[20:116, 20:116], 2.0), K.prepare(big[25:121, 17:113], 2.0)
    r = K.register(np.stack([a, a]), np.stack([b, a]))  # a pair that moved and one that did not, as one stack
    assert abs(r["dy"][0] - 5) < 0.3 and abs(r["dx"][0] + 3) < 0.3 and r["ncc"][0] > 0.8 > r["ncc0"][0]
    assert r["ncc"][1] > 0.985 and abs(r["dy"][1]) + abs(r["dx"][1]) <= 1
    assert K.moved_ncc(a[None], b[None], np.array([96]), np.array([0]))[0] == 0.0
    for dy, dx in ((5, -3), (0, 0), (-40, 17)):
        p, q = a[max(dy, 0) : 96 + min(dy, 0), max(dx, 0) : 96 + min(dx, 0)], b[max(-dy, 0) : 96 + min(-dy, 0), max(-dx, 0) : 96 + min(-dx, 0)]
        assert abs(K.moved_ncc(a[None], b[None], np.array([dy]), np.array([dx]))[0] - np.corrcoef(p.ravel(), q.ravel())[0, 1]) < 1e-6


def test_affine_and_signals():
    g = np.array([(y, x) for y in (12, 36, 60, 84) for x in (12, 36, 60, 84)], float)
    field = np.column_stack([g, 0.04 * (g[:, 0] - 48) + 1.0, np.full(len(g), -2.0)])
    few = field.copy()
    few[3:] = np.nan
    residual, strain = K.affine_fits(np.stack([field, few]), 96, 96)
    assert residual[0] < 1e-9 and abs(strain[0] - 0.04) < 1e-6
    assert np.isnan(residual[1]) and np.isnan(strain[1])
    t = np.full((96, 96), 0.5)
    t[40] += 0.3
    band, axis, at = K.bands(np.stack([t, t.T]), 0.12)
    assert axis.tolist() == [0, 1] and at.tolist() == [40, 40] and np.abs(band - 0.3).max() < 1e-9
    y, x = np.mgrid[-1:1:96j, -1:1:96j]
    assert abs(K.ramps((0.1 * y + 0.05 * x)[None])[0] - 2 * np.hypot(0.1, 0.05)) < 1e-6
    rng = np.random.default_rng(3)
    tissue = 0.5 + 0.05 * rng.standard_normal((128, 128))
    dirty = tissue.copy()
    dirty[30:48, 50:70] = 0.99
    p = {"sigma_k": 3.5, "flat_quantile": 0.15, "open_iter": 2, "min_blob_px": 12, "min_frac": 0.0008, "max_blob_frac": 0.25, "area_ref": 0.02}
    score, share, n, note = K.blobs(np.stack([dirty, tissue, np.full((128, 128), 0.5)]), p)
    assert score[0] < 0.5 and n[0] == 1 and score[1] == 1.0 and note == [None, "no_blob", None] and score[2] == 1.0 and share[2] == 0.0
    stripes = np.tile(0.5 + 0.1 * np.sin(np.arange(96) * 2 * np.pi / 8), (96, 1))
    an, angle = K.directions(np.stack([stripes, rng.standard_normal((96, 96)), np.zeros((96, 96))]), 12)
    assert an[0] > 0.95 and an[1] < 0.2 and an[2] == 0.0 and min(angle[0], 180 - angle[0]) < 15


@pytest.mark.parametrize("conn", [4, 8])
def test_areas_by_runs_equal_the_pixel_kernel(conn):
    rng = np.random.default_rng(conn)
    for shape, p in (((30, 40), 0.5), ((1, 50), 0.6), ((50, 1), 0.4), ((20, 20), 0.0), ((20, 20), 1.0)):
        m = rng.random(shape) < p
        lab = K.label_mask(m, conn)
        got = K.mask_areas(m, conn)
        want = []
        for k in range(1, lab.max() + 1):
            y, x = np.nonzero(lab == k)
            want.append((len(y), x.min(), x.max() + 1, y.min(), y.max() + 1, x.sum(), y.sum(), (x * x).sum(), (y * y).sum(), (x * y).sum()))
        assert sorted(want) == sorted(zip(*(got[f].tolist() for f in ("size", "x0", "x1", "y0", "y1", "sx", "sy", "sxx", "syy", "sxy"))))


def test_statistics_of_every_pixel(monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(K, "STRIP", 7)
    for a, top in ((rng.integers(0, 256, (40, 33)).astype(np.uint8), 255.0), (rng.integers(0, 65536, (40, 33)).astype(np.uint16), 65535.0), (rng.random((40, 33)), 1.0)):
        s, f = K.section_statistics(a, top), a.astype(float) / top
        lap = K.laplacian(f)
        want = {"mean": f.mean(), "std": f.std(), "min": f.min(), "max": f.max(), "lapvar": lap.var(), **dict(zip(("p1", "p50", "p99"), np.percentile(f, [1, 50, 99])))}
        assert all(abs(s[k] - v) < 1e-9 for k, v in want.items())


def test_section_statistics_ignore_fill():
    rng = np.random.default_rng(4)
    a = rng.integers(60, 190, (200, 200)).astype(np.uint8)
    clean = K.section_statistics(a, 255.0, 0)
    a[:, 90:100] = 0
    s = K.section_statistics(a, 255.0, 0)
    assert abs(s["mean"] - clean["mean"]) < 0.01 and abs(s["frac_fill"] - 0.05) < 1e-9 and s["fill_elongation"] > 3 and s["fill_sides"] == 2
    assert s["frac_low_sat"] == 0.0 and s["fill_bbox"] == [90, 0, 100, 200]


def test_serial_checks_flag_injected_defects(spark):
    """A drifting stack with one foreign section and one duplicate."""
    rng = np.random.default_rng(5)
    noise = [K.gaussian(rng.random((96, 96)), 2.0) for _ in range(14)]
    planes, cur = [], noise[0]
    for i in range(14):
        cur = 0.8 * cur + 0.2 * noise[i] if i else cur
        planes.append(cur)
    planes[6] = K.gaussian(rng.random((96, 96)), 2.0)
    planes[10] = planes[9]
    rows = [("b", z, "ok", True, 96, 96, p.ravel().tolist()) for z, p in enumerate(planes)]
    df = spark.createDataFrame(rows, "block_id string, z long, status string, in_chain boolean, h int, w int, px array<double>")
    pairs = Z.register_pairs(Z.prepare_planes(df, ["block_id", "z", "status", "in_chain"], 2.0)).cache()
    s = Z.serial_scores(Z.with_baselines(pairs, Z.block_baselines(pairs)), 14, 1.0, 96.0)
    r = {x.z: x for x in s.collect()}
    assert r[6].slice_jump < 0.3 and r[10].z_reason == "duplicate" and r[10].z_order_error == 0.0
    assert all(r[z].slice_jump > 0.6 for z in (2, 3, 4, 8, 9, 12))
    names = ["slice_jump", "local_misalignment", "global_misalignment", "local_deformation", "section_deformation"]
    assert all(x[n] is not None or x[f"{n}_note"] for x in r.values() for n in names)  # no silent NULL


def test_mask_consolidation_and_links(spark):
    sq = lambda m, z, y, x, n: [("b", z, m, i, j) for i in range(y, y + n) for j in range(x, x + n)]
    rows = sq(1, 0, 0, 0, 10) + sq(2, 0, 5, 5, 8) + sq(3, 0, 50, 50, 3) + sq(1, 1, 1, 0, 10) + sq(7, 2, 40, 40, 6) + sq(9, 3, 1, 1, 10)
    m = spark.createDataFrame(rows, "block_id string, z long, mask long, y long, x long")
    lab = P.consolidate_masks(m, None, min_area=20).cache()
    n = {(r.z, r.label): r["count"] for r in lab.groupBy("z", "label").count().collect()}
    assert n == {(0, 1): 100, (0, 2): 64 - 25, (1, 1): 100, (2, 1): 36, (3, 1): 100}  # the small mask is gone, overlaps go to the larger one
    g = {(r.z, r.label): r.gid for r in P.link_sections(lab, [0, 1, 2, 3], 0.3, 2).collect()}
    assert g[1, 1] == g[0, 1] == g[3, 1] and len({g[0, 1], g[0, 2], g[2, 1]}) == 3  # section 3 reaches over section 2


def test_hash_and_color(spark):
    df = spark.createDataFrame([(12345,)], "id long")
    from lamella.operators.fleet import label_color

    h = 2166136261
    for ch in "12345":
        h = ((h ^ ord(ch)) * 16777619) % (1 << 32)
    assert df.select(label_color(F.col("id")).alias("h")).first().h == h
