"""Order-dependent building blocks against brute force, with tiny buckets and a key that holds most rows."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.operators import ordered as O


def hot_rows(seed, n=600):
    rnd = random.Random(seed)
    rows = []
    for key, share in (("hot", n // 2), ("a", n // 6), ("b", 40), ("c", 1)):
        for z in sorted(rnd.sample(range(share * 2), share)):
            rows.append((key, z, rnd.random() < 0.7, round(rnd.random(), 3)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_ordinal_running_total_islands(spark, seed):
    rows = hot_rows(seed)
    df = spark.createDataFrame(rows, "k string, z long, f boolean, v double").repartition(5)
    got = {(r.k, r.z): r.o for r in O.ordinal(df, ["k"], ["z"], O.position_bucket("z", 7), "o").collect()}
    tot = {(r.k, r.z): r.t for r in O.running_total(df, ["k"], "z", F.col("f").cast("long"), "t", 7, inclusive=False).collect()}
    isl = sorted((r.k, r.run_start, r.run_end) for r in O.islands(df.where("f"), ["k"], "z", 7).collect())
    want_isl = []
    for key in {r[0] for r in rows}:
        mine = sorted((z, f) for k, z, f, _ in rows if k == key)
        c, start, prev = 0, None, None
        for i, (z, f) in enumerate(mine):
            assert got[key, z] == i and tot[key, z] == c
            c += f
        for z in [z for z, f in mine if f]:
            if prev is not None and z == prev + 1:
                prev = z
                continue
            if start is not None:
                want_isl.append((key, start, prev + 1))
            start = prev = z
        if start is not None:
            want_isl.append((key, start, prev + 1))
    assert isl == sorted(want_isl)


def test_ordinal_without_keys_is_global(spark):
    rows = hot_rows(3)
    df = spark.createDataFrame([(r[1], r[0]) for r in rows], "z long, k string")
    got = [(r.z, r.k) for r in O.ordinal(df, [], ["z", "k"], F.col("z"), "o").orderBy("o").collect()]
    assert got == sorted((r[1], r[0]) for r in rows)


def test_exact_percentiles(spark):
    rows = hot_rows(4)
    df = spark.createDataFrame([(r[0], r[3] if r[2] else None) for r in rows], "k string, v double")
    got = O.exact_percentiles(df, ["k"], "v", {"q1": 0.25, "med": 0.5, "q9": 0.9, "upper": lambda n: F.floor(n / 2)}, resolution=16, count_as="n").collect()
    for r in got:
        v = sorted(x[3] for x in rows if x[0] == r.k and x[2])
        assert r.n == len(v)
        assert np.allclose([r.q1, r.med, r.q9], np.percentile(v, [25, 50, 90]))
        assert r.upper == v[len(v) // 2]


def test_range_rows_long_and_empty(spark):
    df = spark.createDataFrame([("a", 3, 30), ("b", 5, 5), ("c", 0, 1)], "k string, s long, e long")
    got = sorted((r.k, r.z) for r in O.range_rows(df, F.col("s"), F.col("e"), 2, "z", block=3).collect())
    assert got == sorted([("a", z) for z in range(3, 30, 2)] + [("c", 0)])


def test_halo_windows(spark):
    from pyspark.sql import Window

    df = spark.range(100).select(F.lit("x").alias("k"), F.col("id").alias("pos"))
    w = Window.partitionBy("k", "_cell").orderBy("pos")
    out = O.with_halo(df, "pos", 2, 1, 8).withColumn("b", F.lag("pos", 2).over(w)).withColumn("a", F.lead("pos", 1).over(w)).where("_own").collect()
    assert len(out) == 100
    for r in out:
        assert r.b == (r.pos - 2 if r.pos >= 2 else None) and r.a == (r.pos + 1 if r.pos < 99 else None)


def walk_reference(rows):
    """rows of one key in order: (in_chain, pre, hit1, hit2) -> pick."""
    flags, out = [], []
    for chain, pre, h1, h2 in rows:
        k = len(flags)
        if k == 0:
            pick, hit = -1, False
        elif not flags[k - 1]:
            pick, hit = 1, h1
        elif k >= 2 and not flags[k - 2]:
            pick, hit = 2, h2
        else:
            pick, hit = 0, False
        out.append(pick)
        if chain:
            flags.append(pre or hit)
    return out


@pytest.mark.parametrize("width,seed", [(256, 1), (4, 2), (3, 3)])
def test_two_back_walk(spark, width, seed):
    rnd = random.Random(seed)
    rows, want = [], {}
    for key, n in (("hot", 150), ("s", 9), ("one", 1)):
        mine = [(rnd.random() < 0.8, rnd.random() < 0.1, rnd.random() < 0.5, rnd.random() < 0.5) for _ in range(n)]
        k = 0
        for z, (m, p) in enumerate(zip(mine, walk_reference(mine))):
            rows.append((key, z, m[0], m[1], m[2], m[3], k))
            want[key, z] = p
            k += m[0]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k0 string, z long, in_chain boolean, pre boolean, h1 boolean, h2 boolean, k long")
    got = O.two_back_walk(df, ["k0"], "z", 150, pre=F.col("pre"), hit1=F.col("h1"), hit2=F.col("h2"), width=width)
    assert {(r.k0, r.z): r.pick for r in got.collect()} == want


def test_one_outlier_affects_at_most_two_later_sections(spark):
    from lamella.operators.slice_checks import brightness_jump

    base = [("b", z, "ok", 0.5 + 0.001 * z, True) for z in range(12)]
    odd = list(base)
    odd[5] = ("b", 5, "ok", 0.9, True)
    run = lambda rows: {r.z: r.brightness_jump for r in brightness_jump(spark.createDataFrame(rows, "block_id string, z long, status string, mean double, in_chain boolean"), 12).collect()}
    a, b = run(base), run(odd)
    assert [z for z in a if a[z] != b[z]] and set(z for z in a if a[z] != b[z]) <= {5, 6, 7}


def test_value_bins_rise_with_the_value(spark):
    import struct

    rng = random.Random(5)
    values = [struct.unpack("<d", struct.pack("<q", rng.getrandbits(64) - (1 << 63)))[0] for _ in range(3000)]
    values += [m * 2.0**e * (1 + d * 2.0**-52) for e in range(-1020, 1020, 37) for m in (1, -1) for d in (-1, 0, 1)] + [0.0, -0.0, 5e-324, -5e-324, float("inf"), float("-inf")]
    values = sorted(v for v in values if v == v)
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = sorted((r.v, r.b) for r in df.select("v", O.value_bin(F.col("v")).alias("b")).collect())
    assert all(a[1] <= b[1] for a, b in zip(rows, rows[1:]))
    assert len({b for v, b in rows if 1 <= v < 2}) <= 1024 and min(b for v, b in rows if v > 0) >= 1


def test_percentiles_of_any_unit(spark):
    rng = np.random.default_rng(6)
    for scale in (1e-12, 1.0, 1e15):
        v = np.concatenate([rng.normal(size=500) * scale, rng.lognormal(0, 8, 300) * scale, np.repeat(3.5 * scale, 200)])
        df = spark.createDataFrame([("g", float(x)) for x in v], "g string, v double")
        got = O.exact_percentiles(df, ["g"], "v", {"a": 0.01, "b": 0.5, "c": 0.99}).first()
        np.testing.assert_allclose([got.a, got.b, got.c], np.percentile(v, [1, 50, 99]), rtol=1e-12)


def test_stream_plan_counts_no_section_outside_its_block(spark):
    from lamella.operators.delivery import stream_plan

    blocks = spark.createDataFrame([("b", 0, 20, 0, 8, 0, 8, "A")], "block_id string, z_start long, z_end long, y_start long, y_end long, x_start long, x_end long, grade string")
    failed = spark.createDataFrame([("b", 3), ("b", 19), ("b", 20), ("b", 30), ("b", -1)], "block_id string, z long")
    assert [(r.z0, r.z1, r.n_failed) for r in stream_plan(blocks, failed, 16).orderBy("z0").collect()] == [(0, 16, 1), (16, 20, 1)]


def test_dealt_keeps_tasks_of_one_size(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    big = O.dealt(df, 3 * few * O.TASK_ROWS, "k")
    assert big.rdd.getNumPartitions() == 3 * few and big.count() == 100
    assert O.dealt(df, O.TASK_ROWS, "k") is df


def test_delete_cascade_counts_removed_and_left_in_one_pass(spark):
    from lamella.operators import fleet

    runs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "b"), (4, None)], "run_id long, dataset_id string")
    blocks = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (9, 0)], "run_id long, block_no long")
    marks = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "dataset_id string")
    left, counts = fleet.delete_cascade("a", runs, blocks=blocks, marks=marks)
    got = {r["table"]: (r.n, r.n_left) for r in counts.collect()}
    assert got == {"runs": (1, 2), "blocks": (2, 2), "marks": (1, 2)}
    assert all(left[k].count() == got[k][1] for k in got)


def test_islands_over_bucket_borders_read_their_input_once(spark):
    """Runs that begin, end or go on at borders of buckets, over several of them, next to runs that touch none."""
    rng = random.Random(11)
    rows = [(k, z) for k in "abc" for z in range(200) if rng.random() < (0.97 if k == "a" else 0.6)]
    want, last = [], None
    for k, z in rows:
        if last == (k, z - 1):
            want[-1][2:] = [z + 1, want[-1][3] + 1]
        else:
            want.append([k, z, z + 1, 1])
        last = (k, z)
    df = spark.createDataFrame(rows, "k string, z long")
    got = O.islands(df.sample(1.0), ["k"], "z", 7)
    assert sorted(map(list, got.select("k", "run_start", "run_end", "run_length").collect())) == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Sample ") == 1


def test_sampled_windows_compute_their_candidates_once(spark):
    """The picked rows are kept, so the joins behind the candidates do not run again; with fewer windows than wanted all are drawn equally often."""
    from lamella.operators.sampling import sample_windows

    blocks = spark.createDataFrame([(b, 0, 512, 0, 512) for b in "ab"], "block_id string, y_start long, y_end long, x_start long, x_end long")
    windows = spark.createDataFrame([(b, z) for b in "ab" for z in range(10)], "block_id string, z0 long")
    for n, most in ((7, 1), (40, 2), (20, 1)):
        got = sample_windows(blocks, windows, (4, 128, 128), n, 1)
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
        times = {}
        for r in got.collect():
            times[r.block_id, r.z0] = times.get((r.block_id, r.z0), 0) + 1
        assert sum(times.values()) == n and max(times.values()) == most
    assert sample_windows(blocks, windows.limit(0), (4, 128, 128), 5, 1).count() == 0


def test_failure_windows_of_findings_that_know_their_block(spark):
    from lamella.operators.windows import failure_windows

    blocks = spark.createDataFrame([("a", 0, 100, 0, 1024, 0, 1024, "A"), ("b", 0, 10, 0, 1024, 0, 1024, "B")], "block_id string, z_start long, z_end long, y_start long, y_end long, x_start long, x_end long, grade string")
    found = spark.createDataFrame([(b, z, "blur", z % 3 + 1, "severe_blur", z / 100, 5 * z, 5 * z + 100, 7 * z, 7 * z + 100) for b in "ab" for z in range(40)],
                                  "block_id string, z long, failure_type string, sev int, check_name string, score double, by0 long, by1 long, bx0 long, bx1 long")
    size = (16, 256, 256)
    want = failure_windows(found, blocks, size)
    got = failure_windows(found.join(blocks, "block_id"), None, size).select(*want.columns)
    assert 0 < got.count() and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
