"""Volumes, blocks, adjacency, training samples and holdout."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import partition as P
from ..operators import sampling as M
from ..sources import tables as T
from .registry import query, sql
from .section_runs import _ISL, slices
from .views import view

# every part is a volume: depth and plane from its size and key, voxel size known for two thirds
view("v_volumes", """
SELECT concat('v', CAST(p_partkey AS VARCHAR(20))) AS dataset_id, CAST(p_size * 7 + 30 AS BIGINT) AS n_z,
  CAST(300 + (p_partkey % 9) * 100 AS BIGINT) AS size_y, CAST(200 + (p_partkey % 13) * 150 AS BIGINT) AS size_x,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 4e0 + p_partkey % 5 END AS nm, p_partkey FROM part""")


def volumes(spark, sf):
    k = F.col("p_partkey")
    return T.load(spark, sf, "part").select(
        F.concat(F.lit("v"), k.cast("string")).alias("dataset_id"), (F.col("p_size") * 7 + 30).cast("long").alias("n_z"),
        (300 + (k % 9) * 100).cast("long").alias("size_y"), (200 + (k % 13) * 150).cast("long").alias("size_x"),
        F.when(k % 3 != 0, F.lit(4.0) + k % 5).alias("nm"), k)


@query("make_blocks", "PRJ1", sql("v_volumes", ctes={
    "z": "SELECT *, unnest(range(0, n_z, 64)) AS z_start FROM v_volumes",
    "y": "SELECT *, 1024 < size_y OR 1024 < size_x AS tiled, unnest(CASE WHEN 1024 < size_y OR 1024 < size_x THEN range(0, size_y, 1024) ELSE [0] END) AS y_start FROM z",
    "x": "SELECT *, unnest(CASE WHEN tiled THEN range(0, size_x, 1024) ELSE [0] END) AS x_start FROM y"}, body="""
SELECT dataset_id, concat('z', lpad(CAST(z_start AS VARCHAR), 5, '0'), '-', lpad(CAST(least(z_start + 64, n_z) - 1 AS VARCHAR), 5, '0'),
  CASE WHEN tiled THEN concat('_y', lpad(CAST(y_start AS VARCHAR), 5, '0'), '_x', lpad(CAST(x_start AS VARCHAR), 5, '0')) ELSE '' END) AS block_id,
  z_start, least(z_start + 64, n_z) AS z_end, CAST(y_start AS BIGINT) AS y_start, CASE WHEN tiled THEN least(y_start + 1024, size_y) ELSE size_y END AS y_end, CAST(x_start AS BIGINT) AS x_start,
  CASE WHEN tiled THEN least(x_start + 1024, size_x) ELSE size_x END AS x_end, least(z_start + 64, n_z) - z_start AS n_slices FROM x"""))
def make_blocks(spark, sf):
    return B.make_blocks(volumes(spark, sf), 64, 1024)


@query("volume_geometry", "PRJ2, PRJ3, PRJ5", sql("v_volumes", body="""
SELECT dataset_id, CASE WHEN n_z * size_y * size_x * 20 >= 2000000000 THEN 'large' ELSE 'small' END AS size_class,
 CASE WHEN n_z * size_y * size_x * 20 >= 2000000000 THEN 'train+inference' ELSE 'train' END AS usage,
 greatest(1, least(greatest(CASE WHEN nm IS NOT NULL THEN CAST(round_even(32e0 / nm, 0) AS BIGINT) ELSE CAST(ceil(greatest(size_y, size_x) / 256) AS BIGINT) END, CAST(ceil(greatest(size_y, size_x) / 512) AS BIGINT)),
   greatest(1, CAST(floor(least(size_y, size_x) / 48) AS BIGINT)))) AS serial_factor,
 CAST(least(1024, greatest(size_y, size_x)) AS DOUBLE) AS nominal_short FROM v_volumes"""))
def volume_geometry(spark, sf):
    v = volumes(spark, sf)
    vox = F.col("n_z") * F.col("size_y") * F.col("size_x") * 20
    size = B.classify_size(vox)
    edge = B.nominal_short(F.col("size_y") - 1, F.col("size_x"), F.col("size_y"), F.col("size_x"), 1024)
    return v.select("dataset_id", size.alias("size_class"), B.usage(size).alias("usage"), B.serial_factor(F.col("size_y"), F.col("size_x"), F.col("nm")).alias("serial_factor"), edge.alias("nominal_short"))


@query("roi_align", "PRJ13, PRJ4", sql("v_blocks", body="""
SELECT block_id, greatest(CAST(floor((x_start + 37) / 64) * 64 AS BIGINT), 0) AS x0, least(CAST(ceil((x_end - 11) / 64) * 64 AS BIGINT), 4090) AS x1,
  greatest(CAST(floor((y_start + 5) / 64) * 64 AS BIGINT), 0) AS y0, least(CAST(ceil((y_end - 3) / 64) * 64 AS BIGINT), 4090) AS y1, z_start AS z0, z_end AS z1,
  concat(x_start + 10, ',', y_start + 20, ',', x_start + 30, ',', y_start + 40) AS bbox FROM v_blocks"""))
def roi_align(spark, sf):
    b = T.blocks(spark, sf)
    text = F.concat_ws(",", F.concat(F.lit("z="), "z_start", F.lit("-"), "z_end"), F.concat(F.lit("x="), F.col("x_start") + 37, F.lit("-"), F.col("x_end") - 11),
                       F.concat(F.lit(" y="), F.col("y_start") + 5, F.lit("-"), F.col("y_end") - 3))
    roi = B.parse_roi(text)
    x = B.align_outward(*roi["x"], 64, 0, 4090)
    y = B.align_outward(*roi["y"], 64, 0, 4090)
    local = F.array(F.lit(10), F.lit(20), F.lit(30), F.lit(40)).cast("array<bigint>")
    box = F.array_join(B.to_dataset_frame(local, F.col("x_start"), F.col("y_start")).cast("array<string>"), ",")
    return b.select("block_id", x[0].alias("x0"), x[1].alias("x1"), y[0].alias("y0"), y[1].alias("y1"), roi["z"][0].alias("z0"), roi["z"][1].alias("z1"), box.alias("bbox"))


_ADJ = """SELECT a.block_id AS a_block_id, b.block_id AS b_block_id,
 CASE WHEN a.z_end = b.z_start OR b.z_end = a.z_start THEN 'z' WHEN a.y_end = b.y_start OR b.y_end = a.y_start THEN 'y' ELSE 'x' END AS axis FROM v_blocks a JOIN v_blocks b ON a.block_id < b.block_id AND
 (((a.z_end = b.z_start OR b.z_end = a.z_start) AND a.y_start < b.y_end AND b.y_start < a.y_end AND a.x_start < b.x_end AND b.x_start < a.x_end)
 OR ((a.y_end = b.y_start OR b.y_end = a.y_start) AND a.z_start < b.z_end AND b.z_start < a.z_end AND a.x_start < b.x_end AND b.x_start < a.x_end)
 OR ((a.x_end = b.x_start OR b.x_end = a.x_start) AND a.z_start < b.z_end AND b.z_start < a.z_end AND a.y_start < b.y_end AND b.y_start < a.y_end))"""


@query("block_adjacency", "JN8", sql("v_blocks", body=_ADJ))
def block_adjacency(spark, sf):
    return B.face_neighbours(T.blocks(spark, sf), {"z": 100, "y": 1024, "x": 1024})


@query("tile_plan", "PRJ18, SET3", sql("v_volumes", ctes={
    "t": "SELECT concat(dataset_id, '_y', lpad(CAST(y0 AS VARCHAR), 4, '0'), '_x', lpad(CAST(x0 AS VARCHAR), 4, '0')) AS tile, dataset_id AS parent, y0, x0, size_x FROM (SELECT *, unnest(range(0, size_x, 100)) AS x0 FROM (SELECT *, unnest(range(0, size_y, 100)) AS y0 FROM v_volumes WHERE size_y % 100 = 0 AND size_x % 100 = 0))",
    "used": "SELECT concat('v', CAST(c_custkey AS VARCHAR), '_y0000_x0100') AS tile FROM customer WHERE c_acctbal < 0"}, body="""
SELECT t.tile, t.parent, y0, x0, (y0 // 100) * (size_x // 100) + x0 // 100 AS index, CASE WHEN used.tile IS NOT NULL THEN 'work_dir' END AS problem FROM t LEFT JOIN used ON used.tile = t.tile
UNION ALL SELECT NULL, dataset_id, NULL, NULL, NULL, 'not_a_multiple' FROM v_volumes WHERE size_y % 100 <> 0 OR size_x % 100 <> 0"""))
def tile_plan(spark, sf):
    tiles, bad = B.cut_tiles(volumes(spark, sf).withColumnRenamed("dataset_id", "parent"), 100)
    used = T.load(spark, sf, "customer").where("c_acctbal < 0").select(F.concat(F.lit("v"), F.col("c_custkey").cast("string"), F.lit("_y0000_x0100")).alias("tile"))
    clash = B.tile_clashes(tiles, work_dir=used)
    ok = tiles.join(clash, "tile", "left").select("tile", "parent", "y0", "x0", "index", F.col("clash").alias("problem"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("tile", "string"), ("y0", "bigint"), ("x0", "bigint"), ("index", "bigint"))]
    return ok.unionByName(bad.select(none[0], "parent", *none[1:], F.col("reason").alias("problem")))


# graded blocks of four datasets
_BD = "SELECT concat('d', CAST(block_no % 4 AS VARCHAR)) AS dataset_id, * FROM v_blocks"


def _graded(spark, sf):
    return T.blocks(spark, sf).withColumn("dataset_id", F.concat(F.lit("d"), (F.col("block_no") % 4).cast("string")))


@query("train_sample", "SMP1", sql("v_blocks", ctes={"bd": _BD,
    "n": "SELECT dataset_id, count(*) FILTER (grade='A') AS ha, count(*) FILTER (grade='B') AS hb, count(*) FILTER (grade='C') AS hc FROM bd GROUP BY dataset_id",
    "q0": "SELECT *, least(12, ha + hb + hc) AS w FROM n",
    "q1": "SELECT *, CAST(round_even(w * 0.3e0, 0) AS BIGINT) AS qb, CAST(round_even(w * 0.2e0, 0) AS BIGINT) AS qc FROM q0",
    "q2": "SELECT *, w - qb - qc AS qa FROM q1",
    "t1": "SELECT *, least(qa, ha) AS ta, qa - least(qa, ha) AS l1 FROM q2",
    "t2": "SELECT *, least(qb + l1, hb) AS tb, qb + l1 - least(qb + l1, hb) AS l2 FROM t1",
    "t3": "SELECT *, least(qc + l2, hc) AS tc, qc + l2 - least(qc + l2, hc) AS l3 FROM t2",
    "t4": "SELECT dataset_id, ta + least(l3, ha - ta) AS ta, l3 - least(l3, ha - ta) AS l4, tb, hb, tc, hc FROM t3",
    "t5": "SELECT dataset_id, ta, tb + least(l4, hb - tb) AS tb, tc, hc, l4 - least(l4, hb - tb) AS l5 FROM t4",
    "t6": "SELECT dataset_id, ta, tb, tc + least(l5, hc - tc) AS tc FROM t5",
    "r": "SELECT dataset_id, grade, block_id, row_number() OVER (PARTITION BY dataset_id, grade ORDER BY sha1(concat('42:', block_id)), block_id) AS rn FROM bd WHERE grade <> 'D'"}, body="""
SELECT r.dataset_id, grade, block_id FROM r JOIN t6 ON t6.dataset_id = r.dataset_id WHERE rn <= CASE grade WHEN 'A' THEN ta WHEN 'B' THEN tb ELSE tc END"""))
def train_sample(spark, sf):
    return M.select_train_blocks(_graded(spark, sf), 12).select("dataset_id", "grade", "block_id")


@query("train_sample_policies", "SMP2", sql("v_blocks", ctes={"bd": _BD}, body="""
SELECT 'best' AS policy, dataset_id, block_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY grade, retention DESC, quality DESC, block_id) AS rn FROM bd WHERE grade <> 'D') WHERE rn <= 8
UNION ALL SELECT 'random_usable', dataset_id, block_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY sha1(concat('42:', block_id)), block_id) AS rn FROM bd WHERE grade <> 'D') WHERE rn <= 8"""))
def train_sample_policies(spark, sf):
    b = _graded(spark, sf)
    out = [M.select_train_blocks(b, 8, policy=p).select(F.lit(p).alias("policy"), "dataset_id", "block_id") for p in ("best", "random_usable")]
    return out[0].unionByName(out[1])


# splits and earlier assignments that the holdout must respect
_HB = """SELECT concat('d', CAST(block_no % 4 AS VARCHAR)) AS dataset_id, block_id, grade, CASE WHEN quality > 0.9e0 THEN 'inference' ELSE 'train_sample' END AS split,
  CASE WHEN retention > 0.93e0 THEN 'val' WHEN retention > 0.9e0 THEN 'train' ELSE 'none' END AS partition FROM v_blocks"""


def _holdout_input(spark, sf):
    return _graded(spark, sf).select("dataset_id", "block_id", "grade", F.when(F.col("quality") > 0.9, "inference").otherwise("train_sample").alias("split"),
                                     F.when(F.col("retention") > 0.93, "val").when(F.col("retention") > 0.9, "train").otherwise("none").alias("partition"))


@query("holdout_assign", "SMP3, WIN13", sql("v_blocks", ctes={"hb": _HB,
    "st": """SELECT *, CASE WHEN split = 'train_sample' AND grade <> 'D' THEN CASE WHEN partition <> 'none' THEN 'keep' ELSE 'new' END WHEN split = 'train_sample' THEN 'excluded' ELSE 'none' END AS state FROM hb""",
    "c": "SELECT dataset_id, count(*) FILTER (state IN ('keep', 'new')) AS n, count(*) FILTER (state = 'keep' AND partition = 'train') AS htr, count(*) FILTER (state = 'keep' AND partition = 'val') AS hva, 0 AS hte FROM st GROUP BY dataset_id",
    "f": "SELECT *, CAST(floor(n * 0.8e0) AS BIGINT) AS a0, greatest(1, CAST(floor(n * 0.1e0) AS BIGINT)) AS b0, greatest(1, CAST(floor(n * 0.1e0) AS BIGINT)) AS c0, n * 0.8e0 - floor(n * 0.8e0) AS fa, n * 0.1e0 - floor(n * 0.1e0) AS fb FROM c",
    "g": "SELECT *, a0 - greatest(0, a0 + b0 + c0 - n) AS a1 FROM f",
    "h": "SELECT *, n - a1 - b0 - c0 AS short FROM g",
    # remainders: val and test tie, val first; train leads when its fraction is at least theirs
    # fewer than three eligible blocks: everything is train
    "tg": """SELECT dataset_id, CASE WHEN n < 3 THEN n ELSE a1 + CASE WHEN (CASE WHEN fa >= fb THEN 0 ELSE 2 END) < short THEN 1 ELSE 0 END END - htr AS dtr,
        CASE WHEN n < 3 THEN 0 ELSE b0 + CASE WHEN (CASE WHEN fa >= fb THEN 1 ELSE 0 END) < short THEN 1 ELSE 0 END END - hva AS dva,
        CASE WHEN n < 3 THEN 0 ELSE c0 + CASE WHEN (CASE WHEN fa >= fb THEN 2 ELSE 1 END) < short THEN 1 ELSE 0 END END - hte AS dte FROM h""",
    "newb": "SELECT dataset_id, block_id, row_number() OVER (PARTITION BY dataset_id ORDER BY sha1(concat('42:', block_id)), block_id) AS rn FROM st WHERE state = 'new'",
    "walk": """SELECT dataset_id, CAST(0 AS BIGINT) AS rn, dtr, dva, dte, CAST('' AS VARCHAR) AS pick FROM tg
      UNION ALL SELECT w.dataset_id, w.rn + 1, w.dtr - CASE WHEN p.pick = 'train' THEN 1 ELSE 0 END, w.dva - CASE WHEN p.pick = 'val' THEN 1 ELSE 0 END, w.dte - CASE WHEN p.pick = 'test' THEN 1 ELSE 0 END, p.pick
      FROM walk w JOIN newb b ON b.dataset_id = w.dataset_id AND b.rn = w.rn + 1,
      LATERAL (SELECT CASE WHEN greatest(w.dtr, w.dva, w.dte) <= 0 OR w.dtr >= greatest(w.dva, w.dte) THEN 'train' WHEN w.dva >= w.dte THEN 'val' ELSE 'test' END AS pick) p"""}, body="""
SELECT st.dataset_id, st.block_id, CASE state WHEN 'keep' THEN partition WHEN 'new' THEN pick ELSE state END AS new_partition FROM st
LEFT JOIN newb ON newb.block_id = st.block_id LEFT JOIN walk ON walk.dataset_id = newb.dataset_id AND walk.rn = newb.rn"""))
def holdout_assign(spark, sf):
    return P.assign_partitions(_holdout_input(spark, sf)).select("dataset_id", "block_id", "new_partition")


@query("holdout_adjacency", "JN8, SMP3 report", sql("v_blocks", ctes={"adj": _ADJ, "p": "SELECT block_id, CASE grade WHEN 'A' THEN 'train' WHEN 'B' THEN 'val' WHEN 'C' THEN 'test' ELSE 'excluded' END AS part FROM v_blocks"}, body="""
SELECT a.part AS a_partition, b.part AS b_partition, count(*) AS n_pairs FROM adj JOIN p a ON a.block_id = a_block_id JOIN p b ON b.block_id = b_block_id WHERE a.part <> b.part AND a.part <> 'excluded' AND b.part <> 'excluded' GROUP BY 1, 2"""))
def holdout_adjacency(spark, sf):
    p = F.when(F.col("grade") == "A", "train").when(F.col("grade") == "B", "val").when(F.col("grade") == "C", "test")
    b = T.blocks(spark, sf).withColumn("partition", p).where("partition IS NOT NULL")
    return B.face_neighbours(b, {"z": 100, "y": 1024, "x": 1024}, ["partition"]).where("a_partition <> b_partition").groupBy("a_partition", "b_partition").agg(
        F.count(F.lit(1)).alias("n_pairs"))


@query("supplied_difficulty", "SMP16", sql("v_blocks", body="""
SELECT block_id, round(CASE WHEN grade = 'D' THEN greatest(d, 0.9e0) ELSE d END, 6) AS difficulty FROM (SELECT *, 0.5e0 * (1e0 - quality) + 0.3e0 * (1e0 - retention) + 0.2e0 * least(1e0, (block_no % 120) / 100e0) AS d FROM v_blocks)"""))
def supplied_difficulty(spark, sf):
    from ..operators.rollup import difficulty

    d = difficulty(F.col("quality"), F.col("retention"), F.col("block_no") % 120, F.lit(100), F.col("grade"))
    return T.blocks(spark, sf).select("block_id", F.round(d, 6).alias("difficulty"))


@query("even_spread", "SMP10", sql("v_slices", ctes={
    "r": "SELECT block_id, z, row_number() OVER (ORDER BY z, block_id) - 1 AS pos, count(*) OVER () AS n FROM v_slices WHERE passed",
    "w": "SELECT DISTINCT CAST(round_even(k * (n - 1) / 399e0, 0) AS BIGINT) AS pos FROM (SELECT n FROM r LIMIT 1), (SELECT unnest(range(0, 400)) AS k)"}, body="""
SELECT block_id, z FROM r JOIN w ON w.pos = r.pos"""))
def even_spread(spark, sf):
    s = slices(spark, sf).where("passed").select("block_id", "z")
    return M.even_spread(s, 400, ["z", "block_id"], F.col("z").cast("long"))


@query("qc_balance", "SMP11, SET2", sql("v_slices", ctes={
    "r": "SELECT block_id, z, passed, row_number() OVER (PARTITION BY passed ORDER BY substr(md5(block_id), 1, 3), block_id, z) - 1 AS pos, count(*) OVER (PARTITION BY passed) AS n FROM v_slices",
    "w": "SELECT DISTINCT passed, CAST(round_even(k * (n - 1) / 199e0, 0) AS BIGINT) AS pos FROM (SELECT DISTINCT passed, n FROM r), (SELECT unnest(range(0, 200)) AS k)"}, body="""
SELECT block_id, z, CASE WHEN r.passed THEN 'clean' ELSE 'fail' END AS cls FROM r JOIN w ON w.pos = r.pos AND w.passed = r.passed"""))
def qc_balance(spark, sf):
    return M.balance_failed_and_clean(slices(spark, sf).select("block_id", "z", "passed"), 400).select("block_id", "z", "cls")


@query("shard_tiling", "SMP14", sql("v_slices", "v_blocks", ctes=_ISL, body="""
SELECT block_id, pz, py, unnest(range(x_start, x_end - 255, 256)) AS px FROM (SELECT *, unnest(range(y_start, y_end - 255, 256)) AS py FROM
 (SELECT b.*, unnest(range(run_start, run_end - 7, 8)) AS pz FROM isl JOIN v_blocks b ON b.block_id = isl.block_id WHERE run_length >= 8))"""))
def shard_tiling(spark, sf):
    from ..operators.runs import clean_runs, split_shards

    s = split_shards(clean_runs(slices(spark, sf), ["block_id"], 8), 0).join(T.blocks(spark, sf), "block_id")
    return M.shard_patches(s, (8, 256, 256), (8, 256, 256)).select("block_id", "pz", "py", "px")


def _train_windows(spark, sf, dz=4):
    from ..operators.runs import allowed_windows
    from .section_runs import section_blocks

    s = slices(spark, sf)
    return allowed_windows(section_blocks(s), s, dz)


def _draw(seed, *key):
    return f"CAST(concat('0x', substr(md5(concat_ws(':', '{seed}', {', '.join(key)})), 1, 15)) AS BIGINT)"


_RUNS = {"isl": """SELECT block_id, min(z) AS run_start, max(z) + 1 AS run_end, count(*) AS run_length FROM
   (SELECT block_id, z, z - row_number() OVER (PARTITION BY block_id ORDER BY z) AS g FROM v_slices WHERE passed) GROUP BY block_id, g"""}
_WINDOWS = {**_RUNS, "win": "SELECT w.*, y_start, y_end, x_start, x_end, grade FROM (SELECT block_id, unnest(range(run_start, run_end - 3)) AS z0 FROM isl WHERE run_length >= 4) w JOIN v_blocks b ON b.block_id = w.block_id"}


@query("shard_draws", "SMP14 weighted", sql("v_slices", ctes={**_RUNS,
    "sh": "SELECT block_id, z0, least(z0 + 16, run_end) - z0 - 3 AS w FROM (SELECT block_id, run_end, unnest(range(run_start, run_end, 16)) AS z0 FROM isl WHERE run_length >= 4)",
    "p": "SELECT *, CAST(sum(w) OVER (ORDER BY substr(sha1(concat_ws(':', block_id, z0)), 1, 3), block_id, z0) AS BIGINT) AS hi FROM sh WHERE w >= 1",
    "d": f"SELECT CAST(i AS BIGINT) AS draw, {_draw(7, 'i')} % (SELECT max(hi) FROM p) AS pos FROM (SELECT unnest(range(0, 256)) AS i)"}, body="""
SELECT draw, block_id, z0 + pos - (hi - w) AS z0 FROM d JOIN p ON pos >= hi - w AND pos < hi"""))
def shard_draws(spark, sf):
    from ..operators.runs import clean_runs, split_shards

    return M.weighted_shard_draws(split_shards(clean_runs(slices(spark, sf), ["block_id"], 4), 16), 4, 256, 7)


@query("sample_windows", "SMP4", sql("v_slices", "v_blocks", ctes={**_WINDOWS,
    "dr": "SELECT *, unnest(range(0, (SELECT greatest(1, CAST(ceil(64e0 / count(*)) AS BIGINT)) FROM win))) AS r FROM win",
    "pk": f"SELECT *, y_start + {_draw(2, 'block_id', 'z0', 'r')} % 897 AS y0, x_start + {_draw(3, 'block_id', 'z0', 'r')} % 897 AS x0 FROM dr ORDER BY r, {_draw(1, 'block_id', 'z0', 'r')}, block_id, z0 LIMIT 64"}, body="""
SELECT block_id, z0, z0 + 4 AS z1, y0, y0 + 128 AS y1, x0, x0 + 128 AS x1 FROM pk"""))
def sample_windows(spark, sf):
    return M.sample_windows(T.blocks(spark, sf), _train_windows(spark, sf), (4, 128, 128), 64, 1).select("block_id", "z0", "z1", "y0", "y1", "x0", "x1")


@query("raw_windows", "SMP5", sql("v_slices", "v_blocks", ctes={**_WINDOWS,
    "c": f"SELECT *, {_draw(1, 'block_id', 'z0')} AS h, y_start + {_draw(2, 'block_id', 'z0')} % 897 AS y0, x_start + {_draw(3, 'block_id', 'z0')} % 897 AS x0 FROM win",
    "f": "SELECT *, row_number() OVER (PARTITION BY block_id, z0 // 2, y0 // 64, x0 // 64 ORDER BY h, z0, y0, x0) AS rn FROM c"}, body="""
SELECT block_id, z0, z0 + 4 AS z1, y0, y0 + 128 AS y1, x0, x0 + 128 AS x1 FROM (SELECT * FROM f WHERE rn = 1 ORDER BY h, block_id, z0 LIMIT 64)"""))
def raw_windows(spark, sf):
    return M.raw_windows(T.blocks(spark, sf), _train_windows(spark, sf), (4, 128, 128), 64, 1).select("block_id", "z0", "z1", "y0", "y1", "x0", "x1")
