"""Patch geometry checks, training windows, label validation and derived maps."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as L
from ..operators import overlap as O
from ..operators import slice_checks as S
from ..operators import windows as W
from ..session import cut_lineage
from ..sources import tables as T
from .blocks_and_sampling import _ADJ
from .registry import query, sql
from .section_quality import rolled
from .views import view

H = 256
_PART = "CASE grade WHEN 'A' THEN 'train' WHEN 'B' THEN 'train' WHEN 'C' THEN 'val' ELSE 'test' END"


def _part_blocks(spark, sf):
    g = F.col("grade")
    return T.blocks(spark, sf).withColumn("partition", F.when(g.isin("A", "B"), "train").when(g == "C", "val").otherwise("test"))


_LEAK = {
    "pb": f"SELECT *, {_PART} AS part FROM v_blocks",
    "ids": "SELECT *, row_number() OVER (ORDER BY block_id, z0, y0, x0, partition_name) AS pid FROM v_patches",
    "pl": """SELECT p.*, b.part, (b.z_start <= z0 AND z1 <= b.z_end AND b.y_start <= y0 AND y1 <= b.y_end AND b.x_start <= x0 AND x1 <= b.x_end) AS inside FROM ids p JOIN pb b ON b.block_id = p.block_id""",
    "pr": """SELECT a.partition_name AS pa, b.partition_name AS pb, a.z0 AS az, b.z0 AS bz, (least(a.z1, b.z1) - greatest(a.z0, b.z0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) * (least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS inter
       FROM ids a JOIN ids b ON a.block_id = b.block_id AND a.pid < b.pid AND a.z0 < b.z1 AND b.z0 < a.z1 AND a.y0 < b.y1 AND b.y0 < a.y1 AND a.x0 < b.x1 AND b.x0 < a.x1""",
    "adj": _ADJ,
}


@query("patch_leak_check", "JN6, JN7, AGG24", sql("v_patches", "v_blocks", ctes=_LEAK, body="""
SELECT (SELECT count(*) FROM ids) AS n_patches, (SELECT CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM ids GROUP BY block_id, z0, z1, y0, y1, x0, x1)) AS n_duplicate_exact,
 (SELECT count(*) FROM pl WHERE NOT inside) AS n_outside_block, (SELECT count(*) FROM pl WHERE inside AND part <> partition_name) AS n_partition_mismatch,
 (SELECT count(*) FROM pl WHERE partition_name NOT IN ('train', 'val', 'test')) AS n_unpartitioned,
 (SELECT count(*) FROM pr WHERE pa <> pb) AS n_overlap_cross_partition, (SELECT count(*) FROM pr WHERE inter / CAST(2 * 16 * 256 * 256 - inter AS DOUBLE) >= 0.9e0) AS n_near_duplicate_pairs,
 (SELECT count(*) FROM adj JOIN pb a ON a.block_id = a_block_id JOIN pb b ON b.block_id = b_block_id WHERE a.part <> b.part
    AND a.block_id IN (SELECT block_id FROM ids) AND b.block_id IN (SELECT block_id FROM ids)) AS adjacent_cross_partition_block_pairs, false AS passed"""))
def patch_leak_check(spark, sf):
    p = T.patches(spark, sf).withColumnRenamed("partition_name", "partition")
    return O.leak_check(p, _part_blocks(spark, sf)).select(
        "n_patches", F.col("n_duplicate_exact"), "n_outside_block", "n_partition_mismatch", "n_unpartitioned", "n_overlap_cross_partition", "n_near_duplicate_pairs",
        "adjacent_cross_partition_block_pairs", "passed")


@query("patch_placement", "JN7", sql("v_patches", "v_blocks", ctes=_LEAK, body="""
SELECT block_id, count(*) AS n, count(*) FILTER (NOT inside) AS n_outside, count(*) FILTER (inside AND part <> partition_name) AS n_mismatch FROM pl GROUP BY block_id"""))
def patch_placement(spark, sf):
    p = O.place_in_blocks(T.patches(spark, sf).withColumnRenamed("partition_name", "partition"), _part_blocks(spark, sf))
    return p.groupBy("block_id").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("outside"), F.col("n"))), F.lit(0)).alias("n_outside"),
                                     F.coalesce(F.sum(F.when(F.col("mismatch"), F.col("n"))), F.lit(0)).alias("n_mismatch"))


_FW = {
    "j": """SELECT f.block_id, f.failure_type, f.sev, f.check_name, f.score, b.grade, f.z + b.z_start AS zc, b.*, b.x_start + (f.z * 37) % 800 AS bx0, b.y_start + (f.z * 53) % 800 AS by0
       FROM v_findings f JOIN v_blocks b ON b.block_id = f.block_id""",
    "w": """SELECT block_id, failure_type, sev, check_name, score, grade, zc, greatest(z_start, least(zc - 8, z_end - 16)) AS z0,
       CAST(trunc(greatest(CAST(y_start AS DOUBLE), least((by0 + by0 + 100) / 2e0 - 128e0, CAST(y_end - 256 AS DOUBLE)))) AS BIGINT) AS y0,
       CAST(trunc(greatest(CAST(x_start AS DOUBLE), least((bx0 + bx0 + 100) / 2e0 - 128e0, CAST(x_end - 256 AS DOUBLE)))) AS BIGINT) AS x0 FROM j""",
    "d": "SELECT *, row_number() OVER (PARTITION BY block_id, z0, y0, x0, failure_type ORDER BY sev DESC, zc, check_name, score) AS rn FROM w",
}


def _failure_windows(spark, sf, n=None):
    f = S.findings(rolled(spark, sf)).drop("dataset_id")
    b = T.blocks(spark, sf)
    z = F.col("z")
    geometry = b.select("block_id", "z_start", "z_end", "y_start", "y_end", "x_start", "x_end", "grade")
    placed = W.spread_join(f, geometry, ["block_id"], F.floor(z / 1024).cast("long"))
    placed = placed.withColumn("bx0", F.col("x_start") + (z * 37) % 800).withColumn("by0", F.col("y_start") + (z * 53) % 800).withColumn("z", z + F.col("z_start"))
    placed = placed.withColumn("bx1", F.col("bx0") + 100).withColumn("by1", F.col("by0") + 100)
    return W.failure_windows(placed, None, (16, 256, 256), n)


@query("failure_windows", "SMP9, JN9", sql("v_findings", "v_blocks", ctes=_FW, body="""
SELECT block_id, failure_type, CAST(sev AS INTEGER) AS sev, check_name, zc AS z_center, z0, y0, x0 FROM d WHERE rn = 1 ORDER BY sev DESC, zc, check_name, block_id, failure_type LIMIT 200"""))
def failure_windows(spark, sf):
    return _failure_windows(spark, sf, 200).select("block_id", "failure_type", "sev", "check_name", "z_center", "z0", "y0", "x0")


@query("patch_set_counters", "AGG23", sql("v_findings", "v_blocks", ctes={**_FW, "s": f"SELECT *, {_PART} AS partition FROM d WHERE rn = 1"}, body="""
SELECT 'partition' AS counter, partition AS value, count(*) AS n FROM s GROUP BY partition UNION ALL SELECT 'block', block_id, count(*) FROM s GROUP BY block_id
UNION ALL SELECT 'failure_type', failure_type, count(*) FROM s GROUP BY failure_type UNION ALL SELECT 'grade', grade, count(*) FROM s GROUP BY grade"""))
def patch_set_counters(spark, sf):
    p = _failure_windows(spark, sf)
    g = F.col("grade")
    return W.set_counters(p.withColumn("partition", F.when(g.isin("A", "B"), "train").when(g == "C", "val").otherwise("test")))


@query("patch_manifest", "SNK6, PRJ11", sql("v_findings", "v_blocks", ctes={**_FW, "k": """SELECT block_id, failure_type, z0, y0, x0, CASE grade WHEN 'A' THEN 'membrane' WHEN 'B' THEN 'synapse' ELSE 'segmentation' END AS patch_type, CASE WHEN grade <> 'D' THEN 7 END AS asset,
   concat('z0=', z0, '&z1=', z0 + 16, '&y0=', y0, '&y1=', y0 + 256, '&x0=', x0, '&x1=', x0 + 256) AS q FROM d WHERE rn = 1 ORDER BY block_id, z0, y0, x0, failure_type LIMIT 100 OFFSET 50"""}, body="""
SELECT block_id, failure_type, patch_type, concat('/api/v1/data/vol/cutout?', q, '&fmt=npy') AS url_em,
 CASE WHEN asset IS NOT NULL THEN concat('/api/v1/data/vol/labels/7/cutout?', q, '&derive=', CASE patch_type WHEN 'membrane' THEN 'boundary' WHEN 'synapse' THEN 'mask' ELSE 'ids' END) END AS url_label FROM k"""))
def patch_manifest(spark, sf):
    p = _failure_windows(spark, sf).withColumn("dataset_id", F.lit("vol"))
    g = F.col("grade")
    p = p.withColumn("patch_type", F.when(g == "A", "membrane").when(g == "B", "synapse").otherwise("segmentation"))
    page = p.orderBy("block_id", "z0", "y0", "x0", "failure_type").offset(50).limit(100)
    return W.manifest_urls(page, F.when(g != "D", F.lit(7))).select("block_id", "failure_type", "patch_type", "url_em", "url_label")


# ----------------------------------------------------------------------------- label planes

view("v_edges", """
SELECT z, y, x, bool_or(r) AS rdiff, bool_or(NOT r) AS ddiff FROM (
  SELECT coalesce(a.z, b.z) AS z, coalesce(a.y, b.y) AS y, coalesce(a.x, b.x - 1) AS x, true AS r FROM v_pixels a FULL OUTER JOIN v_pixels b ON a.z = b.z AND a.y = b.y AND a.x = b.x - 1
    WHERE coalesce(a.id, 0) <> coalesce(b.id, 0) AND coalesce(a.x, b.x - 1) >= 0 AND coalesce(a.x, b.x - 1) < 255
  UNION ALL
  SELECT coalesce(a.z, b.z), coalesce(a.y, b.y - 1), coalesce(a.x, b.x), false FROM v_pixels a FULL OUTER JOIN v_pixels b ON a.z = b.z AND a.x = b.x AND a.y = b.y - 1
    WHERE coalesce(a.id, 0) <> coalesce(b.id, 0) AND coalesce(a.y, b.y - 1) >= 0 AND coalesce(a.y, b.y - 1) < 255)
GROUP BY z, y, x""", "v_pixels")


@query("boundary_map", "PRJ15", sql("v_edges", body="SELECT z, y, count(*) AS n_boundary, CAST(sum(x) AS BIGINT) AS x_sum FROM v_edges GROUP BY z, y"))
def boundary_map(spark, sf):
    return L.boundary_map(T.pixels(spark, sf), H, H).groupBy("z", "y").agg(F.count(F.lit(1)).alias("n_boundary"), F.sum("x").alias("x_sum"))


@query("label_resample", "PRJ16, PRJ17, SRC10", sql("v_pixels", body="""
SELECT 'down' AS step, z, y // 2 AS y, x // 2 AS x, id FROM v_pixels WHERE y % 2 = 0 AND x % 2 = 0
UNION ALL SELECT 'up', z, y * 2 + i, x * 2 + j, id FROM (SELECT z, y // 4 AS y, x // 4 AS x, id FROM v_pixels WHERE y % 4 = 0 AND x % 4 = 0), (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)"""))
def label_resample(spark, sf):
    p = T.pixels(spark, sf).select("z", "y", "x", "id")
    down = L.downsample_labels(p, 2)
    up = L.upsample_labels(L.downsample_labels(p, 4), 2)
    cols = ["z", "y", "x", "id"]
    return down.select(F.lit("down").alias("step"), *cols).unionByName(up.select(F.lit("up").alias("step"), *cols))


@query("label_scale", "SRC10, ALG22", sql("v_volumes", body="""
SELECT dataset_id, CASE WHEN size_y >= n_z AND size_y % n_z = 0 THEN size_y // n_z WHEN n_z > size_y AND n_z % size_y = 0 THEN -(n_z // size_y) END AS scale,
 CASE WHEN size_y % 50 = 0 AND size_x % 50 = 0 AND size_y // 50 = size_x // 50 THEN size_y // 50 END AS common, (p_partkey % 251) * 65536 + (p_partkey % 241) * 256 + p_partkey % 239 AS packed FROM v_volumes"""))
def label_scale(spark, sf):
    from .blocks_and_sampling import volumes

    v, k = volumes(spark, sf), F.col("p_partkey")
    return v.select("dataset_id", L.label_scale(F.col("size_y"), F.col("n_z")).alias("scale"), L.plane_scale(F.col("size_y"), F.col("size_x"), F.lit(50), F.lit(50)).alias("common"),
                    L.pack_rgb(k % 251, k % 241, k % 239).alias("packed"))


_MASKS = "SELECT DISTINCT l_returnflag AS mask, CAST(l_linenumber AS BIGINT) AS z, l_orderkey % 256 AS y, l_partkey % 256 AS x FROM lineitem"


@query("mask_conflict", "JN5, AGG21", sql(ctes={"m": _MASKS, "c": "SELECT z, y, x, count(*) AS n FROM m GROUP BY z, y, x", "per": "SELECT z, count(*) FILTER (n > 1) / 65536e0 AS f FROM c GROUP BY z"}, body="""
SELECT z, round(f, 8) AS conflict_frac, CAST(NULL AS DOUBLE) AS mean_frac, CAST(NULL AS VARCHAR) AS status FROM per
UNION ALL SELECT NULL, round(max(f), 8), round(avg(f), 8), CASE WHEN max(f) < 0.001e0 THEN 'ok' ELSE 'warn' END FROM per"""))
def mask_conflict(spark, sf):
    li = T.load(spark, sf, "lineitem")
    m = li.select(F.col("l_returnflag").alias("mask"), F.col("l_linenumber").cast("long").alias("z"), (F.col("l_orderkey") % 256).alias("y"), (F.col("l_partkey") % 256).alias("x"))
    per, tot = L.mask_conflicts(m, None, H * H)
    none = F.lit(None)
    return per.select("z", F.round("conflict_frac", 8).alias("conflict_frac"), none.cast("double").alias("mean_frac"), none.cast("string").alias("status")).unionByName(
        tot.select(none.cast("bigint").alias("z"), F.round("conflict_frac_max", 8).alias("conflict_frac"), F.round("conflict_frac_mean", 8).alias("mean_frac"), "status"))


@query("label_section_stats", "AGG19, JN4", sql("v_pixels", ctes={"fill": "SELECT z, y, x FROM v_pixels WHERE id_after = 8"}, body="""
SELECT p.z, round(1 - count(*) / 65536e0, 8) AS frac_background, count(DISTINCT id) + CASE WHEN count(*) < 65536 THEN 1 ELSE 0 END AS n_ids,
 round(count(f.z) / CAST(count(*) AS DOUBLE), 8) AS frac_label_in_fill, round((SELECT count(*) FROM fill g WHERE g.z = p.z) / 65536e0, 8) AS fill_frac
FROM v_pixels p LEFT JOIN fill f ON f.z = p.z AND f.y = p.y AND f.x = p.x GROUP BY p.z"""))
def label_section_stats(spark, sf):
    p = T.pixels(spark, sf)
    s = L.section_label_stats(p.select("z", "y", "x", "id"), p.where("id_after = 8").select("z", "y", "x"), H, H)
    return s.select("z", F.round("frac_background", 8).alias("frac_background"), "n_ids", F.round("frac_label_in_fill", 8).alias("frac_label_in_fill"), F.round("fill_frac", 8).alias("fill_frac"))


_LD = """SELECT block_id, z, em_status, present, coalesce(present AND quality = 0 AND toxic = 1, false) AS corrupt, CASE WHEN toxic = 1 THEN 1e0 ELSE 0.4e0 END AS frac_background,
  CASE WHEN quality = 0 THEN 0.05e0 ELSE 0e0 END AS fill_frac, CASE WHEN quality = 0 THEN 0.03e0 ELSE 0e0 END AS frac_label_in_fill, CASE WHEN present THEN CASE WHEN z % 1000 < 990 THEN 'uint16' ELSE 'uint8' END END AS dtype FROM v_label_docs"""
_ISSUES = """SELECT *, list_filter([CASE WHEN NOT present AND em_status = 'ok' THEN 'label_missing' END, CASE WHEN present AND corrupt THEN 'label_corrupt' END,
   CASE WHEN present AND NOT corrupt AND em_status = 'ok' AND fill_frac > 0.001e0 AND frac_label_in_fill > 0.02e0 THEN 'label_in_fill' END,
   CASE WHEN present AND NOT corrupt AND em_status = 'ok' AND frac_background >= 0.999e0 THEN 'label_empty' END,
   CASE WHEN present AND NOT corrupt AND em_status <> 'ok' AND 1 - frac_background > 0.01e0 THEN 'label_without_image' END], lambda x: x IS NOT NULL) AS issues FROM ld"""


def _checked(spark, sf):
    d = T.label_docs(spark, sf)
    q, t = F.col("quality"), F.col("toxic")
    d = d.withColumn("corrupt", F.coalesce(F.col("present") & (q == 0) & (t == 1), F.lit(False))).withColumn("frac_background", F.when(t == 1, 1.0).otherwise(0.4))
    d = d.withColumn("fill_frac", F.when(q == 0, 0.05).otherwise(0.0)).withColumn("frac_label_in_fill", F.when(q == 0, 0.03).otherwise(0.0))
    d = d.withColumn("dtype", F.when(F.col("present"), F.when(F.col("z") % 1000 < 990, "uint16").otherwise("uint8")))
    return d.withColumn("issues", L.section_issues())


@query("label_validation", "ALG9, JN4, PRJ19", sql("v_label_docs", ctes={"ld": _LD, "iss": _ISSUES}, body="""
SELECT block_id, z, em_status, present, array_to_string(issues, ',') AS issues FROM iss WHERE len(issues) > 0"""))
def label_validation(spark, sf):
    return _checked(spark, sf).where(F.size("issues") > 0).select("block_id", "z", "em_status", "present", F.array_join("issues", ",").alias("issues"))


@query("label_asset_verdict", "AGG20", sql("v_label_docs", ctes={"ld": _LD, "iss": _ISSUES, "a": """SELECT block_id, count(*) AS n_sections, count(*) FILTER (len(issues) > 0) AS n_flagged, bool_or(corrupt) AS bad, 960 % (64 * (1 + CAST(substr(block_id, 4) AS BIGINT) % 5)) = 0 AS aligned, count(DISTINCT dtype) AS nd FROM iss GROUP BY block_id"""}, body="""
SELECT block_id, n_sections, n_flagged, CASE WHEN NOT aligned OR bad THEN 'fail' WHEN n_flagged > 0 THEN 'warn' ELSE 'ok' END AS status, aligned AND NOT bad AS usable_for_patches, nd > 1 AS encoding_inconsistent FROM a"""))
def label_asset_verdict(spark, sf):
    side = 64 * (1 + F.substr("block_id", F.lit(4)).cast("long") % 5)  # label planes of each asset over image planes of 960 pixels
    fits = L.plane_scale(F.lit(960), F.lit(960), side, side).isNotNull()
    return L.asset_verdict(_checked(spark, sf).withColumn("fits", fits), "block_id", F.bool_and("fits"))


# assets of every customer: type from the market segment, validated by balance
_AS = """SELECT concat('n', CAST(c_nationkey AS VARCHAR)) AS dataset_id, CASE c_custkey % 6 WHEN 0 THEN 'gt_segmentation' WHEN 1 THEN 'model_prediction' WHEN 2 THEN 'synapse_prediction' WHEN 3 THEN 'mitochondria_prediction' WHEN 4 THEN 'gt_annotation' ELSE 'skeleton' END AS asset_type,
 concat('seg/', c_name) AS path, CASE WHEN c_custkey % 12 < 6 THEN 'Synapse' ELSE 'mito' END AS class, c_acctbal > 7000 AS validated, c_acctbal > 9700 AS usable FROM customer"""


def _assets(spark, sf):
    c = T.load(spark, sf, "customer")
    k, types = F.col("c_custkey"), ["gt_segmentation", "model_prediction", "synapse_prediction", "mitochondria_prediction", "gt_annotation", "skeleton"]
    return c.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dataset_id"), F.get(F.array(*[F.lit(t) for t in types]), (k % 6).cast("int")).alias("asset_type"),
                    F.concat(F.lit("seg/"), "c_name").alias("path"), F.when(k % 12 < 6, "Synapse").otherwise("mito").alias("class"), (F.col("c_acctbal") > 7000).alias("validated"), (F.col("c_acctbal") > 9700).alias("usable"))


def _m(types, hint=None):
    t = f"asset_type IN ({', '.join(repr(x) for x in types)})"
    return t if hint is None else f"{t} AND (contains(lower(path), '{hint}') OR lower(class) = '{hint}')"


_G = {"gt": _m(("gt_segmentation",)), "pred": _m(("model_prediction",)), "syn": _m(("synapse_prediction", "gt_annotation"), "synapse"),
      "mito": _m(("mitochondria_prediction", "organelle_prediction", "gt_annotation"), "mito")}
_RE = {"a": _AS, "c": "SELECT dataset_id, " + ", ".join(f"count(*) FILTER ({m}) AS {g}_n, count(*) FILTER ({m} AND usable) AS {g}_ok, count(*) FILTER ({m} AND NOT validated) AS {g}_new" for g, m in _G.items()) + " FROM a GROUP BY dataset_id",
       "d": "SELECT concat('n', CAST(n_nationkey AS VARCHAR)) AS dataset_id, n_regionkey <> 0 AS has_qc FROM nation",
       "j": "SELECT d.dataset_id, has_qc, " + ", ".join(f"coalesce({g}_{s}, 0) AS {g}_{s}" for g in _G for s in ("n", "ok", "new")) + " FROM d LEFT JOIN c ON c.dataset_id = d.dataset_id"}


def _why(g):
    return f"CASE WHEN {g}_ok > 0 THEN NULL WHEN {g}_n = 0 THEN 'not_registered' WHEN {g}_new > 0 THEN 'not_validated' ELSE 'not_usable' END"


_BOTH = f"CASE WHEN gt_ok = 0 THEN {_why('gt')} ELSE {_why('pred')} END"
_RU = " UNION ALL ".join(f"SELECT dataset_id, '{t}' AS patch_type, has_qc, {w} AS reason FROM j" for t, w in (
    ("failure", "CASE WHEN NOT has_qc THEN 'run_qc_first' END"), ("segmentation", _why("gt")), ("membrane", _why("gt")), ("synapse", _why("syn")), ("mitochondria", _why("mito")), ("hard_negative", _BOTH), ("proofreading", _BOTH)))


def _ready(spark, sf):
    d = T.load(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("dataset_id"), (F.col("n_regionkey") != 0).alias("has_qc"))
    return L.readiness(d, _assets(spark, sf))


@query("readiness", "ALG10", sql(ctes={**_RE, "u": _RU}, body="SELECT dataset_id, patch_type, has_qc AND reason IS NULL AS ready, reason FROM u"))
def readiness(spark, sf):
    return _ready(spark, sf)


_CAP = "SELECT concat('n', CAST(c_nationkey AS VARCHAR)) AS dataset_id, CASE c_custkey % 3 WHEN 0 THEN 'slice' WHEN 1 THEN 'segment' ELSE 'patch' END AS level, count(*) FILTER (c_acctbal > 0) AS n, count(*) AS n_qc, CASE c_custkey % 3 WHEN 0 THEN 65536 WHEN 1 THEN 524288 ELSE 1048576 END AS px FROM customer GROUP BY 1, 2, 5"
_TASKS = [("raw", 0, "failure", "slice segment patch"), ("qc", 0, "failure", "slice patch"), ("segmentation", 4, "segmentation", "slice segment patch"), ("membrane", 1, "membrane", "slice segment patch"),
          ("synapse", 1, "synapse", "slice segment patch"), ("mitochondria", 1, "mitochondria", "slice segment patch"), ("hard_negative", 4, "hard_negative", "patch"), ("proofreading", 4, "proofreading", "patch")]


@query("pack_plan", "ALG11", sql(ctes={**_RE, "u": _RU, "cap": _CAP, "t": " UNION ALL ".join(f"SELECT '{a}' AS task, {b} AS lb, '{c}' AS patch_type, '{d}' AS lv" for a, b, c, d in _TASKS),
    "m": "SELECT cap.dataset_id, t.task, cap.level, contains(lv, level) AS ok, has_qc AND reason IS NULL AS rdy, reason, CASE WHEN contains(lv, level) AND has_qc AND reason IS NULL THEN CASE WHEN task = 'qc' THEN n_qc ELSE n END ELSE 0 END AS cnt, px, lb FROM cap, t JOIN u ON u.patch_type = t.patch_type WHERE u.dataset_id = cap.dataset_id"}, body="""
SELECT dataset_id, task, level, ok AS applicable, cnt > 0 AS ready, CASE WHEN NOT ok THEN 'no_such_level' WHEN NOT rdy THEN reason WHEN cnt = 0 THEN 'nothing_fits' END AS reason, CAST(cnt AS BIGINT) AS n, CAST(cnt * px * (1 + lb) AS BIGINT) AS est_bytes FROM m"""))
def pack_plan(spark, sf):
    k = F.col("c_custkey") % 3
    c = T.load(spark, sf, "customer").groupBy(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dataset_id"), F.when(k == 0, "slice").when(k == 1, "segment").otherwise("patch").alias("level"),
                                              F.when(k == 0, 65536).when(k == 1, 524288).otherwise(1048576).alias("px")).agg(F.count_if(F.col("c_acctbal") > 0).alias("n"), F.count(F.lit(1)).alias("n_qc"))
    return W.pack_plan(c, _ready(spark, sf))


# ----------------------------------------------------------------------------- label windows: 32 x 32 windows on the 256 x 256 planes


def _plane_blocks(p):
    q = [((F.floor(F.col(a) / 128)) * 128).cast("long").alias(f"{a}_start") for a in "yx"]
    b = p.groupBy(*q).agg(F.min("z").alias("z_start"), (F.max("z") + 1).alias("z_end"))
    return b.withColumn("y_end", F.col("y_start") + 128).withColumn("x_end", F.col("x_start") + 128).withColumn("block_id", F.concat_ws("_", F.lit("q"), "y_start", "x_start")).withColumn("grade", F.lit("A"))


def _drawn(spark, sf, accepted, seed=3):
    """Windows drawn in rounds; accepted(windows, pixels). The planes are of bounded size and counted once for all rounds."""
    from ..operators.runs import allowed_windows

    p = cut_lineage(T.pixels(spark, sf))
    b = _plane_blocks(p)
    return W.drawn(allowed_windows(b, None, 3), b, (3, 32, 32), lambda c: accepted(c, p), 64, seed)


@query("segmentation_windows", "SMP6, AGG25")
def segmentation_windows(spark, sf):
    e = _drawn(spark, sf, lambda c, p: W.accept_windows(W.label_evidence(c, p, H, H), "segmentation", min_fg=0.05))
    return e.select("window_id", "zc", "y0", "x0", "fg_frac", "n_ids", "boundary_frac")


@query("membrane_windows", "SMP6, AGG25")
def membrane_windows(spark, sf):
    e = _drawn(spark, sf, lambda c, p: W.accept_windows(W.label_evidence(c, p, H, H), "membrane"), 9)
    return e.select("window_id", "zc", "y0", "x0", "fg_frac", "n_ids", "boundary_frac")


def _planes(p):
    return p.where("id <> 1").select("z", "y", "x", "id"), p.where("id_after <> 8").select("z", "y", "x", F.col("id_after").alias("id"))


@query("hard_negative_windows", "SMP6, JN10")
def hard_negative_windows(spark, sf):
    d = _drawn(spark, sf, lambda c, p: W.disagreement(c, *_planes(p), H, H).where("disagreement >= 0.05"))
    return d.select("window_id", "zc", "fg_disagreement", "boundary_disagreement", "disagreement")


# every 32 x 32 tile of every plane as a window: evidence and ranking that SQL can repeat
_TILEW = {"w": "SELECT DISTINCT z, y // 32 AS ty, x // 32 AS tx FROM v_pixels",
          "gt": "SELECT z, y, x FROM v_pixels WHERE id <> 1", "pd": "SELECT z, y, x FROM v_pixels WHERE id_after <> 8",
          "fd": "SELECT coalesce(gt.z, pd.z) AS z, coalesce(gt.y, pd.y) // 32 AS ty, coalesce(gt.x, pd.x) // 32 AS tx, count(*) AS n FROM gt FULL OUTER JOIN pd ON gt.z = pd.z AND gt.y = pd.y AND gt.x = pd.x WHERE gt.z IS NULL OR pd.z IS NULL GROUP BY 1, 2, 3"}


def _edge_cte(src, name):
    return {f"{name}_r": f"SELECT coalesce(a.z, b.z) AS z, coalesce(a.y, b.y) AS y, coalesce(a.x, b.x - 1) AS x FROM {src} a FULL OUTER JOIN {src} b ON a.z = b.z AND a.y = b.y AND a.x = b.x - 1 WHERE coalesce(a.id, 0) <> coalesce(b.id, 0) AND coalesce(a.x, b.x - 1) >= 0 AND coalesce(a.x, b.x - 1) % 32 <> 31",
            f"{name}_d": f"SELECT coalesce(a.z, b.z) AS z, coalesce(a.y, b.y - 1) AS y, coalesce(a.x, b.x) AS x FROM {src} a FULL OUTER JOIN {src} b ON a.z = b.z AND a.x = b.x AND a.y = b.y - 1 WHERE coalesce(a.id, 0) <> coalesce(b.id, 0) AND coalesce(a.y, b.y - 1) >= 0 AND coalesce(a.y, b.y - 1) % 32 <> 31",
            name: f"SELECT z, y, x FROM {name}_r UNION SELECT z, y, x FROM {name}_d"}


_TILEW.update({"gti": "SELECT z, y, x, id FROM v_pixels WHERE id <> 1", "pdi": "SELECT z, y, x, id_after AS id FROM v_pixels WHERE id_after <> 8", **_edge_cte("gti", "eg"), **_edge_cte("pdi", "ep"),
               "bd": "SELECT z, ty, tx, count(*) AS n FROM (SELECT coalesce(eg.z, ep.z) AS z, coalesce(eg.y, ep.y) // 32 AS ty, coalesce(eg.x, ep.x) // 32 AS tx FROM eg FULL OUTER JOIN ep ON eg.z = ep.z AND eg.y = ep.y AND eg.x = ep.x WHERE eg.z IS NULL OR ep.z IS NULL) GROUP BY z, ty, tx"})


def _tile_windows(spark, sf):
    w = T.pixels(spark, sf).select(F.col("z").alias("zc"), (F.floor(F.col("y") / 32) * 32).alias("y0"), (F.floor(F.col("x") / 32) * 32).alias("x0")).distinct()
    return w.withColumn("y1", F.col("y0") + 32).withColumn("x1", F.col("x0") + 32).withColumn("window_id", F.concat_ws(":", "zc", "y0", "x0"))


@query("tile_disagreement", "AGG25, JN10, SMP7", sql("v_pixels", ctes=_TILEW, body="""
SELECT w.z AS zc, w.ty * 32 AS y0, w.tx * 32 AS x0, round(coalesce(fd.n, 0) / 1024e0, 8) AS fg_disagreement, round(coalesce(bd.n, 0) / 1024e0, 8) AS boundary_disagreement,
 CAST(row_number() OVER (ORDER BY 0.5e0 * (coalesce(fd.n, 0) / 1024e0) + 0.5e0 * (coalesce(bd.n, 0) / 1024e0) DESC, concat(w.z, ':', w.ty * 32, ':', w.tx * 32)) AS INTEGER) AS rank
FROM w LEFT JOIN fd ON fd.z = w.z AND fd.ty = w.ty AND fd.tx = w.tx LEFT JOIN bd ON bd.z = w.z AND bd.ty = w.ty AND bd.tx = w.tx ORDER BY rank LIMIT 100"""))
def tile_disagreement(spark, sf):
    d = W.disagreement(_tile_windows(spark, sf), *_planes(T.pixels(spark, sf)), H, H)
    return W.proofreading(d, 100).select("zc", "y0", "x0", F.round("fg_disagreement", 8).alias("fg_disagreement"), F.round("boundary_disagreement", 8).alias("boundary_disagreement"), "rank")


@query("tile_evidence", "AGG25", sql("v_pixels", ctes={**_edge_cte("v_pixels", "e"), "f": "SELECT z, y // 32 AS ty, x // 32 AS tx, count(*) AS n, count(DISTINCT id) AS ids FROM v_pixels GROUP BY 1, 2, 3",
    "b": "SELECT z, y // 32 AS ty, x // 32 AS tx, count(*) AS n FROM e GROUP BY 1, 2, 3"}, body="""
SELECT f.z AS zc, f.ty * 32 AS y0, f.tx * 32 AS x0, round(f.n / 1024e0, 8) AS fg_frac, ids AS n_ids, round(coalesce(b.n, 0) / 1024e0, 8) AS boundary_frac FROM f LEFT JOIN b ON b.z = f.z AND b.ty = f.ty AND b.tx = f.tx"""))
def tile_evidence(spark, sf):
    e = W.label_evidence(_tile_windows(spark, sf), T.pixels(spark, sf), H, H)
    return e.select("zc", "y0", "x0", F.round("fg_frac", 8).alias("fg_frac"), "n_ids", F.round("boundary_frac", 8).alias("boundary_frac"))
