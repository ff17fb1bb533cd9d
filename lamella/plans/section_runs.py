"""Runs, shards, windows, export verdicts and stream plans."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import delivery as D
from ..operators import runs as W
from ..operators import slice_checks as S
from ..sources import tables as T
from .registry import query, sql
from .section_quality import _report, rolled


def slices(spark, sf):
    return rolled(spark, sf).select("dataset_id", "block_id", "z", "status", "quality", "max_sev", "passed", "ts")


_ISL = {"isl": """SELECT block_id, min(z) AS run_start, max(z) + 1 AS run_end, count(*) AS run_length FROM
   (SELECT block_id, z, z - row_number() OVER (PARTITION BY block_id ORDER BY z) AS g FROM v_slices WHERE passed) GROUP BY block_id, g"""}


@query("clean_runs", "WIN1", sql("v_slices", ctes=_ISL, body="SELECT block_id, run_start, run_end, run_length FROM isl WHERE run_length >= 4"))
def clean_runs(spark, sf):
    return W.clean_runs(slices(spark, sf), ["block_id"], 4).select("block_id", "run_start", "run_end", "run_length")


@query("longest_run", "WIN2", sql("v_slices", ctes=_ISL, body="""
SELECT s.block_id, CAST(coalesce(max(run_length), 0) AS BIGINT) AS longest_clean_run FROM (SELECT DISTINCT block_id FROM v_slices) s LEFT JOIN isl ON isl.block_id = s.block_id GROUP BY s.block_id"""))
def longest_run(spark, sf):
    runs = W.clean_runs(slices(spark, sf), ["block_id"], 1).groupBy("block_id").agg(F.max("run_length").alias("n"))
    return T.sections(spark, sf).select("block_id").distinct().join(runs, "block_id", "left").select("block_id", F.coalesce("n", F.lit(0)).cast("long").alias("longest_clean_run"))


@query("shards", "WIN3", sql("v_slices", ctes=_ISL, body="""
SELECT block_id, z0, least(z0 + 8, run_end) AS z1 FROM (SELECT block_id, run_end, unnest(range(run_start, run_end, 8)) AS z0 FROM isl WHERE run_length >= 2)"""))
def shards(spark, sf):
    return W.split_shards(W.clean_runs(slices(spark, sf), ["block_id"], 2), 8).select("block_id", "z0", "z1")


def section_blocks(s):
    """Blocks as the z range their sections span."""
    return s.groupBy("block_id").agg(F.min("z").alias("z_start"), (F.max("z") + 1).alias("z_end"))


@query("allowed_windows", "WIN4", sql("v_slices", ctes={
    "ok": "SELECT block_id, z, status <> 'missing' AND passed AND quality >= 0.3e0 AS good FROM v_slices",
    "w": "SELECT block_id, z, sum(CAST(good AS INTEGER)) OVER (PARTITION BY block_id ORDER BY z ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS n FROM ok"},
    body="SELECT block_id, z AS z0 FROM w WHERE n = 4"))
def allowed_windows(spark, sf):
    s = slices(spark, sf)
    return W.allowed_windows(section_blocks(s), s.where("status <> 'missing'"), 4, True, 0.3)


@query("unfiltered_windows", "WIN4 without QC", sql("v_blocks", body="SELECT block_id, unnest(range(z_start, z_end - 15)) AS z0 FROM v_blocks"))
def unfiltered_windows(spark, sf):
    return W.allowed_windows(T.blocks(spark, sf), None, 16)


_CODES = {
    "rec": "SELECT * FROM v_slices WHERE status <> 'missing'",
    "okr": "SELECT block_id, z, passed AND quality >= 0.3e0 AS okq, passed FROM rec",
    "isl": """SELECT block_id, min(z) AS a, max(z) AS b FROM (SELECT block_id, z, z - row_number() OVER (PARTITION BY block_id ORDER BY z) AS g FROM okr WHERE okq) GROUP BY block_id, g HAVING count(*) >= 3""",
    "codes": """SELECT s.block_id, s.z, CASE WHEN o.z IS NULL THEN 'M' WHEN i.a IS NOT NULL THEN 'K' WHEN o.okq THEN 'S' WHEN o.passed THEN 'L' ELSE 'Q' END AS code
      FROM v_slices s LEFT JOIN okr o ON o.block_id = s.block_id AND o.z = s.z LEFT JOIN isl i ON i.block_id = s.block_id AND s.z BETWEEN i.a AND i.b""",
}


def _codes(spark, sf):
    s = slices(spark, sf)
    return W.export_codes(section_blocks(s), s.where("status <> 'missing'"), 3, 0.3)


@query("export_codes", "ALG12", sql("v_slices", ctes=_CODES, body="""
SELECT block_id, CAST(floor(z / 1024) AS BIGINT) AS strip, string_agg(code, '' ORDER BY z) AS codes FROM codes GROUP BY block_id, floor(z / 1024)"""))
def export_codes(spark, sf):
    return W.code_strips(_codes(spark, sf))


@query("export_totals", "ALG12, SET4", sql("v_slices", ctes={**_CODES, "ex": "SELECT block_id, z FROM rec EXCEPT ALL SELECT block_id, z FROM okr WHERE okq"}, body="""
SELECT code, count(*) AS n FROM codes GROUP BY code UNION ALL SELECT 'excluded', count(*) FROM ex"""))
def export_totals(spark, sf):
    s = slices(spark, sf).where("status <> 'missing'")
    ex = W.excluded_sections(s, 0.3).agg(F.count(F.lit(1)).alias("n")).select(F.lit("excluded").alias("code"), "n")
    return _codes(spark, sf).groupBy("code").agg(F.count(F.lit(1)).alias("n")).unionByName(ex)


@query("export_shards", "ALG12, SNK2 plan", sql("v_slices", "v_blocks", ctes=_ISL, body="""
SELECT b.block_id, b.grade, z0, z1, z1 - z0 AS n_sections, (z1 - z0) * (y_end - y_start) * (x_end - x_start) AS bytes FROM
 (SELECT block_id, z0, least(z0 + 16, run_end) AS z1 FROM (SELECT block_id, run_end, unnest(range(run_start, run_end, 16)) AS z0 FROM isl)) s JOIN v_blocks b ON b.block_id = s.block_id"""))
def export_shards(spark, sf):
    return D.export_shards(T.blocks(spark, sf), slices(spark, sf), 1, 16)


# sections sit at z_start + z of the block with the same id
_FAIL = {"failed": "SELECT s.block_id, b.z_start + s.z AS z FROM v_slices s JOIN v_blocks b ON b.block_id = s.block_id WHERE NOT passed",
         "it": "SELECT b.*, unnest(range(z_start, z_end, 16)) AS z0 FROM v_blocks b",
         "items": """SELECT it.*, least(z0 + 16, z_end) AS z1, (SELECT count(*) FROM failed f WHERE f.block_id = it.block_id AND f.z >= it.z0 AND f.z < least(z0 + 16, z_end)) AS n_failed FROM it"""}


def _failed(spark, sf):
    bad = slices(spark, sf).where("NOT passed").select("block_id", "z")
    b = T.blocks(spark, sf).select("block_id", "z_start")
    return D.spread_join(bad, b, ["block_id"], F.floor(F.col("z") / 4096).cast("long")).select("block_id", (F.col("z_start") + F.col("z")).alias("z"))


@query("stream_plan", "ALG13, JN1", sql("v_slices", "v_blocks", ctes=_FAIL, body="""
SELECT row_number() OVER (ORDER BY CASE grade WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'C' THEN 2 WHEN 'D' THEN 3 ELSE 4 END, z_start, y_start, x_start, block_id, z0) - 1 AS i,
  block_id, grade, z0, z1, n_failed, (z1 - z0) * (y_end - y_start) * (x_end - x_start) AS bytes FROM items WHERE n_failed = 0"""))
def stream_plan(spark, sf):
    p = D.stream_plan(T.blocks(spark, sf), _failed(spark, sf), 16, "grade", True)
    return p.select("i", "block_id", "grade", "z0", "z1", "n_failed", "bytes")


_STATE = "CASE grade WHEN 'A' THEN 'ok' WHEN 'B' THEN 'out' WHEN 'C' THEN 'fail' END"


@query("stream_map", "ALG14, JN19", sql("v_slices", "v_blocks", ctes=_FAIL, body=f"""
SELECT block_id, CASE WHEN n_failed > 0 THEN 'skipped' ELSE coalesce({_STATE}, 'pending') END AS state, count(*) AS n, CAST(sum(n_failed) AS BIGINT) AS n_failed FROM items GROUP BY 1, 2"""))
def stream_map(spark, sf):
    b, f = T.blocks(spark, sf), _failed(spark, sf)
    mine = D.stream_plan(b, f, 16, "z", True).withColumn("state", F.expr(_STATE))
    m = D.session_map(D.stream_plan(b, f, 16, "z", False), mine)
    return m.groupBy("block_id", "state").agg(F.count(F.lit(1)).alias("n"), F.sum("n_failed").alias("n_failed"))


@query("stream_rate", "ALG14", sql("v_slices", "v_sections", body="""
SELECT n AS n_acks, round((n - 1) / (date_diff('microsecond', a, b) / 1e6) * 60, 6) AS chunks_per_min FROM
 (SELECT count(*) AS n, min(t) AS a, max(t) AS b FROM (SELECT max(ts) AS t FROM v_sections GROUP BY block_id, floor(z / 16)))"""))
def stream_rate(spark, sf):
    chunks = T.sections(spark, sf).groupBy("block_id", F.floor(F.col("z") / 16).alias("c")).agg(F.max("ts").alias("t_ack"))
    return D.session_rate(chunks).select("n_acks", F.round("chunks_per_min", 6).alias("chunks_per_min"))


@query("worst_per_z", "WIN8", sql("v_slices", body="""
SELECT dataset_id, z, CAST(rank AS INTEGER) AS rank, block_id, status, round(quality, 6) AS quality, passed FROM
 (SELECT *, CASE WHEN status <> 'ok' THEN 5 ELSE max_sev END AS rank, row_number() OVER (PARTITION BY dataset_id, z ORDER BY CASE WHEN status <> 'ok' THEN 5 ELSE max_sev END DESC, block_id) AS rn FROM v_slices) WHERE rn = 1"""))
def worst_per_z(spark, sf):
    return W.worst_per_z(slices(spark, sf)).select("dataset_id", "z", "rank", "block_id", "status", F.round("quality", 6).alias("quality"), "passed")


@query("grade_bands", "WIN14", sql("v_blocks", body="SELECT z_start, z_end, max(grade) AS grade FROM v_blocks GROUP BY z_start, z_end"))
def grade_bands(spark, sf):
    return W.grade_bands(T.blocks(spark, sf))


_GAL = {"one": "SELECT dataset_id, failure_type, z, min(block_id) AS block_id FROM v_findings WHERE sev >= 3 GROUP BY dataset_id, failure_type, z",
        "rk": "SELECT *, row_number() OVER (PARTITION BY dataset_id, failure_type ORDER BY z) AS shot, count(*) OVER (PARTITION BY dataset_id, failure_type) AS n_sections FROM one"}


@query("gallery", "WIN15", sql("v_findings", ctes=_GAL, body="SELECT dataset_id, failure_type, CAST(shot AS INTEGER) AS shot, z, block_id, n_sections FROM rk WHERE shot <= 4"))
def gallery(spark, sf):
    return W.gallery(S.findings(rolled(spark, sf))).select("dataset_id", "failure_type", "shot", "z", "block_id", "n_sections")


@query("type_examples", "WIN16")
def type_examples(spark, sf):
    f = S.findings(rolled(spark, sf)).withColumn("fleet", F.lit("all"))
    one = f.where("sev >= 3").groupBy("failure_type", "dataset_id", "z").agg(F.min("block_id").alias("block_id"))
    n = one.groupBy("failure_type").agg(F.count(F.lit(1)).alias("n_sections"))
    w = W.Window.partitionBy("failure_type").orderBy("dataset_id", "z")
    top = one.withColumn("shot", F.row_number().over(w)).where(F.col("shot") <= F.lit(n.count())).join(n, "failure_type")  # as many candidates as there are types
    return W.example_per_type(top)


@query("passed_everywhere", "AGG18", sql("v_slices", body="SELECT dataset_id, z, bool_and(passed) AS passed_all, count(*) AS n_tiles FROM v_slices GROUP BY dataset_id, z"))
def passed_everywhere(spark, sf):
    return W.passed_everywhere(slices(spark, sf))


@query("crop_volumes", "WIN19", sql("v_patches", ctes={
    "c": "SELECT DISTINCT y0, x0, CAST(floor(z0 / 4) AS BIGINT) AS z FROM v_patches"}, body="""
SELECT y0, x0, min(z) AS run_start, max(z) + 1 AS run_end, count(*) AS run_length FROM (SELECT *, z - row_number() OVER (PARTITION BY y0, x0 ORDER BY z) AS g FROM c) GROUP BY y0, x0, g HAVING count(*) >= 2"""))
def crop_volumes(spark, sf):
    p = T.patches(spark, sf).select("y0", "x0", F.floor(F.col("z0") / 4).cast("long").alias("z"))
    return W.volumes_from_crops(p, 2)


@query("qc_map_thinning", "SMP13", sql("v_slices", ctes={
    "r": "SELECT block_id, z, passed, row_number() OVER (PARTITION BY passed ORDER BY z, block_id) - 1 AS rn FROM v_slices WHERE status = 'ok'",
    "c": "SELECT greatest(1, CAST(floor((SELECT count(*) FROM r WHERE passed) / greatest(1, 4000 - (SELECT count(*) FROM r WHERE NOT passed))) AS BIGINT)) AS step"}, body="""
SELECT block_id, z, passed FROM r, c WHERE NOT passed OR rn % step = 0"""))
def qc_map_thinning(spark, sf):
    from ..operators.sampling import thin_clean

    return thin_clean(slices(spark, sf).where("status = 'ok'"), 4000).select("block_id", "z", "passed")
