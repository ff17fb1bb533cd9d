"""Queries that write files made from the supplied tables and read them back, and the path from raw planes to statistics."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import delivery as D
from ..operators import stats as X
from ..session import ensure_checkpoint_dir
from ..sources import sinks as K
from ..sources import snapshots as N
from ..sources import tables as T
from .registry import query, sql
from .section_quality import REPORT_CTES, _report
from .section_runs import slices
from .serial import tile_planes


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("persist_one_block", "SNK1", sql("v_slices", ctes={"b": REPORT_CTES["b"]}, body="""
SELECT dataset_id, count(*) AS n_blocks, CAST(sum(n_passed + CASE WHEN block_id = (SELECT min(block_id) FROM b) THEN 1000 ELSE 0 END) AS BIGINT) AS n_passed FROM b GROUP BY dataset_id"""))
def persist_one_block(spark, sf):
    root, rows = _folder(spark, "results"), _report(spark, sf).select(F.lit(1).alias("run_id"), "dataset_id", "block_id", "n_passed")
    K.persist_run({"qc_blocks": rows}, root)
    first = rows.agg(F.min("block_id").alias("block_id"))
    again = rows.join(F.broadcast(first), "block_id").select("run_id", "dataset_id", "block_id", (F.col("n_passed") + 1000).alias("n_passed"))  # one row
    K.persist_run({"qc_blocks": again}, root)  # the other blocks of the run stay
    return spark.read.parquet(f"{root}/qc_blocks").groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("n_passed").alias("n_passed"))


@query("persist_snapshots", "SNK1", sql("v_slices", ctes={"b": REPORT_CTES["b"], "f": "SELECT min(block_id) AS first, max(block_id) AS last FROM b"}, body="""
SELECT v.version, dataset_id, count(*) AS n_blocks, CAST(sum(n_passed + CASE WHEN v.version >= 2 AND block_id = first THEN 1000 ELSE 0 END + CASE WHEN v.version >= 3 AND block_id = last THEN 5000 ELSE 0 END) AS BIGINT) AS n_passed
FROM b, f, (VALUES (1), (2), (3), (4)) v(version) GROUP BY v.version, dataset_id"""))
def persist_snapshots(spark, sf):
    """All blocks, then one block anew, then another one by a writer that has only seen version 1, then all in one commit; every version stays readable."""
    root, rows = _folder(spark, "snapshots"), _report(spark, sf).select(F.lit(1).alias("run_id"), "dataset_id", "block_id", "n_passed")
    N.commit(rows, root)
    rows = N.snapshot(spark, root, 1)
    ends = rows.agg(F.min("block_id").alias("first"), F.max("block_id").alias("last")).first()
    for block, more in ((ends["first"], 1000), (ends["last"], 5000)):
        N.commit(rows.where(F.col("block_id") == block).withColumn("n_passed", F.col("n_passed") + more), root, parent=1)
    N.compact(spark, root)
    out = None
    for v in (1, 2, 3, 4):
        part = N.snapshot(spark, root, v).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("n_passed").alias("n_passed")).withColumn("version", F.lit(v))
        out = part if out is None else out.unionByName(part)
    return out


@query("export_written", "SNK2", sql("v_slices", body="SELECT block_id, count(*) AS n_sections, CAST(sum(z) AS BIGINT) AS z_sum, CAST(sum(length(concat(block_id, ':', z))) AS BIGINT) AS n_bytes FROM v_slices GROUP BY block_id"))
def export_written(spark, sf):
    s, root = slices(spark, sf).select("block_id", "z"), _folder(spark, "export")
    z0 = (F.floor(F.col("z") / 16) * 16).cast("long")
    planned = s.select("block_id", z0.alias("z0"), (z0 + 16).alias("z1"), F.lit(128).cast("long").alias("bytes")).distinct()
    payload = s.withColumn("payload", F.encode(F.concat_ws(":", "block_id", "z"), "UTF-8"))
    D.write_export(planned.where("z0 % 32 = 0"), payload, root)
    D.write_export(planned, payload, root)  # resumes with the other half
    return D.read_export(spark, root).groupBy("block_id").agg(F.count(F.lit(1)).alias("n_sections"), F.sum("z").alias("z_sum"), F.sum(F.octet_length("payload")).alias("n_bytes"))


@query("lineage_append", "SNK9", sql("v_runs", body="SELECT dataset_id, status AS kind, count(*) AS n, CAST(sum(n_slices) AS BIGINT) AS n_slices FROM v_runs GROUP BY dataset_id, status"))
def lineage_append(spark, sf):
    root, r = _folder(spark, "lineage"), T.runs(spark, sf).select("dataset_id", F.col("status").alias("kind"), "n_slices")
    K.append_lineage(r.where("kind = 'done'"), root, "serve_log")
    K.append_lineage(r.where("kind <> 'done'"), root, "serve_log")
    return spark.read.parquet(f"{root}/serve_log").groupBy("dataset_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("n_slices").alias("n_slices"))


@query("pack_written", "SNK4", sql("v_patches", body="""
SELECT CASE WHEN z0 % 2 = 0 THEN 'raw' ELSE 'membrane' END AS task, partition_name AS partition, count(*) AS n, CAST(sum(z1 - z0) AS BIGINT) AS z_total, CAST(sum(x0) AS BIGINT) AS x_sum FROM v_patches GROUP BY 1, 2"""))
def pack_written(spark, sf):
    root = _folder(spark, "pack")
    p = T.patches(spark, sf).withColumn("task", F.when(F.col("z0") % 2 == 0, "raw").otherwise("membrane")).withColumn("level", F.lit("patch")).withColumnRenamed("partition_name", "partition")
    K.write_pack(p, root)
    back = spark.read.option("header", "true").csv(f"{root}/index")
    return back.groupBy("task", "partition").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("z1").cast("long") - F.col("z0").cast("long")).alias("z_total"), F.sum(F.col("x0").cast("long")).alias("x_sum"))


_TILES = {"t": "SELECT DISTINCT z, y // 64 AS ty, x // 64 AS tx FROM v_pixels",
          "g": "SELECT t.*, CAST(k AS BIGINT) AS k FROM t, (SELECT unnest(range(0, 4096)) AS k)",
          "v": "SELECT g.z, g.ty, g.tx, coalesce(p.id, 0) * 16 AS v FROM g LEFT JOIN v_pixels p ON p.z = g.z AND p.y = g.ty * 64 + g.k // 64 AND p.x = g.tx * 64 + g.k % 64",
          "m": "SELECT z, ty, tx, max(n) / 4096e0 AS frac_mode FROM (SELECT z, ty, tx, v, count(*) AS n FROM v GROUP BY z, ty, tx, v) GROUP BY z, ty, tx"}


@query("plane_statistics", "SRC-to-AGG1, AGG2", sql("v_pixels", ctes=_TILES, body="""
SELECT concat('t_', v.ty, '_', v.tx) AS block_id, v.z, CAST(4096 AS BIGINT) AS bytes_read, round(avg(v / 255e0), 8) AS mean, round(stddev_pop(v / 255e0), 8) AS std, round(min(v) / 255e0, 8) AS min, round(max(v) / 255e0, 8) AS max,
 round(quantile_cont(v / 255e0, 0.5), 8) AS p50, round(quantile_cont(v / 255e0, 0.99), 8) AS p99, round(avg(CASE WHEN v <= 0 THEN 1e0 ELSE 0e0 END), 8) AS frac_low_sat, round(any_value(frac_mode), 8) AS frac_mode
FROM v JOIN m ON m.z = v.z AND m.ty = v.ty AND m.tx = v.tx GROUP BY v.ty, v.tx, v.z"""))
def plane_statistics(spark, sf):
    """Eight-bit planes as bytes, decoded and measured."""
    t = tile_planes(spark, sf)
    grey = F.unhex(F.array_join(F.transform("px", lambda v: F.lpad(F.hex((v * 128).cast("long")), 2, "0")), ""))
    raw = t.select(F.col("block_id").alias("dataset_id"), "z", "h", "w", F.lit("uint8").alias("dtype"), grey.alias("payload"), "status")
    s = X.ingest_sections(raw, None, None)
    return s.select("block_id", "z", "bytes_read", *[F.round(c, 8).alias(c) for c in ("mean", "std", "min", "max", "p50", "p99", "frac_low_sat", "frac_mode")])


@query("contamination_planted", "CHK10", sql("v_pixels", body="""
SELECT DISTINCT concat('t_', y // 64, '_', x // 64) AS block_id, z, (y // 64 + x // 64 + z) % 3 = 0 AS dirty, CASE WHEN (y // 64 + x // 64 + z) % 3 = 0 THEN 1 ELSE 0 END AS n_blobs,
  CASE WHEN (y // 64 + x // 64 + z) % 3 = 0 THEN 'found' ELSE 'no_blob' END AS note FROM v_pixels"""))
def contamination_planted(spark, sf):
    """Tissue-like planes made from the label tiles; every third one gets a bright, even spot of 16 x 20 pixels."""
    t = tile_planes(spark, sf)
    part = F.split("block_id", "_")
    spot = (part[1].cast("long") + part[2].cast("long") + F.col("z")) % 3 == 0

    def grey(v, i):
        y, x = F.floor(i / 64), i % 64
        inside = (y >= 10) & (y < 26) & (x >= 20) & (x < 40)
        return F.when(spot & inside, F.lit(1.0)).otherwise(F.lit(0.45) + ((x * 7 + y * 13 + (v * 8).cast("long") * 31 + (x * y) % 11 * 5) % 17) / 170.0)

    s = X.texture_signals(t.withColumn("px", F.transform("px", grey)), ["block_id", "z"], 64)
    return s.select("block_id", "z", (F.col("contamination") < 1).alias("dirty"), "n_blobs", F.coalesce("note", F.lit("found")).alias("note"))
