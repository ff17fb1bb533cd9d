"""Serial-section checks over thumbnails: correlations, links, registration, walks."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import serial_checks as Z
from ..operators import slice_checks as S
from ..operators.ordered import range_rows
from ..session import cut_lineage
from ..sources import tables as T
from .registry import query, sql


def chain(spark, sf):
    """Thumbnails as a reference chain: vectors whose number ends in 9 are unreadable."""
    t = T.thumbs(spark, sf)
    return t.withColumn("status", F.when(F.col("vec_id") % 10 == 9, "missing").otherwise("ok")).withColumn("in_chain", F.col("status") == "ok")


def native_pairs(spark, sf):
    """Zero-shift correlations with the previous and second previous chain section, all in the JVM."""
    rows = S.with_references(S.chain_positions(chain(spark, sf).select("block_id", "z", "status", "in_chain", F.col("px").cast("array<double>").alias("px"))), ["px"])
    for b in (1, 2):
        rows = rows.withColumn(f"p{b}_ncc", F.when((F.col("status") == "ok") & F.col(f"p{b}_px").isNotNull(), Z.native_ncc(F.col("px"), F.col(f"p{b}_px"))))
        rows = rows.withColumn(f"p{b}_gap", F.when(F.col(f"p{b}_ncc").isNotNull(), F.col("z") - F.col(f"p{b}_z"))).withColumn(f"p{b}_dy", F.lit(0.0)).withColumn(f"p{b}_dx", F.lit(0.0))
    return rows.drop("px", "p1_px", "p2_px")


_NCC = {
    "t": "SELECT block_id, z, vec_id % 10 <> 9 AS ok, list_transform(px, lambda v: CAST(v AS DOUBLE)) AS px FROM v_thumbs",
    "c": "SELECT block_id, z, ok, list_transform(px, lambda v: v - list_avg(px)) AS px FROM t",
    "k": "SELECT *, coalesce(sum(CAST(ok AS INTEGER)) OVER (PARTITION BY block_id ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM c",
    "p": """SELECT a.block_id, a.z, a.k, a.ok, b.z AS p1_z, d.z AS p2_z, CASE WHEN a.ok THEN list_dot_product(a.px, b.px) / (sqrt(list_dot_product(a.px, a.px) * list_dot_product(b.px, b.px)) + 1e-8) END AS p1_ncc,
       CASE WHEN a.ok THEN list_dot_product(a.px, d.px) / (sqrt(list_dot_product(a.px, a.px) * list_dot_product(d.px, d.px)) + 1e-8) END AS p2_ncc
       FROM k a LEFT JOIN k b ON b.block_id = a.block_id AND b.ok AND b.k = a.k - 1 LEFT JOIN k d ON d.block_id = a.block_id AND d.ok AND d.k = a.k - 2""",
}


@query("pair_ncc", "KRN1 native, JN2", sql("v_thumbs", ctes=_NCC, body="SELECT block_id, z, CASE WHEN ok THEN p1_z END AS ref_z, round(p1_ncc, 6) AS ncc1, round(p2_ncc, 6) AS ncc2 FROM p"))
def pair_ncc(spark, sf):
    p = native_pairs(spark, sf)
    return p.select("block_id", "z", F.when(F.col("status") == "ok", F.col("p1_z")).alias("ref_z"), F.round("p1_ncc", 6).alias("ncc1"), F.round("p2_ncc", 6).alias("ncc2"))


_BASE = {**_NCC,
         "m": """SELECT block_id, coalesce(quantile_cont(p1_ncc, 0.5) FILTER (z - p1_z = 1), quantile_cont(p1_ncc, 0.5)) AS m1, coalesce(quantile_cont(p2_ncc, 0.5) FILTER (z - p2_z = 2), quantile_cont(p2_ncc, 0.5)) AS m2, count(*) AS n_chain FROM p WHERE ok GROUP BY block_id""",
         "ab": "SELECT *, CASE WHEN m1 IS NULL THEN 0.5e0 ELSE greatest(0.05e0, least(0.999e0, m1)) END AS a FROM m",
         "e": "SELECT *, CASE WHEN m2 IS NULL OR m2 <= 0 THEN a * a * a ELSE greatest(0.02e0, least(a, m2)) * (greatest(0.02e0, least(a, m2)) / a) END AS e3 FROM ab"}


@query("expected_ncc", "AGG6", sql("v_thumbs", ctes=_BASE, body="SELECT block_id, n_chain, round(m1, 6) AS m1, round(m2, 6) AS m2, round(a, 6) AS expected_1, round(e3, 6) AS expected_3, m1 < 0.15 AND n_chain >= 4 AS uncorrelated FROM e"))
def expected_ncc(spark, sf):
    b = Z.block_baselines(cut_lineage(native_pairs(spark, sf)))
    return b.select("block_id", "n_chain", F.round("m1", 6).alias("m1"), F.round("m2", 6).alias("m2"), F.round(Z.expected_ncc(F.lit(1)), 6).alias("expected_1"), F.round(Z.expected_ncc(F.lit(3)), 6).alias("expected_3"),
                    ((F.col("m1") < 0.15) & (F.col("n_chain") >= 4)).alias("uncorrelated"))


_LINK = {**_NCC, "ch": "SELECT * FROM p WHERE ok",
         "l": """SELECT *, lead(p1_ncc) OVER w AS n1_p1, lead(p2_ncc) OVER w AS n1_p2, lead(p1_ncc, 2) OVER w AS n2_p1, lead(p2_ncc, 2) OVER w AS n2_p2 FROM ch WINDOW w AS (PARTITION BY block_id ORDER BY z)""",
         "r": """SELECT *, CASE WHEN p1_ncc IS NULL THEN NULL WHEN z - p1_z = 1 AND p1_ncc >= 0.985e0 THEN 'duplicate' WHEN n1_p2 - p1_ncc > 0.03e0 AND n2_p2 - n2_p1 > 0.03e0 THEN 'swap'
             WHEN n1_p1 IS NOT NULL AND n1_p2 IS NOT NULL AND n1_p2 - greatest(p1_ncc, n1_p1) > 0.03e0 THEN 'suspect' END AS reason FROM l"""}


@query("zorder_links", "CHK14, WIN7", sql("v_thumbs", ctes=_LINK, body="""
SELECT block_id, z, reason, round(CASE reason WHEN 'duplicate' THEN 0e0 WHEN 'swap' THEN 1e0 - least(1e0, least(n1_p2 - p1_ncc, n2_p2 - n2_p1) / 0.1e0) WHEN 'suspect' THEN 1e0 - least(1e0, (n1_p2 - greatest(p1_ncc, n1_p1)) / 0.15e0) END, 5) AS score FROM r"""))
def zorder_links(spark, sf):
    l = Z.z_order_links(cut_lineage(native_pairs(spark, sf).where("in_chain")))
    return l.select("block_id", "z", F.col("z_reason").alias("reason"), F.round("z_score", 5).alias("score"))


_JUMP = {**_BASE,
         "x": """SELECT p.block_id, p.z, p.ok, p.k, p.p1_z, p.p2_z, CASE WHEN z - p1_z <= 1 OR m2 IS NULL OR m2 <= 0 THEN a ** (z - p1_z) ELSE greatest(0.02e0, least(a, m2)) * (greatest(0.02e0, least(a, m2)) / a) ** (z - p1_z - 2) END AS e1, p1_ncc,
             CASE WHEN z - p2_z <= 1 OR m2 IS NULL OR m2 <= 0 THEN a ** (z - p2_z) ELSE greatest(0.02e0, least(a, m2)) * (greatest(0.02e0, least(a, m2)) / a) ** (z - p2_z - 2) END AS e2, p2_ncc, row_number() OVER (PARTITION BY p.block_id ORDER BY p.z) AS rn,
             m1 < 0.15 AND n_chain >= 4 AS un FROM p JOIN e ON e.block_id = p.block_id""",
         "y": "SELECT *, greatest(0e0, least(1e0, p1_ncc / e1)) AS s1, greatest(0e0, least(1e0, p2_ncc / e2)) AS s2 FROM x",
         # o1 / o2: previous and second previous chain section flagged
         "wk": """SELECT block_id, rn, z, ok, un, k, false AS o1, false AS o2, CASE WHEN ok AND NOT un THEN 1e0 END AS score FROM y WHERE rn = 1
             UNION ALL SELECT y.block_id, y.rn, y.z, y.ok, y.un, y.k, t.o1, t.o2, CASE WHEN NOT y.ok OR y.un THEN NULL WHEN y.k = 0 THEN 1e0 WHEN NOT t.o1 THEN y.s1 WHEN y.k >= 2 AND NOT t.o2 THEN y.s2 END
             FROM wk w JOIN y ON y.block_id = w.block_id AND y.rn = w.rn + 1, LATERAL (SELECT CASE WHEN w.ok THEN coalesce(w.k > 0 AND w.score < 0.3e0, false) ELSE w.o1 END AS o1, CASE WHEN w.ok THEN w.o1 ELSE w.o2 END AS o2) t"""}


@query("slice_jump", "CHK11, WIN6, AGG6", sql("v_thumbs", ctes=_JUMP, body="SELECT block_id, z, round(score, 5) AS slice_jump FROM wk"))
def slice_jump(spark, sf):
    p = cut_lineage(native_pairs(spark, sf))
    j = cut_lineage(Z.with_baselines(p, Z.block_baselines(p)))
    span = int(j.agg(F.max("z")).first()[0]) + 1
    e = {b: Z.expected_ncc(F.col(f"p{b}_gap")) for b in (1, 2)}
    score = {b: S.clip01(F.col(f"p{b}_ncc") / e[b]) for b in (1, 2)}
    live = ~F.col("uncorrelated")
    w = Z.two_back_walk(j, ["block_id"], "z", span, hit1=live & (score[1] < 0.3), hit2=live & (score[2] < 0.3))
    val = F.when((F.col("status") == "ok") & live, F.when(F.col("pick") == -1, F.lit(1.0)).when(F.col("pick") == 1, score[1]).when(F.col("pick") == 2, score[2]))
    return w.select("block_id", "z", F.round(val, 5).alias("slice_jump"))


def tile_planes(spark, sf, side: int = 64):
    """Label planes as dense image tiles of side x side pixels: block = tile, z = section."""
    p = T.pixels(spark, sf)
    ty, tx = F.floor(F.col("y") / side), F.floor(F.col("x") / side)
    cell = p.select(F.concat_ws("_", F.lit("t"), ty, tx).alias("block_id"), "z", ((F.col("y") % side) * side + F.col("x") % side).alias("k"), (F.col("id") / 8.0).alias("v"))
    grid = range_rows(cell.select("block_id", "z").distinct(), F.lit(0), F.lit(side * side), 1, "k")
    full = grid.join(cell, ["block_id", "z", "k"], "left").fillna(0.0, ["v"])
    px = F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda e: e["v"])  # exactly side * side pixels
    return full.groupBy("block_id", "z").agg(px.alias("px")).select("block_id", "z", F.lit(side).alias("h"), F.lit(side).alias("w"), "px", F.lit("ok").alias("status"), F.lit(True).alias("in_chain"))


def registered(spark, sf):
    planes = tile_planes(spark, sf)
    hp = Z.prepare_planes(planes, ["block_id", "z", "status", "in_chain"], 2.0)
    pairs = cut_lineage(Z.register_pairs(cut_lineage(hp)))
    return cut_lineage(Z.with_baselines(pairs, Z.block_baselines(pairs)))


@query("pair_shift", "KRN1")
def pair_shift(spark, sf):
    return registered(spark, sf).select("block_id", "z", "p1_ref_z", "p1_gap", "p1_dy", "p1_dx", "p1_peak", "p1_ncc0", "p1_ncc", "p1_n_fine", "p1_strain")


@query("serial_scores", "CHK11-16, WIN6, KRN1")
def serial_scores(spark, sf):
    s = Z.serial_scores(registered(spark, sf).withColumn("uncorrelated", F.lit(False)), 8, 1.0, 64.0)
    names = ["slice_jump", "local_misalignment", "global_misalignment", "local_deformation", "section_deformation"]
    return s.select("block_id", "z", *names, *[f"{n}_note" for n in names], "z_order_error", "z_reason")


@query("best_matches", "JN3, CHK14 misplaced")
def best_matches(spark, sf):
    hp = cut_lineage(Z.prepare_planes(chain(spark, sf), ["block_id", "z", "status", "in_chain"], 1.0))
    c = cut_lineage(S.chain_positions(hp).where("in_chain"))
    sus = Z.z_order_links(cut_lineage(native_pairs(spark, sf).where("in_chain"))).where("z_reason = 'suspect'").select("block_id", "z")
    return Z.best_matches(c.join(sus, ["block_id", "z"], "left_semi"), c)
