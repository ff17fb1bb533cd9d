"""Feature space, similar sections, precision at k, slice map."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import similar as N
from ..operators.slice_checks import STAT_CHECKS
from ..sources import tables as T
from .registry import query, sql
from .section_quality import rolled

STATS = ["mean", "std", "frac_mode", "sharpness", "frac_fill", "fill_elongation"]
SCORES = list(STAT_CHECKS)


def space(spark, sf):
    ok = rolled(spark, sf).where("status = 'ok'")
    ok = ok.withColumn("fill_elongation", F.when(F.col("frac_fill") > 0, F.col("fill_elongation")))
    return N.robust_space(ok, STATS, SCORES)


_SQL_STAT = {"mean": "s.mean", "std": "s.std", "frac_mode": "v.frac_mode", "sharpness": "log10(greatest(v.sharpness, 0e0) + 1e-6)", "frac_fill": "v.frac_fill",
             "fill_elongation": "CASE WHEN v.frac_fill > 0 THEN log10(greatest(v.fill_elongation, 0e0) + 1e-6) ELSE 0e0 END"}
_FEAT = {
    "f": "SELECT s.dataset_id, s.block_id, s.z, s.quality, " + ", ".join(f"{e} AS f_{k}" for k, e in _SQL_STAT.items()) + ", " + ", ".join(f"coalesce({c}, 1e0) AS c_{c}" for c in SCORES)
         + " FROM v_slices s JOIN v_sections v ON v.block_id = s.block_id AND v.z = s.z JOIN v_scored c ON c.block_id = s.block_id AND c.z = s.z WHERE s.status = 'ok'",
    "p": "SELECT " + ", ".join(f"quantile_cont(f_{k}, 0.5) AS m_{k}, quantile_cont(f_{k}, 0.75) - quantile_cont(f_{k}, 0.25) AS i_{k}, stddev_pop(f_{k}) AS d_{k}" for k in STATS) + ", " + ", ".join(f"stddev_pop(c_{c}) AS d_{c}" for c in SCORES) + " FROM f",
    "g": "SELECT dataset_id, block_id, z, quality, " + ", ".join(f"greatest(-6e0, least(6e0, (f_{k} - m_{k}) / CASE WHEN i_{k} <> 0 THEN i_{k} WHEN d_{k} <> 0 THEN d_{k} ELSE 1e0 END)) AS g_{k}" for k in STATS) + ", "
         + ", ".join(f"c_{c}, d_{c}" for c in SCORES) + " FROM f, p",
    "kept": "SELECT " + " + ".join(f"CASE WHEN stddev_pop(g_{k}) > 1e-9 THEN 1 ELSE 0 END" for k in STATS) + " AS ns, " + " + ".join(f"CASE WHEN max(d_{c}) > 1e-9 THEN 1 ELSE 0 END" for c in SCORES) + " AS nc FROM g",
}


@query("robust_features", "ALG3", sql("v_slices", "v_scored", ctes=_FEAT, body="SELECT block_id, z, " + ", ".join(f"round(g_{k}, 6) AS {k}" for k in STATS) + " FROM g"))
def robust_features(spark, sf):
    s, names = space(spark, sf)
    n = sum(1 for x in names if x in STATS)
    at = {k: i for i, k in enumerate(names)}
    val = {k: F.round(F.col("fv")[at[k]] * F.sqrt(F.lit(float(n))), 6) if k in at else F.lit(0.0) for k in STATS}
    return s.select("block_id", "z", *[val[k].alias(k) for k in STATS])


_DIST = " + ".join([f"(g.g_{k} - q.g_{k}) * (g.g_{k} - q.g_{k}) / ns" for k in STATS] + [f"CASE WHEN g.d_{c} > 1e-9 THEN (g.c_{c} - q.c_{c}) * (g.c_{c} - q.c_{c}) * 9e0 / nc ELSE 0e0 END" for c in SCORES])


@query("knn_similar", "JN11, SMP12, ALG3", sql("v_slices", "v_scored", ctes={**_FEAT, "q": "SELECT * FROM g ORDER BY quality, block_id, z LIMIT 1"}, body=f"""
SELECT g.dataset_id, g.block_id, g.z, round(sqrt({_DIST}), 6) AS distance FROM g, q, kept WHERE NOT (g.dataset_id = q.dataset_id AND g.z = q.z) ORDER BY sqrt({_DIST}), g.dataset_id, g.z, g.block_id LIMIT 25"""))
def knn_similar(spark, sf):
    s, _ = space(spark, sf)
    s = s.select("dataset_id", "block_id", "z", "quality", "fv")
    target = s.orderBy("quality", "block_id", "z").limit(1).select("fv", "dataset_id", "z")
    same = (F.col("dataset_id") == F.col("q_dataset_id")) & (F.col("z") == F.col("q_z"))
    return N.find_similar(s, target, 25, ["dataset_id", "z", "block_id"], same).select("dataset_id", "block_id", "z", F.round("distance", 6).alias("distance"))


def _vectors(spark, sf):
    e = T.load(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("pid"), F.col("vec_id").cast("string").alias("grp"), F.col("embedding").cast("array<double>").alias("fv"), F.col("label").alias("class"))


_KNN = {"e": "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings",
        "d": "SELECT a.vec_id AS qid, a.label AS ql, b.vec_id AS pid, b.label AS pl, list_distance(a.v, b.v) AS distance FROM e a JOIN e b ON a.vec_id <> b.vec_id",
        "r": "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, pid) AS rank FROM d"}


@query("knn_all", "JN11, SMP12", sql(ctes=_KNN, body="SELECT qid, pid, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"))
def knn_all(spark, sf):
    v = _vectors(spark, sf)
    n = N.knn_join(v, v.withColumnRenamed("pid", "qid"), 10)
    return n.select("qid", "pid", F.round("distance", 6).alias("distance"), "rank")


@query("precision_at_k", "AGG32, ALG5", sql(ctes={**_KNN, "c": "SELECT label, count(*) AS n, (SELECT count(*) FROM e) AS t FROM e GROUP BY label",
    "h": "SELECT qid, ql, avg(CASE WHEN pl = ql THEN 1e0 ELSE 0e0 END) AS rate FROM r JOIN c ON c.label = r.ql WHERE rank <= least(10, n - 1) GROUP BY qid, ql"}, body="""
SELECT ql AS class, count(*) AS n_queries, round(avg(rate), 6) AS precision, round(max(n) / CAST(max(t) - 1 AS DOUBLE), 6) AS random, round(avg(rate) / (max(n) / CAST(max(t) - 1 AS DOUBLE)), 6) AS lift FROM h JOIN c ON c.label = h.ql GROUP BY ql"""))
def precision_at_k(spark, sf):
    v = _vectors(spark, sf)
    n = N.knn_join(v, v.withColumnRenamed("pid", "qid"), 10)
    p = N.precision_at_k(n, v.select(F.col("pid").alias("id"), "class", "grp"), 10)
    return p.select("class", "n_queries", *[F.round(c, 6).alias(c) for c in ("precision", "random", "lift")])


@query("slice_map", "ALG4")
def slice_map(spark, sf):
    s, names = space(spark, sf)
    pts, _ = N.slice_map(s, names, ["block_id", "z", "passed"])
    return pts


@query("slice_map_axes", "ALG4 variance", sql("v_slices", "v_scored", ctes={**_FEAT,
    "w": "SELECT block_id, z, " + ", ".join(f"g_{k} / sqrt(ns) AS {k}" for k in STATS) + ", " + ", ".join(f"CASE WHEN d_{c} > 1e-9 THEN c_{c} * 3e0 / sqrt(nc) ELSE 0e0 END AS {c}" for c in SCORES) + " FROM g, kept"},
    body="SELECT count(*) AS n, round(" + " + ".join(f"var_pop({k})" for k in STATS + SCORES) + ", 6) AS total_variance FROM w"))
def slice_map_axes(spark, sf):
    s, names = space(spark, sf)
    v = sum(F.var_pop(F.col("fv")[i]) for i in range(len(names)))
    return s.agg(F.count(F.lit(1)).alias("n"), F.round(v, 6).alias("total_variance"))
