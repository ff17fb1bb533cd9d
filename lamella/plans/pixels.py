"""Pixel planes: components, changed regions, downsampling, section statistics, crops and masks."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotation as A
from ..operators import components as C
from ..operators import planes as P
from ..operators import stats as X
from ..operators import windows as W
from ..sources import tables as T
from .annotation import provenance
from .registry import query, sql

H = 256


def _reach(src: str) -> dict[str, str]:
    """Pixel -> smallest reachable pixel code of the same section, 8-connected."""
    code = "(z * 1048576 + y * 1024 + x)"
    return {"pp": f"SELECT {code} AS c, z, y, x FROM {src}",
            "nb": "SELECT a.c AS a, b.c AS b FROM pp a, (VALUES (-1), (0), (1)) dy(i), (VALUES (-1), (0), (1)) dx(j) JOIN pp b ON true WHERE b.z = a.z AND b.y = a.y + i AND b.x = a.x + j AND a.c <> b.c",
            "reach": "SELECT c AS p, c AS root FROM pp UNION SELECT nb.b, reach.root FROM reach JOIN nb ON nb.a = reach.p WHERE reach.root < nb.b",
            "cc": "SELECT p, min(root) AS component FROM reach GROUP BY p",
            "lab": "SELECT pp.z, pp.y, pp.x, cc.component FROM pp JOIN cc ON cc.p = pp.c"}


_STATS = """SELECT z, component, count(*) AS size, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, var_samp(y) AS vy, var_samp(x) AS vx, covar_samp(y, x) AS cyx FROM lab GROUP BY z, component"""
# a pixel is fill when its label is in the upper half of the range
_FILL = {"fillpx": "SELECT * FROM v_pixels WHERE id >= 5", **_reach("fillpx"), "st": _STATS, "kp": "SELECT *, row_number() OVER (PARTITION BY z ORDER BY size DESC, component) AS rn FROM st WHERE size / 65536e0 >= 0.0001e0",
         "tt": "SELECT z, sum(size) / 65536e0 AS frac_fill, count(*) AS n_components FROM kp GROUP BY z"}


@query("fill_components", "ALG1, AGG3", sql("v_pixels", ctes=_FILL, body="""
SELECT kp.z, round(frac_fill, 8) AS frac_fill, n_components, round(size / 65536e0, 8) AS largest_frac, x0, y0, x1, y1,
 round(CASE WHEN size > 2 THEN sqrt(greatest((vy + vx) / 2 + sqrt(((vy - vx) / 2) ** 2 + cyx ** 2), 1e-9) / greatest((vy + vx) / 2 - sqrt(((vy - vx) / 2) ** 2 + cyx ** 2), 1e-9)) ELSE 1e0 END, 6) AS elongation,
 CAST(y0 = 0 AS INTEGER) + CAST(x0 = 0 AS INTEGER) + CAST(y1 = 256 AS INTEGER) + CAST(x1 = 256 AS INTEGER) AS border_sides FROM kp JOIN tt ON tt.z = kp.z WHERE rn = 1"""))
def fill_components(spark, sf):
    lab = C.label_components(T.pixels(spark, sf).where("id >= 5").select("z", "y", "x"), 8)
    s = C.fill_statistics(lab, H, H, 0.0001)
    return s.select("z", F.round("frac_fill", 8).alias("frac_fill"), "n_components", F.round("largest_frac", 8).alias("largest_frac"), "x0", "y0", "x1", "y1", F.round("elongation", 6).alias("elongation"), "border_sides")


@query("component_sizes", "ALG1", sql("v_pixels", ctes={k: v for k, v in _FILL.items() if k not in ("kp", "tt")}, body="SELECT z, size, count(*) AS n FROM st GROUP BY z, size"))
def component_sizes(spark, sf):
    lab = C.label_components(T.pixels(spark, sf).where("id >= 5").select("z", "y", "x"), 8)
    return C.component_stats(lab).groupBy("z", "size").agg(F.count(F.lit(1)).alias("n"))


_CH = {"chg": "SELECT * FROM v_provu WHERE before <> after", **_reach("chg"), "m": "SELECT lab.z, component, lab.y, lab.x, before, after, author FROM lab JOIN chg c ON c.z = lab.z AND c.y = lab.y AND c.x = lab.x",
       "g": "SELECT z, component, count(*) AS px, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, CAST(floor(avg(x)) AS BIGINT) AS cx, CAST(floor(avg(y)) AS BIGINT) AS cy FROM m GROUP BY z, component",
       "fb": "SELECT z, component, before AS from_id FROM (SELECT z, component, before, row_number() OVER (PARTITION BY z, component ORDER BY count(*) DESC, before) AS rn FROM m GROUP BY z, component, before) WHERE rn = 1",
       "fa": "SELECT z, component, after AS to_id FROM (SELECT z, component, after, row_number() OVER (PARTITION BY z, component ORDER BY count(*) DESC, after) AS rn FROM m GROUP BY z, component, after) WHERE rn = 1",
       "fw": "SELECT z, component, author FROM (SELECT z, component, author, row_number() OVER (PARTITION BY z, component ORDER BY count(*) DESC, author) AS rn FROM m WHERE author IS NOT NULL GROUP BY z, component, author) WHERE rn = 1",
       "rk": "SELECT *, row_number() OVER (PARTITION BY z ORDER BY px DESC, component) AS rank FROM g"}


@query("changed_regions", "ALG2, SET5", sql("v_provu", ctes=_CH, body="""
SELECT rk.z, CAST(rank AS INTEGER) AS rank, px, x0, y0, x1, y1, cx, cy, from_id, to_id, fw.author AS "by" FROM rk JOIN fb ON fb.z = rk.z AND fb.component = rk.component JOIN fa ON fa.z = rk.z AND fa.component = rk.component
LEFT JOIN fw ON fw.z = rk.z AND fw.component = rk.component WHERE rank <= 200"""))
def changed_regions(spark, sf):
    shown, _ = A.changed_regions(provenance(spark, sf), 200)
    return shown.select("z", "rank", "px", "x0", "y0", "x1", "y1", "cx", "cy", "from_id", "to_id", "by")


@query("changed_hidden", "ALG2", sql("v_provu", ctes={k: v for k, v in _CH.items() if k not in ("fb", "fa", "fw")}, body="""
SELECT z, count(*) AS n_total, count(*) FILTER (rank > 200) AS hidden, CAST(coalesce(sum(px) FILTER (rank > 200), 0) AS BIGINT) AS hidden_px FROM rk GROUP BY z"""))
def changed_hidden(spark, sf):
    return A.changed_regions(provenance(spark, sf), 200)[1]


@query("mask_component_windows", "SMP8")
def mask_component_windows(spark, sf):
    from ..operators.runs import allowed_windows
    from .patches_and_labels import _plane_blocks

    p = T.pixels(spark, sf).where("id <= 4").select("z", "y", "x")
    b = _plane_blocks(T.pixels(spark, sf))
    return W.mask_component_windows(C.label_components(p, 4), p, allowed_windows(b, None, 3), b, (3, 32, 32), 100, cell=128).select("block_id", "z0", "y0", "x0", "component_px", "mask_frac")


@query("downsample", "ALG21", sql("v_pixels", body="SELECT z, y // 5 AS y, x // 5 AS x, round(sum(id) / 25e0 / 255e0, 8) AS v FROM v_pixels WHERE y < 255 AND x < 255 GROUP BY 1, 2, 3"))
def downsample(spark, sf):
    return P.block_mean(T.pixels(spark, sf), 5, H, H, 255.0).select("z", "y", "x", F.round("v", 8).alias("v"))


# ----------------------------------------------------------------------------- 8 x 8 planes from the vectors

_PX = {"px": "SELECT block_id, z, CAST(v AS DOUBLE) AS v, (i - 1) // 8 AS y, (i - 1) % 8 AS x FROM (SELECT block_id, z, unnest(px) AS v, generate_subscripts(px, 1) AS i FROM v_thumbs)"}
_LAP = {**_PX, "lp": """SELECT *, coalesce(lag(v) OVER wx, v) + coalesce(lead(v) OVER wx, v) + coalesce(lag(v) OVER wy, v) + coalesce(lead(v) OVER wy, v) - 4 * v AS lap FROM px
  WINDOW wx AS (PARTITION BY block_id, z, y ORDER BY x), wy AS (PARTITION BY block_id, z, x ORDER BY y)""",
        "hb": "SELECT block_id, z, b, count(*) AS n FROM (SELECT block_id, z, least(CAST(floor(v * 256) AS INTEGER), 255) AS b FROM px WHERE v >= 0 AND v <= 1) GROUP BY block_id, z, b",
        "ht": "SELECT block_id, z, sum(n) AS t FROM hb GROUP BY block_id, z",
        "en": "SELECT hb.block_id, hb.z, max(n / t) AS frac_mode, -sum(n / t * log2(n / t)) AS entropy FROM hb JOIN ht ON ht.block_id = hb.block_id AND ht.z = hb.z GROUP BY hb.block_id, hb.z"}


@query("section_statistics", "AGG1, AGG2", sql("v_thumbs", ctes=_LAP, body="""
SELECT l.block_id, l.z, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, round(quantile_cont(v, 0.01), 6) AS p1, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.99), 6) AS p99,
 round(avg(CASE WHEN v <= 0 THEN 1e0 ELSE 0e0 END), 6) AS frac_low_sat, round(avg(CASE WHEN v >= 1 THEN 1e0 ELSE 0e0 END), 6) AS frac_high_sat, round(coalesce(any_value(frac_mode), 0), 6) AS frac_mode, round(coalesce(any_value(entropy), 0), 6) AS entropy_bits,
 round(var_pop(lap), 6) AS lapvar, round(var_pop(lap) / (var_pop(v) + 1e-6), 5) AS sharpness FROM lp l LEFT JOIN en ON en.block_id = l.block_id AND en.z = l.z GROUP BY l.block_id, l.z"""))
def section_statistics(spark, sf):
    s = X.array_statistics(T.thumbs(spark, sf), ["block_id", "z"])
    cols = ["mean", "std", "min", "max", "p1", "p50", "p99", "frac_low_sat", "frac_high_sat", "frac_mode", "entropy_bits", "lapvar"]
    return s.select("block_id", "z", *[F.round(c, 6).alias(c) for c in cols], F.round("sharpness", 5).alias("sharpness"))


_BAND = {**_PX, "pr": "SELECT block_id, z, 'row' AS axis, y AS i, avg(v) AS m FROM px GROUP BY block_id, z, y UNION ALL SELECT block_id, z, 'col', x, avg(v) FROM px GROUP BY block_id, z, x",
         "w": "SELECT *, coalesce(lag(m) OVER o, m) AS a, coalesce(lead(m) OVER o, m) AS b FROM pr WINDOW o AS (PARTITION BY block_id, z, axis ORDER BY i)",
         "bd": "SELECT block_id, z, max(abs(m - (a + b + m - greatest(a, b, m) - least(a, b, m)))) AS band FROM w GROUP BY block_id, z",
         "rp": "SELECT block_id, z, 2 * sqrt(regr_slope(v, y / 7e0 * 2 - 1) ** 2 + regr_slope(v, x / 7e0 * 2 - 1) ** 2) AS ramp FROM px GROUP BY block_id, z"}


@query("band_ramp", "CHK9 signals", sql("v_thumbs", ctes=_BAND, body="SELECT bd.block_id, bd.z, round(band, 6) AS band, round(ramp, 6) AS ramp FROM bd JOIN rp ON rp.block_id = bd.block_id AND rp.z = bd.z"))
def band_ramp(spark, sf):
    return X.texture_signals(T.thumbs(spark, sf), ["block_id", "z"], 8).select("block_id", "z", F.round("band", 6).alias("band"), F.round("ramp", 6).alias("ramp"))


@query("charging_scores", "CHK9")
def charging_scores(spark, sf):
    s = X.charging_scores(X.texture_signals(T.thumbs(spark, sf), ["block_id", "z"], 8))
    return s.select("block_id", "z", "charging_artifact", "limited_by", "band", "anisotropy", "ramp")


@query("contamination_scores", "CHK10")
def contamination_scores(spark, sf):
    return X.texture_signals(T.thumbs(spark, sf), ["block_id", "z"], 8).select("block_id", "z", "contamination", "blob_frac", "n_blobs", "note")


@query("saturation_boxes", "CHK5 box", sql("v_thumbs", ctes=_PX, body="SELECT block_id, z, count(*) AS n_px, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM px WHERE v <= 0.005 OR v >= 0.995 GROUP BY block_id, z"))
def saturation_boxes(spark, sf):
    return P.saturation_boxes(T.thumbs(spark, sf), ["block_id", "z"])


@query("seam_steps", "ALG19", sql("v_thumbs", ctes={**_PX, "pr": _BAND["pr"], "b": "SELECT *, CASE WHEN i >= 1 THEN (m + lag(m) OVER o) / 2 END AS band FROM pr WINDOW o AS (PARTITION BY block_id, z, axis ORDER BY i)",
    "d": "SELECT block_id, z, abs(band - lag(band, 2) OVER o) AS d FROM b WINDOW o AS (PARTITION BY block_id, z, axis ORDER BY i)"}, body="SELECT block_id, z, round(max(d) / 255, 9) AS seam FROM d GROUP BY block_id, z"))
def seam_steps(spark, sf):
    return P.seam_steps(T.thumbs(spark, sf), ["block_id", "z"], 2).select("block_id", "z", F.round("seam", 9).alias("seam"))


_DL = {**_PX, "hx": "SELECT *, (coalesce(lag(v) OVER w, v) + v + coalesce(lead(v) OVER w, v)) / 3 AS h1, (coalesce(lag(v * v) OVER w, v * v) + v * v + coalesce(lead(v * v) OVER w, v * v)) / 3 AS h2 FROM px WINDOW w AS (PARTITION BY block_id, z, y ORDER BY x)",
       "hy": "SELECT *, (coalesce(lag(h1) OVER w, h1) + h1 + coalesce(lead(h1) OVER w, h1)) / 3 AS mu, (coalesce(lag(h2) OVER w, h2) + h2 + coalesce(lead(h2) OVER w, h2)) / 3 AS m2 FROM hx WINDOW w AS (PARTITION BY block_id, z, x ORDER BY y)"}


@query("dark_lines", "ALG20", sql("v_thumbs", ctes=_DL, body="SELECT block_id, z, y, x, round((mu - v) / (sqrt(greatest(m2 - mu * mu, 0)) + 4), 6) AS score FROM hy"))
def dark_lines(spark, sf):
    d = P.dark_lines(T.thumbs(spark, sf), ["block_id", "z"], 3, 0.0)
    e = d.select("block_id", "z", F.posexplode("score").alias("i", "s"))
    return e.select("block_id", "z", F.floor(F.col("i") / 8).cast("long").alias("y"), (F.col("i") % 8).cast("long").alias("x"), F.round("s", 6).alias("score"))


# ----------------------------------------------------------------------------- crops and masks


def _crop_candidates(spark, sf):
    p = T.pixels(spark, sf)
    return P.crop_candidates(p, p.where("id = 8"), H, H, 16, 8)


@query("crop_candidates", "SMP15", sql("v_pixels", ctes={"z": "SELECT DISTINCT z FROM v_pixels", "g": "SELECT z, y0, unnest(range(0, 241, 8)) AS x0 FROM (SELECT z, unnest(range(0, 241, 8)) AS y0 FROM z)", "bad": "SELECT z, y, x FROM v_pixels WHERE id = 8"}, body="""
SELECT g.z, y0, x0, count(b.z) AS n_bad, y0 % 16 = 0 AND x0 % 16 = 0 AS aligned FROM g LEFT JOIN bad b ON b.z = g.z AND b.y >= y0 AND b.y < y0 + 16 AND b.x >= x0 AND b.x < x0 + 16 GROUP BY g.z, y0, x0"""))
def crop_candidates(spark, sf):
    return _crop_candidates(spark, sf).select("z", "y0", "x0", "n_bad", "aligned")


@query("crop_packing", "SMP15 greedy")
def crop_packing(spark, sf):
    return P.pack_crops(_crop_candidates(spark, sf), 16)


@query("crop_report", "AGG33")
def crop_report(spark, sf):
    c = _crop_candidates(spark, sf)
    return P.crop_report(P.pack_crops(c, 16), c, 16, H * H)


def _tile_masks(spark, sf):
    li = T.load(spark, sf, "lineitem")
    y, x = F.col("l_orderkey") % 256, F.col("l_partkey") % 256
    tile = F.concat_ws("_", F.lit("t"), F.floor(y / 64), F.floor(x / 64))
    return li.select(tile.alias("block_id"), F.col("l_linenumber").cast("long").alias("z"), (F.col("l_suppkey") % 8).alias("mask"), y.alias("y"), x.alias("x"))


_MK = {"m": "SELECT DISTINCT concat('t_', (l_orderkey % 256) // 64, '_', (l_partkey % 256) // 64) AS block_id, CAST(l_linenumber AS BIGINT) AS z, l_suppkey % 8 AS mask, l_orderkey % 256 AS y, l_partkey % 256 AS x FROM lineitem"}


@query("mask_iou", "JN15, ALG6 IoU", sql(ctes={**_MK, "s": "SELECT block_id, z, mask, count(*) AS n FROM m GROUP BY block_id, z, mask", "o": "SELECT a.block_id, a.z, a.mask, b.mask AS prev_mask, count(*) AS n FROM m a JOIN m b ON b.block_id = a.block_id AND b.z = a.z - 1 AND b.y = a.y AND b.x = a.x GROUP BY 1, 2, 3, 4"}, body="""
SELECT o.block_id, o.z, o.mask, o.prev_mask, round(o.n / CAST(a.n + b.n - o.n AS DOUBLE), 8) AS iou FROM o JOIN s a ON a.block_id = o.block_id AND a.z = o.z AND a.mask = o.mask JOIN s b ON b.block_id = o.block_id AND b.z = o.z - 1 AND b.mask = o.prev_mask"""))
def mask_iou(spark, sf):
    m = _tile_masks(spark, sf).distinct()
    prev = m.select("block_id", (F.col("z") + 1).alias("z"), F.col("mask").alias("prev_mask"), "y", "x")
    return P.overlap_iou(m, prev, ["block_id", "z"], "mask", "prev_mask").select("block_id", "z", "mask", "prev_mask", F.round("iou", 8).alias("iou"))


@query("mask_consolidation", "ALG6")
def mask_consolidation(spark, sf):
    m = _tile_masks(spark, sf)
    allowed = m.select("block_id", "z", "y", "x").distinct().where("(y + x) % 4 <> 0")
    return P.consolidate_masks(m, allowed, 3)


@query("mask_links", "ALG6, JN15 links")
def mask_links(spark, sf):
    lab = P.consolidate_masks(_tile_masks(spark, sf), None, 3)
    lo, hi = lab.agg(F.min("z"), F.max("z")).first()
    return P.link_sections(lab, list(range(lo, hi + 1)) if lo is not None else [], 0.02)
