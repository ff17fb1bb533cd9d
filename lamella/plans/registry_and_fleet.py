"""Sources, registry upserts, run logs and dashboards."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import fleet as G
from ..operators import runs as W
from ..operators.ordered import spread_join
from ..session import ensure_checkpoint_dir
from ..sources import imagestack as I
from ..sources import sinks as K
from ..sources import tables as T
from .registry import query, sql
from .section_quality import REPORT_CTES, _report

_URLS = {
    "u": "SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, CAST(nullif(regexp_extract(url, '(\\d+)\\D*$', 1), '') AS BIGINT) AS z_abs, url FROM pages",
    "f": "SELECT host, z_abs, max(url) AS path FROM u WHERE z_abs IS NOT NULL GROUP BY host, z_abs",
    "g": "SELECT host, lo, unnest(range(lo, hi + 1)) AS z_abs FROM (SELECT host, min(z_abs) AS lo, max(z_abs) AS hi FROM f GROUP BY host)",
}


def _url_index(spark, sf):
    p = T.load(spark, sf, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.col("url").alias("path"), F.col("url").alias("stem"))
    return I.section_index(p, "host")


@query("url_section_index", "SRC1, SRC5", sql(ctes=_URLS, body="""
SELECT g.host, g.z_abs, g.z_abs - lo AS z, path, CASE WHEN path IS NULL THEN 'missing' ELSE 'ok' END AS status FROM g LEFT JOIN f ON f.host = g.host AND f.z_abs = g.z_abs"""))
def url_section_index(spark, sf):
    return _url_index(spark, sf).select("host", "z_abs", "z", "path", "status")


@query("cutout_fill", "SRC4", sql("v_sections", body="""
SELECT b.block_id, k AS z, coalesce(s.mean, 0e0) AS mean FROM (SELECT DISTINCT block_id FROM v_sections) b CROSS JOIN (SELECT unnest(range(40, 56)) AS k) LEFT JOIN v_sections s ON s.block_id = b.block_id AND s.z = k AND s.status = 'ok'"""))
def cutout_fill(spark, sf):
    return I.read_cutout(T.sections(spark, sf), 40, 56, "mean", 0.0)


_CH = {"c": "SELECT concat('d', CAST(block_no % 3 AS VARCHAR)) AS dataset_id, z_start, z_end FROM v_blocks WHERE grade <> 'D'", "v": "SELECT concat('d', CAST(block_no % 3 AS VARCHAR)) AS dataset_id, min(z_start) AS lo, max(z_end) AS hi FROM v_blocks GROUP BY 1",
       "g": "SELECT dataset_id, lo, unnest(range(lo, hi)) AS z_abs FROM v"}


@query("chunk_sections", "SRC3", sql("v_blocks", ctes=_CH, body="""
SELECT g.dataset_id, z_abs - lo AS z, count(c.z_start) AS n_chunks, CASE WHEN count(c.z_start) = 0 THEN 'missing' ELSE 'ok' END AS status FROM g LEFT JOIN c ON c.dataset_id = g.dataset_id AND z_abs >= c.z_start AND z_abs < c.z_end GROUP BY g.dataset_id, z_abs, lo"""))
def chunk_sections(spark, sf):
    b = T.blocks(spark, sf).withColumn("dataset_id", F.concat(F.lit("d"), (F.col("block_no") % 3).cast("string")))
    name = F.concat(F.concat_ws("_", *[F.concat_ws("-", f"{a}_start", f"{a}_end") for a in "xyz"]), F.when(F.col("block_no") % 2 == 0, ".gz").otherwise(""))
    chunks = I.chunk_index(b.where("grade <> 'D'").select("dataset_id", name.alias("name")))
    vol = b.groupBy("dataset_id").agg(F.min("z_start").alias("z_lo"), F.max("z_end").alias("z_hi"))
    return I.section_chunk_status(vol, chunks).select("dataset_id", "z", "n_chunks", "status")


_MAN = {
    "d": """SELECT concat('root/p', CAST(p_partkey AS VARCHAR)) AS root, p_partkey AS k, p_partkey % 4 <> 0 AS has_doc, p_partkey % 3 = 0 AS em_declared, p_partkey % 5 = 0 AS two_assets, p_partkey % 7 AS m FROM part""",
    "n": "SELECT k, unnest(CASE m WHEN 0 THEN ['raw', 'GT', 'notes'] WHEN 1 THEN ['volume', 'em', 'pred'] WHEN 2 THEN ['readme'] WHEN 3 THEN ['img', 'labels', 'syn'] ELSE ['images'] END) AS name FROM d",
    "l": """SELECT k, min(CASE name WHEN 'em' THEN '00em' WHEN 'raw' THEN '01raw' WHEN 'image' THEN '02image' WHEN 'images' THEN '03images' WHEN 'img' THEN '06img' WHEN 'volume' THEN '07volume' END) AS em,
       count(*) FILTER (lower(name) IN ('gt', 'pred', 'labels', 'syn')) AS na FROM n GROUP BY k""",
}


@query("manifest_resolve", "SRC6, SRC7", sql(ctes=_MAN, body="""
SELECT root, CASE WHEN has_doc THEN concat('ds', d.k) ELSE concat('p', d.k) END AS dataset_id, CASE WHEN has_doc AND em_declared THEN 'declared/em' ELSE substr(em, 3) END AS em_path,
 CASE WHEN has_doc AND em_declared THEN 'xyz' ELSE 'zyx' END AS em_axes, CASE WHEN has_doc AND two_assets THEN 2 ELSE na END AS n_assets,
 array_to_string(list_filter([CASE WHEN NOT (has_doc AND em_declared) AND em IS NOT NULL THEN 'em' END, CASE WHEN NOT (has_doc AND two_assets) AND na > 0 THEN 'assets' END], lambda x: x IS NOT NULL), ',') AS inferred,
 CASE WHEN NOT (has_doc AND em_declared) AND em IS NULL THEN 'no image volume found' END AS error FROM d JOIN l ON l.k = d.k"""))
def manifest_resolve(spark, sf):
    k = F.col("p_partkey")
    p = T.load(spark, sf, "part").select(F.concat(F.lit("root/p"), k.cast("string")).alias("root"), k)
    em = F.when(k % 3 == 0, F.lit(', "em": {"path": "declared/em", "axes": "xyz"}')).otherwise("")
    assets = F.when(k % 5 == 0, F.lit(', "assets": [{"type": "gt_segmentation", "path": "a"}, {"type": "skeleton", "path": "b"}]')).otherwise("")
    doc = F.when(k % 4 != 0, F.concat(F.lit('{"dataset_id": "ds'), k.cast("string"), F.lit('"'), em, assets, F.lit("}")))
    m = k % 7
    names = F.when(m == 0, F.array(*map(F.lit, ("raw", "GT", "notes")))).when(m == 1, F.array(*map(F.lit, ("volume", "em", "pred")))).when(m == 2, F.array(F.lit("readme"))).when(
        m == 3, F.array(*map(F.lit, ("img", "labels", "syn")))).otherwise(F.array(F.lit("images")))
    r = I.resolve_manifests(p.select("root", doc.alias("doc")), p.select("root", F.explode(names).alias("name")))
    return r.select("root", "dataset_id", "em_path", "em_axes", "n_assets", F.array_join("inferred", ",").alias("inferred"), "error")


@query("registry_upsert", "SRC8, PRJ12", sql(ctes={"o": "SELECT * FROM part WHERE p_size < 30", "n": "SELECT * FROM part WHERE p_size > 20"}, body="""
SELECT coalesce(o.p_partkey, n.p_partkey) AS id, CASE WHEN n.p_partkey IS NOT NULL AND n.p_size % 2 = 0 THEN concat('new ', n.p_name) WHEN o.p_partkey IS NOT NULL THEN o.p_name END AS name,
 CASE WHEN o.p_partkey IS NULL THEN 'created' WHEN n.p_partkey IS NULL THEN 'kept' ELSE 'updated' END AS change,
 concat(CASE WHEN o.p_partkey IS NOT NULL THEN concat('brand=', o.p_brand, ';') ELSE '' END, 'v=', CASE WHEN n.p_partkey IS NOT NULL THEN '2' ELSE '1' END) AS extra
FROM o FULL OUTER JOIN n ON n.p_partkey = o.p_partkey"""))
def registry_upsert(spark, sf):
    p = T.load(spark, sf, "part")
    ident = F.col("p_partkey").alias("id")
    old = p.where("p_size < 30").select(ident, F.col("p_name").alias("name"), F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("v"), F.lit("1")).alias("extra"))
    new = p.where("p_size > 20").select(ident, F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("new "), "p_name")).alias("name"), F.create_map(F.lit("v"), F.lit("2")).alias("extra"))
    u = G.upsert(old, new, ["id"], ["extra"])
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("extra")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return u.select("id", "name", "change", flat.alias("extra"))


@query("blocks_rebuild", "SRC8 blocks", sql("v_blocks", ctes={"h": "SELECT concat('d', CAST(block_no % 4 AS VARCHAR)) AS dataset_id, * FROM v_blocks", "w": "SELECT * FROM h WHERE NOT (dataset_id = 'd1' AND block_no > 90)",
    "c": "SELECT dataset_id FROM h EXCEPT SELECT dataset_id FROM h h2 WHERE NOT EXISTS (SELECT 1 FROM h h3 WHERE h3.dataset_id = h2.dataset_id AND h3.block_no > 90 AND h3.dataset_id = 'd1')"}, body="""
SELECT dataset_id, block_id, dataset_id IN (SELECT dataset_id FROM c) AS rebuilt FROM w"""))
def blocks_rebuild(spark, sf):
    h = T.blocks(spark, sf).withColumn("dataset_id", F.concat(F.lit("d"), (F.col("block_no") % 4).cast("string"))).select("dataset_id", "block_id", "block_no")
    return G.rebuild_blocks(h, h.where("NOT (dataset_id = 'd1' AND block_no > 90)")).select("dataset_id", "block_id", "rebuilt")


@query("segment_select", "SRC9, PRJ14", sql(ctes={
    "w": "SELECT p_partkey, p_retailprice, p_brand, string_split(p_type, ' ') AS t FROM part",
    "s": "SELECT p_partkey AS id, p_retailprice AS size, [t[1]] AS tags FROM w UNION ALL SELECT p_partkey + 1000000, p_retailprice / 2, CASE WHEN len(t) >= 2 THEN [t[2]] ELSE [] END FROM w"}, body="""
SELECT id, size, array_to_string(tags, ' ') AS tags FROM s WHERE size >= 500 AND list_contains(tags, (SELECT min(t[1]) FROM w)) ORDER BY size DESC, id LIMIT 50"""))
def segment_select(spark, sf):
    p = T.load(spark, sf, "part")
    words = F.split("p_type", " ")
    k = F.col("p_partkey")
    doc = F.concat(F.lit('{"inline": {"ids": ["'), k.cast("string"), F.lit('", "'), (k + 1000000).cast("string"),
                   F.lit('"], "properties": [{"id": "num_voxels", "type": "number", "values": ['), F.col("p_retailprice").cast("string"), F.lit(", "), (F.col("p_retailprice") / 2).cast("string"),
                   F.lit(', "junk"]}, {"id": "tags", "type": "tags", "tags": '), F.to_json(words), F.lit(', "values": [[0], [1, 99]]}]}}'))
    seg = I.parse_properties(p.select(doc.alias("doc"), F.col("p_brand").alias("source")))
    first = p.agg(F.min(F.get(words, F.lit(0))).alias("t"))
    tag = first.first()["t"]
    return I.select_segments(seg, tag, 500.0, "num_voxels", 50).select(F.col("id").cast("bigint").alias("id"), "size", F.array_join("tags", " ").alias("tags"))


@query("tissue_profile", "AGG22, JN20", sql("v_pixels", ctes={"m": "SELECT * FROM v_pixels WHERE x >= 16 AND x < 145 AND y >= 8 AND y < 201 AND z >= 1 AND z < 6",
    "c": "SELECT CASE id WHEN 1 THEN 'neuropil' WHEN 3 THEN 'nucleus' WHEN 7 THEN 'fissure' ELSE concat('label_', id) END AS tissue, count(*) / (129e0 * 193 * 5) AS frac FROM m GROUP BY 1"}, body="""
SELECT tissue, round(frac, 8) AS frac, CAST(NULL AS VARCHAR) AS verdict FROM c UNION ALL
SELECT CASE WHEN (SELECT sum(frac) FROM c WHERE tissue = 'neuropil') < 0.5e0 THEN 'too_little_wanted_tissue' END, round((SELECT sum(frac) FROM c WHERE tissue = 'neuropil'), 8), CASE WHEN (SELECT sum(frac) FROM c WHERE tissue = 'neuropil') < 0.5e0 OR (SELECT sum(frac) FROM c WHERE tissue = 'fissure') > 0.9e0 THEN 'reject' ELSE 'ok' END"""))
def tissue_profile(spark, sf):
    comp, v = G.tissue_profile(T.pixels(spark, sf), {"x": (130, 1153), "y": (64, 1601), "z": (2, 11)}, {"x": 8, "y": 8, "z": 2}, {1: "neuropil", 3: "nucleus", 7: "fissure"}, ("neuropil",), ("fissure",), 0.5, 0.9)
    return comp.select("tissue", F.round("frac", 8).alias("frac"), F.lit(None).cast("string").alias("verdict")).unionByName(
        v.select(F.get("reasons", F.lit(0)).alias("tissue"), F.round("wanted_frac", 8).alias("frac"), "verdict"))


@query("delete_cascade", "SNK8", sql("v_runs", ctes={"gone": "SELECT DISTINCT run_id FROM v_runs WHERE dataset_id = 'ds3'", "b": "SELECT run_id, block_no FROM v_runs GROUP BY run_id, block_no"}, body="""
SELECT 'runs' AS "table", (SELECT count(*) FROM gone) AS n, (SELECT count(DISTINCT run_id) FROM v_runs WHERE dataset_id <> 'ds3') AS n_left
UNION ALL SELECT 'blocks', (SELECT count(*) FROM b WHERE run_id IN (SELECT run_id FROM gone)), (SELECT count(*) FROM b WHERE run_id NOT IN (SELECT run_id FROM gone))
UNION ALL SELECT 'traces', (SELECT count(*) FROM v_runs WHERE dataset_id = 'ds3'), (SELECT count(*) FROM v_runs WHERE dataset_id <> 'ds3')"""))
def delete_cascade(spark, sf):
    r = T.runs(spark, sf)
    runs = r.select("run_id", "dataset_id").distinct()
    return G.delete_cascade("ds3", runs, blocks=r.select("run_id", "block_no").distinct(), traces=r.select("dataset_id", "run_id"))[1]


# ----------------------------------------------------------------------------- run logs from the event stream

_EV = """SELECT user_id AS run_id, event_id, ts, value, props AS message, CASE event_id % 7 WHEN 0 THEN 'ingest' WHEN 1 THEN 'slice_qc' WHEN 2 THEN 'serial_qc' WHEN 3 THEN 'aggregate' WHEN 4 THEN 'persist' WHEN 5 THEN 'done' ELSE 'workflow' END AS stage,
  CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 11 = 0 THEN 'warn' ELSE 'info' END AS level FROM events"""


def log_events(spark, sf):
    e = T.load(spark, sf, "events")
    names = ["ingest", "slice_qc", "serial_qc", "aggregate", "persist", "done", "workflow"]
    stage = F.get(F.array(*[F.lit(s) for s in names]), (F.col("event_id") % 7).cast("int"))
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_id") % 11 == 0, "warn").otherwise("info")
    return e.select(F.col("user_id").alias("run_id"), "event_id", "ts", "value", F.col("props").alias("message"), stage.alias("stage"), level.alias("level"))


@query("event_page", "PRJ10, STR1 batch", sql(ctes={"ev": _EV}, body="""
SELECT event_id, run_id, stage, level, message FROM ev WHERE event_id > 100 AND stage <> 'workflow' AND level IN ('warn', 'error') AND contains(message, '7') ORDER BY event_id LIMIT 300"""))
def event_page(spark, sf):
    return G.page_events(log_events(spark, sf), 100, 300, "warn", "7").select("event_id", "run_id", "stage", "level", "message")


def _firsts(s):
    return f"min(event_id) FILTER (stage = '{s}') AS i_{s}, arg_min(ts, event_id) FILTER (stage = '{s}') AS t_{s}, count(*) FILTER (stage = '{s}') AS n_{s}"


def _node(i):
    s, later = G.STAGES[i], G.STAGES[i + 1:]
    first = f"least({', '.join('i_' + t for t in later)})" if len(later) > 1 else f"i_{later[0]}"
    end = "CASE " + " ".join(f"WHEN i_{t} = {first} THEN t_{t}" for t in later) + " END"
    return f"SELECT run_id, '{s}' AS stage, t_{s} AS started, CASE WHEN t_{s} IS NOT NULL THEN {end} END AS ended, {first} AS e, n_{s} AS n_events FROM g"


@query("run_graph", "WIN17", sql(ctes={"ev": _EV, "g": "SELECT run_id, " + ", ".join(_firsts(s) for s in G.STAGES) + " FROM ev GROUP BY run_id", "u": " UNION ALL ".join(_node(i) for i in range(5))}, body="""
SELECT run_id, stage, CASE WHEN started IS NULL THEN 'pending' WHEN e IS NOT NULL THEN 'done' ELSE 'running' END AS status, n_events, round(date_diff('microsecond', started, ended) / 1e6, 6) AS duration_s FROM u"""))
def run_graph(spark, sf):
    return G.stage_nodes(log_events(spark, sf)).select("run_id", "stage", "status", "n_events", F.round("duration_s", 6).alias("duration_s"))


_TR = "SELECT run_id, event_id, concat('n', event_id % 5) AS node, CASE event_id % 3 WHEN 0 THEN 'enter' WHEN 1 THEN 'exit' ELSE 'error' END AS phase, CASE WHEN event_id % 3 = 1 THEN value END AS duration_s FROM ev"


@query("node_visits", "WIN18", sql(ctes={"ev": _EV, "t": _TR, "nw": "SELECT run_id, arg_max(node, event_id) AS node FROM t WHERE phase = 'enter' GROUP BY run_id"}, body="""
SELECT t.run_id, t.node, count(*) FILTER (phase = 'enter') AS visits, round(sum(duration_s) FILTER (phase <> 'enter'), 4) AS total_s, arg_max(duration_s, event_id) FILTER (phase <> 'enter' AND duration_s IS NOT NULL) AS last_s,
 count(*) FILTER (phase = 'error') AS errors, arg_max(phase, event_id) AS phase, coalesce(any_value(nw.node) = t.node, false) AND arg_max(phase, event_id) = 'enter' AS active FROM t LEFT JOIN nw ON nw.run_id = t.run_id GROUP BY t.run_id, t.node"""))
def node_visits(spark, sf):
    e = log_events(spark, sf)
    phase = F.get(F.array(F.lit("enter"), F.lit("exit"), F.lit("error")), (F.col("event_id") % 3).cast("int"))
    t = e.select("run_id", "event_id", F.concat(F.lit("n"), (F.col("event_id") % 5).cast("string")).alias("node"), phase.alias("phase"), F.when(F.col("event_id") % 3 == 1, F.col("value")).alias("duration_s"))
    return G.node_visits(t).select("run_id", "node", "visits", F.round("total_s", 4).alias("total_s"), "last_s", "errors", "phase", "active")


@query("account_events", "PRJ21", sql(body="""
SELECT event_id, user_id AS actor, event_id % 150 AS target, event_type AS action FROM events WHERE (user_id = 7 OR event_id % 150 = 7) AND event_type IN ('click', 'error') ORDER BY event_id DESC LIMIT 200"""))
def account_events(spark, sf):
    e = T.load(spark, sf, "events").select("event_id", F.col("user_id").alias("actor"), (F.col("event_id") % 150).alias("target"), F.col("event_type").alias("action"))
    who = (F.col("actor") == 7) | (F.col("target") == 7)
    return e.where(who & F.col("action").isin("click", "error")).orderBy(F.col("event_id").desc()).limit(200)


# ----------------------------------------------------------------------------- dashboards

_TOT = "SELECT run_id, dataset_id, status, finished_at, CAST(sum(n_slices) AS BIGINT) AS n_sections, count(*) AS n_blocks, sum(bytes_read) AS bytes_read FROM v_runs GROUP BY run_id, dataset_id, status, finished_at"
_WALL = "(1e0 + run_id % 17)"


@query("fleet_dashboard", "JN18, AGG16", sql("v_runs", ctes={"t": _TOT, "s": f"SELECT n_sections / {_WALL} AS sps FROM t WHERE status = 'done'"}, body="""
SELECT count(*) FILTER (status = 'done') AS n_runs, count(*) FILTER (status = 'error') AS n_runs_error, CAST(sum(n_sections) FILTER (status = 'done') AS BIGINT) AS n_sections, round(sum(bytes_read) FILTER (status = 'done'), 0) AS bytes_read,
 (SELECT round(list_sort(list(sps))[CAST(floor(count(*) / 2) AS BIGINT) + 1], 6) FROM s) AS sections_per_s FROM t"""))
def fleet_dashboard(spark, sf):
    k = G.fleet_kpis(G.run_totals(T.runs(spark, sf)), F.lit(1.0) + F.col("run_id") % 17)
    return k.select("n_runs", "n_runs_error", "n_sections", F.round("bytes_read", 0).alias("bytes_read"), F.round("sections_per_s", 6).alias("sections_per_s"))


@query("fleet_datasets", "JN18, AGG14", sql("v_runs", ctes={"t": _TOT}, body="""
SELECT dataset_id, count(*) AS n_runs, max(run_id) AS run_id, arg_max(n_sections, run_id) AS n_sections, arg_max(n_blocks, run_id) AS n_blocks FROM t WHERE status = 'done' GROUP BY dataset_id"""))
def fleet_datasets(spark, sf):
    return G.latest_per_dataset(G.run_totals(T.runs(spark, sf))).select("dataset_id", "n_runs", "run_id", "n_sections", "n_blocks")


@query("latest_run_per_block", "AGG14, SET6", sql("v_runs", body="SELECT dataset_id, block_no, max(run_id) AS run_id FROM v_runs WHERE status = 'done' GROUP BY dataset_id, block_no"))
def latest_run_per_block(spark, sf):
    return W.latest_run_per_block(T.runs(spark, sf).where("status = 'done'"), ("dataset_id", "block_no"))


@query("index_counters", "AGG17", sql("v_runs", ctes={"t": _TOT, "s": "SELECT *, CASE WHEN n_sections >= 150 THEN 'large' ELSE 'small' END AS size_class FROM t"}, body="""
SELECT 'status' AS counter, status AS value, count(*) AS n FROM s GROUP BY status UNION ALL SELECT 'size_class', size_class, count(*) FROM s GROUP BY size_class UNION ALL SELECT 'dataset_id', dataset_id, count(*) FROM s GROUP BY dataset_id UNION ALL SELECT 'total', NULL, count(*) FROM s"""))
def index_counters(spark, sf):
    t = G.run_totals(T.runs(spark, sf)).withColumn("size_class", F.when(F.col("n_sections") >= 150, "large").otherwise("small"))
    return G.counters(t, ["status", "size_class", "dataset_id"])


@query("session_listing", "PRJ20", sql(body="""
SELECT job_id, CASE WHEN status = 'open' AND cursor = 0 THEN 'aborted' ELSE status END AS status, cursor FROM (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'running' END AS status, o_custkey % 4 AS cursor FROM orders)
WHERE status IN ('open', 'running') ORDER BY job_id DESC LIMIT 250"""))
def session_listing(spark, sf):
    st = F.col("o_orderstatus")
    o = T.load(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(st == "F", "done").when(st == "O", "open").otherwise("running").alias("status"), (F.col("o_custkey") % 4).alias("cursor"))
    return G.close_unused(G.list_jobs(o, ["open", "running"], 250))


@query("training_manifest", "AGG31", sql("v_blocks", ctes={"b": "SELECT concat('d', CAST(block_no % 6 AS VARCHAR)) AS dataset_id, block_id, CASE WHEN quality > 0.7e0 THEN 'train_sample' ELSE 'inference' END AS split, block_no % 6 < 2 AS small FROM v_blocks"}, body="""
SELECT dataset_id, block_id, 'train' AS "use" FROM b WHERE small OR split = 'train_sample' UNION ALL SELECT dataset_id, block_id, 'inference' FROM b WHERE NOT small"""))
def training_manifest(spark, sf):
    n = F.col("block_no") % 6
    b = T.blocks(spark, sf).select(F.concat(F.lit("d"), n.cast("string")).alias("dataset_id"), "block_id", F.when(F.col("quality") > 0.7, "train_sample").otherwise("inference").alias("split"), n.alias("n"))
    ds = b.select("dataset_id", F.when(F.col("n") < 2, "small").otherwise("large").alias("size_class")).distinct()
    return G.training_manifest(ds, b).select("dataset_id", "block_id", "use")


@query("label_colors", "FNV hash", sql(ctes={
    "c": "SELECT c_custkey AS id, CAST(c_custkey AS VARCHAR) AS t FROM customer",
    "h": "SELECT id, t, 0 AS i, CAST(2166136261 AS HUGEINT) AS h FROM c UNION ALL SELECT id, t, i + 1, (CAST(xor(CAST(h AS BIGINT), CAST(ascii(substr(t, i + 1, 1)) AS BIGINT)) AS HUGEINT) * 16777619) % 4294967296 FROM h WHERE i < length(t)"}, body="""
SELECT id, CAST(h AS BIGINT) AS hash, CAST(h % 360 AS BIGINT) AS hue FROM h WHERE i = length(t)"""))
def label_colors(spark, sf):
    c = T.load(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return c.withColumn("hash", G.label_color(F.col("id"))).withColumn("hue", F.col("hash") % 360)


@query("asset_copy_plan", "SNK3", sql("v_slices", ctes={"ex": "SELECT DISTINCT z FROM v_slices WHERE passed", "f": "SELECT concat('a', p_size % 3) AS asset, p_partkey % 120 + p_size % 3 * 1000 AS z_file, concat(p_name, p_partkey) AS file, p_partkey FROM part", "m": "SELECT asset, min(z_file) AS zmin FROM f GROUP BY asset"}, body="""
SELECT f.asset, z_file - zmin AS z, file, CASE WHEN p_partkey % 4 = 0 THEN 'reused' ELSE 'copy' END AS action FROM f JOIN m ON m.asset = f.asset WHERE z_file - zmin IN (SELECT z FROM ex)"""))
def asset_copy_plan(spark, sf):
    from .section_runs import slices

    k, s = F.col("p_partkey"), F.col("p_size") % 3
    p = T.load(spark, sf, "part")
    files = p.select(F.concat(F.lit("a"), s.cast("string")).alias("asset"), (k % 120 + s * 1000).alias("z_file"), F.concat("p_name", k.cast("string")).alias("file"))
    have = p.where("p_partkey % 4 = 0").select(F.concat("p_name", k.cast("string")).alias("file"))
    return K.asset_copy_plan(slices(spark, sf).where("passed").select("z").distinct(), files, have)


@query("materialise_plan", "SNK5", sql("v_slices", "v_blocks", body="""
SELECT s.block_id, s.z FROM v_slices s JOIN v_blocks b ON b.block_id = s.block_id WHERE s.z >= b.block_no % 7 AND s.z < b.block_no % 7 + b.z_end - b.z_start AND s.status <> 'ok'"""))
def materialise_plan(spark, sf):
    from .section_runs import slices

    s = slices(spark, sf)
    roi = T.blocks(spark, sf).select("block_id", (F.col("block_no") % 7).alias("lo"), (F.col("block_no") % 7 + F.col("z_end") - F.col("z_start")).alias("hi"))
    want = spread_join(s.select("block_id", "z"), roi, ["block_id"], F.floor(F.col("z") / 1024).cast("long")).where("z >= lo AND z < hi").select("block_id", "z")
    return K.missing_sections(want, s.where("status = 'ok'"), ["block_id", "z"])


@query("persist_results", "SNK1, SNK9", sql("v_slices", ctes={"b": REPORT_CTES["b"]}, body="""
SELECT CAST(1 AS INTEGER) AS run_id, dataset_id, count(*) AS n_blocks, CAST(sum(n_slices) AS BIGINT) AS n_slices, CAST(sum(n_passed) AS BIGINT) AS n_passed FROM b GROUP BY dataset_id"""))
def persist_results(spark, sf):
    root = f"{ensure_checkpoint_dir(spark)}/results-{uuid.uuid4().hex}"
    rows = _report(spark, sf).select(F.lit(1).alias("run_id"), "dataset_id", "block_id", "n_slices", "n_passed")
    K.persist_run({"qc_blocks": rows}, root)
    K.persist_run({"qc_blocks": rows}, root)  # a rerun replaces its own partitions
    return spark.read.parquet(f"{root}/qc_blocks").groupBy("run_id", "dataset_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("n_slices").alias("n_slices"), F.sum("n_passed").alias("n_passed"))
