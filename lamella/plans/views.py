"""The same views as `sources.tables`, written independently as SQL for the DuckDB check."""
from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, text: str, *deps: str) -> None:
    VIEWS[name] = (deps, text.strip())


view("v_sections", """
SELECT concat('ds', CAST(user_id % 3 AS VARCHAR(20))) AS dataset_id,
       concat('b', lpad(CAST(user_id AS VARCHAR(20)), 5, '0')) AS block_id,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS z,
       event_id, ts, event_type,
       CASE WHEN event_type = 'error' AND event_id % 7 = 0 THEN 'missing'
            WHEN event_type = 'error' AND event_id % 11 = 0 THEN 'corrupt' ELSE 'ok' END AS status,
       0.45e0 + least(value, 200e0) / 1000e0 AS mean,
       0.05e0 + ((event_id * 37) % 101) / 500e0 AS std,
       0.05e0 + ((event_id * 53) % 97) / 97e0 AS sharpness,
       CAST(substr(props, 7, length(props) - 7) AS DOUBLE) / 110e0 AS frac_mode,
       CASE WHEN event_id % 13 = 0 THEN ((event_id * 29) % 60) / 100e0 ELSE 0e0 END AS frac_fill,
       ((event_id * 17) % 89) / 1000e0 AS frac_sat,
       1e0 + (event_id % 23) / 4e0 AS fill_elongation,
       event_id % 4 AS fill_sides
FROM events""")

view("v_blocks", """
SELECT concat('b', lpad(CAST(s_suppkey AS VARCHAR(20)), 5, '0')) AS block_id, s_suppkey AS block_no,
       CAST(floor(s_suppkey / 16) * 100 AS BIGINT) AS z_start,
       CAST(floor(s_suppkey / 16) * 100 + 100 AS BIGINT) AS z_end,
       CAST((CAST(floor(s_suppkey / 4) AS BIGINT) % 4) * 1024 AS BIGINT) AS y_start,
       CAST((CAST(floor(s_suppkey / 4) AS BIGINT) % 4) * 1024 + 1024 AS BIGINT) AS y_end,
       CAST((s_suppkey % 4) * 1024 AS BIGINT) AS x_start,
       CAST((s_suppkey % 4) * 1024 + 1024 AS BIGINT) AS x_end,
       CASE WHEN s_acctbal < 1000 THEN 'D' WHEN s_acctbal < 4000 THEN 'C'
            WHEN s_acctbal < 7000 THEN 'B' ELSE 'A' END AS grade,
       0.5e0 + ((s_suppkey * 37) % 51) / 100e0 AS retention,
       0.4e0 + ((s_suppkey * 53) % 61) / 100e0 AS quality
FROM supplier""")

view("v_patches", """
SELECT b.block_id,
       CASE l.l_returnflag WHEN 'A' THEN 'train' WHEN 'N' THEN 'val' ELSE 'test' END AS partition_name,
       b.z_start + l.l_partkey % 90 AS z0, b.z_start + l.l_partkey % 90 + 16 AS z1,
       b.y_start + (l.l_orderkey * 7) % 800 AS y0, b.y_start + (l.l_orderkey * 7) % 800 + 256 AS y1,
       b.x_start + (l.l_orderkey * 11) % 800 AS x0, b.x_start + (l.l_orderkey * 11) % 800 + 256 AS x1
FROM lineitem l JOIN v_blocks b ON b.block_no = l.l_suppkey""", "v_blocks")

view("v_thumbs", """
SELECT concat('b', CAST(label AS VARCHAR(20))) AS block_id,
       CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS z,
       vec_id, CAST(8 AS INT) AS h, CAST(8 AS INT) AS w, embedding AS px
FROM embeddings""")

view("v_pixels", """
SELECT CAST(l_linenumber AS BIGINT) AS z, l_orderkey % 256 AS y, l_partkey % 256 AS x,
       min(l_suppkey % 8 + 1) AS id, max(l_suppkey % 8 + 1) AS id_after
FROM lineitem GROUP BY CAST(l_linenumber AS BIGINT), l_orderkey % 256, l_partkey % 256""")

view("v_edit_voxels", """
SELECT CAST(row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS n,
       CAST(l_linenumber AS BIGINT) AS z, l_orderkey % 256 AS y, l_partkey % 256 AS x,
       l_suppkey % 8 + 1 AS new_id, l_returnflag AS author,
       CASE l_linestatus WHEN 'O' THEN 'paint' ELSE 'merge' END AS kind
FROM lineitem""")

view("v_audit", """
SELECT concat('b', lpad(CAST(conv_id AS VARCHAR(20)), 5, '0')) AS block_id,
       CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS seq,
       CASE WHEN turn % 5 = 4 THEN 'undo' ELSE 'edit' END AS action, role AS author,
       CAST(length(text) AS BIGINT) AS n_px,
       CASE WHEN length(text) % 17 = 0 THEN NULL ELSE CAST(length(text) % 8 AS BIGINT) END AS z
FROM conversations""")

view("v_reviews", """
SELECT block_id, z, max(seq) AS decided_rev, count(*) AS version,
       CASE max(seq) % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'completed' WHEN 2 THEN 'approved' ELSE 'changes_requested' END AS stored
FROM v_audit WHERE z IS NOT NULL AND seq % 2 = 1
GROUP BY block_id, z""", "v_audit")

view("v_label_docs", """
SELECT d.source AS block_id, d.doc_id AS z,
       CASE WHEN d.n_chars < 20 THEN 'blank' ELSE 'ok' END AS em_status,
       l.doc_id IS NOT NULL AS present, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")

view("v_runs", """
SELECT o.o_orderkey AS run_id, concat('ds', CAST(o.o_custkey % 7 AS VARCHAR(20))) AS dataset_id,
       CASE o.o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'error' END AS status,
       o.o_orderdate AS finished_at, CAST(l.l_linenumber AS BIGINT) AS block_no,
       CAST(l.l_quantity AS BIGINT) AS n_slices, l.l_extendedprice AS bytes_read
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey""")

# scores of the statistic-based section checks
view("v_blank", """
SELECT *, CASE WHEN status = 'ok' THEN least(least(1e0, greatest(0e0, std / 0.02e0)),
            least(1e0, greatest(0e0, 1e0 - greatest(frac_mode - 0.8e0, 0e0) / (1e0 - 0.8e0)))) END AS blank_slice
FROM v_sections""", "v_sections")

view("v_sharp_ref", """
SELECT block_id, quantile_cont(sharpness, 0.5) AS ref_sharp FROM v_blank
WHERE status = 'ok' AND blank_slice >= 0.4e0 GROUP BY block_id""", "v_blank")

view("v_scored", """
SELECT b.dataset_id, b.block_id, b.z, b.status, b.mean, b.std, b.frac_fill, b.event_id,
       CASE WHEN status = 'missing' THEN 0e0 ELSE 1e0 END AS missing_slice,
       CASE status WHEN 'corrupt' THEN 0e0 WHEN 'ok' THEN 1e0 END AS corrupt_slice,
       blank_slice,
       CASE WHEN status <> 'ok' OR blank_slice < 0.4e0 THEN NULL
            WHEN ref_sharp IS NULL OR ref_sharp < 1e-6 THEN 1e0
            ELSE least(least(1e0, sharpness / ref_sharp), least(1e0, sharpness / 0.02e0)) END AS severe_blur,
       CASE WHEN status = 'ok' THEN 1e0 - least(1e0, greatest(0e0, frac_sat / 0.2e0)) END AS saturation,
       CASE WHEN status = 'ok' THEN CASE WHEN frac_fill < 0.002e0 THEN 1e0
            ELSE 1e0 - least(1e0, greatest(0e0, ln(greatest(frac_fill, 0.02e0) / 0.02e0) / ln(0.6e0 / 0.02e0))) END END AS crack,
       CASE WHEN fill_sides >= 1 AND frac_fill >= 0.15e0 AND fill_elongation < 6e0 THEN 'no_coverage'
            WHEN fill_elongation >= 3e0 THEN 'crack' ELSE 'missing_region' END AS crack_type
FROM v_blank b LEFT JOIN v_sharp_ref r ON b.block_id = r.block_id""", "v_blank", "v_sharp_ref")


def _sev(col: str, low=0.75, medium=0.6, high=0.4, critical=0.2) -> str:
    return (f"CASE WHEN {col} < {critical}e0 THEN 4 WHEN {col} < {high}e0 THEN 3 WHEN {col} < {medium}e0 THEN 2 "
            f"WHEN {col} < {low}e0 THEN 1 ELSE 0 END")


SEVERITY_SQL = {
    "missing_slice": _sev("missing_slice"), "corrupt_slice": _sev("corrupt_slice"), "blank_slice": _sev("blank_slice"),
    "severe_blur": _sev("severe_blur", 0.75, 0.55, 0.35, 0.2), "saturation": _sev("saturation"), "crack": _sev("crack", 0.9, 0.7, 0.5, 0.2),
}
_sev_cols = ", ".join(f"{s} AS sev_{c}" for c, s in SEVERITY_SQL.items())
view("v_severity", f"SELECT *, {_sev_cols} FROM v_scored", "v_scored")

view("v_slices", """
SELECT dataset_id, block_id, z, status, mean, std,
       CASE WHEN status <> 'ok' THEN 0e0 ELSE least(missing_slice, corrupt_slice, blank_slice, severe_blur, saturation, crack) END AS quality,
       greatest(sev_missing_slice, sev_corrupt_slice, sev_blank_slice, sev_severe_blur, sev_saturation, sev_crack) AS max_sev,
       status = 'ok' AND greatest(sev_missing_slice, sev_corrupt_slice, sev_blank_slice, sev_severe_blur, sev_saturation, sev_crack) < 3 AS passed,
       status = 'ok' AND greatest(sev_missing_slice, sev_corrupt_slice, sev_blank_slice, sev_severe_blur, sev_saturation, sev_crack) < 3 AS in_chain
FROM v_severity""", "v_severity")

view("v_findings", """
SELECT dataset_id, block_id, z, check_name, check_order, failure_type, sev, score FROM (
  SELECT dataset_id, block_id, z, 'missing_slice' AS check_name, 0 AS check_order, 'missing' AS failure_type, sev_missing_slice AS sev, missing_slice AS score FROM v_severity
  UNION ALL SELECT dataset_id, block_id, z, 'corrupt_slice', 1, 'corrupt', sev_corrupt_slice, corrupt_slice FROM v_severity
  UNION ALL SELECT dataset_id, block_id, z, 'blank_slice', 2, 'blank', sev_blank_slice, blank_slice FROM v_severity
  UNION ALL SELECT dataset_id, block_id, z, 'severe_blur', 3, 'blur', sev_severe_blur, severe_blur FROM v_severity
  UNION ALL SELECT dataset_id, block_id, z, 'saturation', 4, 'saturation', sev_saturation, saturation FROM v_severity
  UNION ALL SELECT dataset_id, block_id, z, 'crack', 5, crack_type, sev_crack, crack FROM v_severity)
WHERE sev >= 1""", "v_severity")

view("v_block_grade", """
SELECT dataset_id, block_id, n_slices, n_passed, retention, quality,
       CASE WHEN retention < 0.6e0 THEN 'D' WHEN retention >= 0.95e0 AND n_critical = 0 THEN 'A' WHEN retention >= 0.85e0 THEN 'B' ELSE 'C' END AS grade
FROM (SELECT dataset_id, block_id, count(*) AS n_slices, count(*) FILTER (passed) AS n_passed,
             count(*) FILTER (passed) / CAST(count(*) AS DOUBLE) AS retention, avg(quality) AS quality,
             count(*) FILTER (max_sev >= 4 OR status <> 'ok') AS n_critical
      FROM v_slices GROUP BY dataset_id, block_id)""", "v_slices")
