"""Section scores, severities, findings and roll-ups."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rollup as R
from ..operators import slice_checks as S
from ..params import CHECKS, Config, severity_label, threshold_table
from ..session import cut_lineage
from ..sources import tables as T
from .registry import query, sql
from .views import SEVERITY_SQL


@T.shared
def rolled(spark, sf):
    return S.roll_up_sections(S.score_sections(T.sections(spark, sf)))


def _report(spark, sf):
    r = rolled(spark, sf)
    return R.block_report(r, S.findings(r))


SEV_LABEL = "CASE {0} WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END"

REPORT_CTES = {
    "runs": """SELECT block_id, max(n) AS longest FROM (SELECT block_id, count(*) AS n FROM
        (SELECT block_id, z - row_number() OVER (PARTITION BY block_id ORDER BY z) AS g FROM v_slices WHERE passed) GROUP BY block_id, g) GROUP BY block_id""",
    "ftypes": """SELECT block_id, failure_type, count(*) FILTER (sev >= 2) AS serious, count(*) AS n, min(z * 100 + check_order) AS pos FROM v_findings GROUP BY block_id, failure_type""",
    "dom": """SELECT block_id, failure_type FROM (SELECT t.*, row_number() OVER (PARTITION BY t.block_id
          ORDER BY CASE WHEN m.ms > 0 THEN serious ELSE n END DESC, pos, failure_type DESC) AS rn
          FROM ftypes t JOIN (SELECT block_id, max(serious) AS ms FROM ftypes GROUP BY block_id) m ON m.block_id = t.block_id) WHERE rn = 1""",
    "b": """SELECT dataset_id, block_id, count(*) AS n_slices, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'missing') AS n_missing,
        count(*) FILTER (status = 'corrupt') AS n_corrupt, count(*) FILTER (passed) AS n_passed, count(*) FILTER (max_sev >= 1) AS n_flagged,
        count(*) FILTER (max_sev >= 4 OR status <> 'ok') AS n_critical, avg(quality) AS quality, max(max_sev) AS max_sev
        FROM v_slices GROUP BY dataset_id, block_id""",
}


@query("block_report", "SRC, CHK1-6, PRJ6, AGG4, AGG7-10, WIN2", sql("v_slices", "v_findings", ctes=REPORT_CTES, body=f"""
SELECT b.dataset_id, b.block_id, n_slices, n_ok, n_missing, n_corrupt, n_passed, n_flagged, n_critical,
       round(n_passed / CAST(n_slices AS DOUBLE), 6) AS retention, round(quality, 6) AS quality, {SEV_LABEL.format('max_sev')} AS max_severity,
       coalesce(longest, 0) AS longest_clean_run, dom.failure_type AS dominant_failure,
       CASE WHEN n_passed / CAST(n_slices AS DOUBLE) < 0.6e0 THEN 'D' WHEN n_passed / CAST(n_slices AS DOUBLE) >= 0.95e0 AND n_critical = 0 THEN 'A'
            WHEN n_passed / CAST(n_slices AS DOUBLE) >= 0.85e0 THEN 'B' ELSE 'C' END AS grade
FROM b LEFT JOIN runs ON runs.block_id = b.block_id LEFT JOIN dom ON dom.block_id = b.block_id"""))
def block_report(spark, sf):
    return _report(spark, sf).select(
        "dataset_id", "block_id", "n_slices", "n_ok", "n_missing", "n_corrupt", "n_passed", "n_flagged", "n_critical", F.round("retention", 6).alias("retention"),
        F.round("quality", 6).alias("quality"), severity_label(F.col("max_sev")).alias("max_severity"), F.col("longest_clean_run"), "dominant_failure", "grade")


@query("section_scores", "CHK1-6, AGG7, WIN notes", sql("v_slices", "v_severity", body="""
SELECT s.block_id, s.z, s.status, round(s.quality, 6) AS quality, CAST(s.max_sev AS INTEGER) AS max_sev, s.passed,
       round(v.blank_slice, 6) AS blank_slice, round(v.severe_blur, 6) AS severe_blur, round(v.saturation, 6) AS saturation, round(v.crack, 6) AS crack,
       CASE WHEN v.severe_blur IS NULL THEN CASE WHEN s.status = 'ok' THEN 'blank' ELSE s.status END END AS blur_note,
       array_to_string(list_sort(list_filter([CASE WHEN sev_missing_slice > 0 THEN 'missing' END, CASE WHEN sev_corrupt_slice > 0 THEN 'corrupt' END, CASE WHEN sev_blank_slice > 0 THEN 'blank' END,
         CASE WHEN sev_severe_blur > 0 THEN 'blur' END, CASE WHEN sev_saturation > 0 THEN 'saturation' END, CASE WHEN sev_crack > 0 THEN crack_type END], lambda x: x IS NOT NULL)), ',') AS failure_types
FROM v_slices s JOIN v_severity v ON v.block_id = s.block_id AND v.z = s.z"""))
def section_scores(spark, sf):
    r = rolled(spark, sf)
    kinds = [F.when(F.col(f"sev_{c}") > 0, F.col("crack_type") if c == "crack" else F.lit(CHECKS[c][0])) for c in S.STAT_CHECKS]
    return r.select("block_id", "z", "status", F.round("quality", 6).alias("quality"), "max_sev", "passed",
                    *[F.round(c, 6).alias(c) for c in ("blank_slice", "severe_blur", "saturation", "crack")], S.notes("severe_blur").alias("blur_note"),
                    F.array_join(F.array_sort(F.array_compact(F.array(*kinds))), ",").alias("failure_types"))


@query("severity_buckets", "PRJ6-8, AGG13, SET1", sql("v_findings", body="""
SELECT check_name, failure_type, CAST(sev AS INTEGER) AS sev, count(*) AS n, round(min(score), 6) AS min_score FROM v_findings GROUP BY check_name, failure_type, sev"""))
def severity_buckets(spark, sf):
    r = rolled(spark, sf)
    long = r.select("crack_type", F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("score")) for c in S.STAT_CHECKS])).alias("e")).select("crack_type", "e.*")
    f = S.severity_long(long, threshold_table(spark)).where("sev >= 1")
    ftype = F.when(F.col("check") == "crack", F.col("crack_type")).otherwise(F.col("failure_type"))
    return f.groupBy(F.col("check").alias("check_name"), ftype.alias("failure_type"), "sev").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("score"), 6).alias("min_score"))


_OVERRIDE = {"thresholds": {"saturation": {"low": 0.9, "high": 0.55}}, "params": {"saturation": {"frac_ref": 0.15}}, "checks_enabled": ["saturation", "crack"], "unknown_key": 1}


@query("config_overrides", "PRJ6, PRJ7, UDF surface", sql("v_sections", body="""
SELECT check_name, sev, count(*) AS n FROM (
 SELECT 'saturation' AS check_name, CASE WHEN s < 0.2e0 THEN 4 WHEN s < 0.55e0 THEN 3 WHEN s < 0.6e0 THEN 2 WHEN s < 0.9e0 THEN 1 ELSE 0 END AS sev
 FROM (SELECT 1e0 - least(1e0, greatest(0e0, frac_sat / 0.15e0)) AS s FROM v_sections WHERE status = 'ok')
 UNION ALL
 SELECT 'crack', CASE WHEN s < 0.2e0 THEN 4 WHEN s < 0.5e0 THEN 3 WHEN s < 0.7e0 THEN 2 WHEN s < 0.9e0 THEN 1 ELSE 0 END
 FROM (SELECT CASE WHEN frac_fill < 0.002e0 THEN 1e0 ELSE 1e0 - least(1e0, greatest(0e0, ln(greatest(frac_fill, 0.02e0) / 0.02e0) / ln(0.6e0 / 0.02e0))) END AS s FROM v_sections WHERE status = 'ok'))
GROUP BY check_name, sev"""))
def config_overrides(spark, sf):
    c = Config(_OVERRIDE)
    s = S.score_sections(T.sections(spark, sf), c).where("status = 'ok'")
    long = s.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("score")) for k in ("blank_slice", "saturation", "crack")])).alias("e")).select("e.*")
    return S.severity_long(long, threshold_table(spark, c)).groupBy(F.col("check").alias("check_name"), "sev").agg(F.count(F.lit(1)).alias("n"))


@query("contrast_trend", "CHK8, AGG4, AGG5", sql("v_slices", ctes={
    "base": "SELECT block_id, quantile_cont(std, 0.5) AS ref FROM v_slices WHERE in_chain AND std > 0 GROUP BY block_id",
    "fit": """SELECT s.block_id, count(*) AS n, regr_slope(log2(std / ref), CAST(z AS DOUBLE)) * 100 AS per100, regr_r2(log2(std / ref), CAST(z AS DOUBLE)) AS r2,
              var_pop(log2(std / ref)) * count(*) AS ss FROM v_slices s JOIN base ON base.block_id = s.block_id WHERE in_chain AND std > 0 AND ref > 0 GROUP BY s.block_id"""},
    body="""SELECT block_id, n, round(per100, 6) AS log2_per_100z, round(CASE WHEN ss > 1e-12 THEN r2 ELSE 0e0 END, 6) AS r2,
    round(1e0 - least(1e0, abs(per100) / 0.5e0), 6) AS score FROM fit WHERE n >= 8"""))
def contrast_trend(spark, sf):
    _, trend = S.contrast_drift(rolled(spark, sf))
    return trend.select("block_id", "n", F.round("log2_per_100z", 6).alias("log2_per_100z"), F.round("r2", 6).alias("r2"), F.round("score", 6).alias("score"))


@query("contrast_scores", "CHK8", sql("v_slices", ctes={
    "base": "SELECT block_id, quantile_cont(std, 0.5) AS ref FROM v_slices WHERE in_chain AND std > 0 GROUP BY block_id"}, body="""
SELECT s.block_id, z, round(CASE WHEN NOT in_chain THEN NULL WHEN ref IS NULL OR ref <= 0 OR std <= 0 THEN 1e0
   ELSE 1e0 - least(1e0, abs(log2(std / ref))) END, 6) AS contrast_drift FROM v_slices s LEFT JOIN base ON base.block_id = s.block_id"""))
def contrast_scores(spark, sf):
    slices, _ = S.contrast_drift(rolled(spark, sf))
    return slices.select("block_id", "z", F.round("contrast_drift", 6).alias("contrast_drift"))


WALK_CTES = {
    "pos": "SELECT *, coalesce(sum(CAST(in_chain AS INTEGER)) OVER (PARTITION BY block_id ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k, row_number() OVER (PARTITION BY block_id ORDER BY z) AS rn FROM v_slices",
    # carried state: means and z of the last two chain sections with their outlier flags
    "walk": """SELECT block_id, rn, z, status, mean, in_chain, k, CAST(-9 AS DOUBLE) AS m1, CAST(-9 AS DOUBLE) AS m2, CAST(-1 AS BIGINT) AS z1, CAST(-1 AS BIGINT) AS z2, false AS o1, false AS o2,
         CAST(CASE WHEN status = 'ok' THEN 1e0 END AS DOUBLE) AS score, CAST(NULL AS BIGINT) AS ref_z, CAST(CASE WHEN status <> 'ok' THEN status END AS VARCHAR) AS note FROM pos WHERE rn = 1
       UNION ALL
       SELECT t.block_id, t.rn, t.z, t.status, t.mean, t.in_chain, t.k, t.m1, t.m2, t.z1, t.z2, t.o1, t.o2,
         CASE WHEN t.status <> 'ok' THEN NULL WHEN t.k = 0 THEN 1e0 WHEN NOT t.o1 THEN 1e0 - least(1e0, abs(t.mean - t.m1) / 0.2e0) WHEN t.k >= 2 AND NOT t.o2 THEN 1e0 - least(1e0, abs(t.mean - t.m2) / 0.2e0) END,
         CASE WHEN t.status <> 'ok' OR t.k = 0 THEN NULL WHEN NOT t.o1 THEN t.z1 WHEN t.k >= 2 AND NOT t.o2 THEN t.z2 END,
         CASE WHEN t.status <> 'ok' THEN t.status WHEN t.k > 0 AND t.o1 AND (t.k < 2 OR t.o2) THEN 'reference_reset' END
       FROM (SELECT p.block_id, p.rn, p.z, p.status, p.mean, p.in_chain, p.k,
               CASE WHEN w.in_chain THEN w.mean ELSE w.m1 END AS m1, CASE WHEN w.in_chain THEN w.m1 ELSE w.m2 END AS m2,
               CASE WHEN w.in_chain THEN w.z ELSE w.z1 END AS z1, CASE WHEN w.in_chain THEN w.z1 ELSE w.z2 END AS z2,
               CASE WHEN w.in_chain THEN coalesce(w.k > 0 AND w.score < 0.4e0, false) ELSE w.o1 END AS o1, CASE WHEN w.in_chain THEN w.o1 ELSE w.o2 END AS o2
             FROM walk w JOIN pos p ON p.block_id = w.block_id AND p.rn = w.rn + 1) t""",
}


@query("brightness_walk", "WIN5, CHK7, JN2", sql("v_slices", ctes=WALK_CTES, body="""
SELECT block_id, z, round(score, 6) AS brightness_jump, ref_z, note FROM walk"""))
def brightness_walk(spark, sf):
    w = S.brightness_jump(rolled(spark, sf), T.section_span(spark, sf))
    return w.select("block_id", "z", F.round("brightness_jump", 6).alias("brightness_jump"), "ref_z", "note")


@query("refchain_asof", "JN2", sql("v_slices", ctes={
    "pos": "SELECT *, coalesce(sum(CAST(in_chain AS INTEGER)) OVER (PARTITION BY block_id ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM v_slices",
    "ch": "SELECT block_id, k, z FROM pos WHERE in_chain"}, body="""
SELECT p.block_id, p.z, CAST(p.k AS BIGINT) AS k, a.z AS p1_z, b.z AS p2_z, a.z IS NULL AS first_of_chain FROM pos p
LEFT JOIN ch a ON a.block_id = p.block_id AND a.k = p.k - 1 LEFT JOIN ch b ON b.block_id = p.block_id AND b.k = p.k - 2"""))
def refchain_asof(spark, sf):
    r = S.with_references(S.chain_positions(rolled(spark, sf).select("block_id", "z", "in_chain")), [])
    return r.select("block_id", "z", "k", "p1_z", "p2_z", F.col("p1_z").isNull().alias("first_of_chain"))


_ROBUST = {
    "med": "SELECT block_id, quantile_cont(mean, 0.5) AS m FROM v_slices WHERE status = 'ok' GROUP BY block_id",
    "dev": "SELECT s.block_id, z, mean, m, abs(mean - m) AS d FROM v_slices s JOIN med ON med.block_id = s.block_id WHERE status = 'ok'",
    "mad": "SELECT block_id, quantile_cont(d, 0.5) AS mad FROM dev GROUP BY block_id",
}


@query("robust_excess", "AGG4", sql("v_slices", ctes=_ROBUST, body="""
SELECT dev.block_id, z, round(greatest(0e0, mean - m - 3e0 * greatest(mad * 1.4826e0, 0.01e0)), 8) AS excess FROM dev JOIN mad ON mad.block_id = dev.block_id"""))
def robust_excess(spark, sf):
    ok = T.sections(spark, sf).where("status = 'ok'").select("block_id", "z", "mean")
    return S.excess_over_baseline(ok, "block_id", "mean", 3.0, 0.01).select("block_id", "z", F.round("excess_mean", 8).alias("excess"))


def _long_scores(r):
    return r.select("dataset_id", "block_id", "z", F.explode(F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(c).alias("score")) for c in S.STAT_CHECKS])).alias("e")).select(
        "dataset_id", "block_id", "z", "e.*")


_LONG = " UNION ALL ".join(f"SELECT block_id, z, '{c}' AS check_name, {c} AS score FROM v_scored" for c in SEVERITY_SQL)
_STATS = {"longs": _LONG,
          "st": "SELECT block_id, check_name, min(score) AS mn, avg(score) AS av, count(score) AS ne FROM longs GROUP BY block_id, check_name",
          "fl": "SELECT block_id, check_name, count(*) AS nf FROM v_findings GROUP BY block_id, check_name"}


@query("check_summary", "AGG8, AGG15", sql("v_findings", ctes=_STATS, body="""
SELECT st.check_name, round(min(mn), 6) AS min_score, round(avg(av), 6) AS mean_of_means, CAST(sum(coalesce(nf, 0)) AS BIGINT) AS n_flagged, CAST(sum(ne) AS BIGINT) AS n_evaluated
FROM st LEFT JOIN fl ON fl.block_id = st.block_id AND fl.check_name = st.check_name GROUP BY st.check_name"""))
def check_summary(spark, sf):
    r = rolled(spark, sf)
    out = R.check_summary(R.per_check_block_stats(_long_scores(r), S.findings(r)))
    return out.select("check_name", F.round("min_score", 6).alias("min_score"), F.round("mean_of_means", 6).alias("mean_of_means"), "n_flagged", "n_evaluated")


_DS = """SELECT dataset_id, count(*) AS n_blocks, CAST(sum(n_slices) AS BIGINT) AS n_slices, CAST(sum(n_passed) AS BIGINT) AS n_passed, sum(quality * n_slices) / sum(n_slices) AS quality,
 CAST(sum(n_critical) AS BIGINT) AS n_critical, count(*) FILTER (g = 'A') AS grade_a, count(*) FILTER (g = 'B') AS grade_b, count(*) FILTER (g = 'C') AS grade_c, count(*) FILTER (g = 'D') AS grade_d,
 sum(n_passed) / CAST(sum(n_slices) AS DOUBLE) AS retention
 FROM (SELECT b.*, CASE WHEN n_passed / CAST(n_slices AS DOUBLE) < 0.6e0 THEN 'D' WHEN n_passed / CAST(n_slices AS DOUBLE) >= 0.95e0 AND n_critical = 0 THEN 'A' WHEN n_passed / CAST(n_slices AS DOUBLE) >= 0.85e0 THEN 'B' ELSE 'C' END AS g FROM b)
 GROUP BY dataset_id"""


@query("dataset_finalize", "AGG11", sql("v_slices", ctes={"b": REPORT_CTES["b"], "d": _DS}, body="""
SELECT dataset_id, n_blocks, n_slices, n_passed, round(quality, 6) AS quality, n_critical, grade_a, grade_b, grade_c, grade_d, round(retention, 6) AS retention,
  CASE WHEN retention < 0.6e0 THEN 'D' WHEN retention >= 0.95e0 AND n_critical = 0 THEN CASE WHEN grade_d > 0 THEN 'B' ELSE 'A' END WHEN retention >= 0.85e0 THEN 'B' ELSE 'C' END AS grade FROM d"""))
def dataset_finalize(spark, sf):
    d = R.finalize_datasets(_report(spark, sf))
    return d.select("dataset_id", "n_blocks", "n_slices", "n_passed", F.round("quality", 6).alias("quality"), "n_critical", "grade_a", "grade_b", "grade_c", "grade_d",
                    F.round("retention", 6).alias("retention"), "grade")


@query("metrics_long", "AGG12", sql("v_slices", ctes={k: REPORT_CTES[k] for k in ("runs", "b")}, body="""
SELECT dataset_id, block_id, metric_name, round(metric_value, 6) AS metric_value FROM (
 SELECT b.dataset_id, b.block_id, CAST(n_slices AS DOUBLE) AS n_slices, CAST(n_ok AS DOUBLE) AS n_ok, CAST(n_missing AS DOUBLE) AS n_missing, CAST(n_corrupt AS DOUBLE) AS n_corrupt, CAST(n_flagged AS DOUBLE) AS n_flagged,
  CAST(n_passed AS DOUBLE) AS n_passed, n_passed / CAST(n_slices AS DOUBLE) AS retention, CAST(coalesce(longest, 0) AS DOUBLE) AS longest_clean_run, CAST(n_critical AS DOUBLE) AS n_critical
 FROM b LEFT JOIN runs ON runs.block_id = b.block_id) UNPIVOT (metric_value FOR metric_name IN (n_slices, n_ok, n_missing, n_corrupt, n_flagged, n_passed, retention, longest_clean_run, n_critical))"""))
def metrics_long(spark, sf):
    return R.metrics_long(_report(spark, sf)).select("dataset_id", "block_id", "metric_name", F.round("metric_value", 6).alias("metric_value"))


# a block reads 65536 bytes per readable section, lasts from its first to its last section and is for training when its number is even
_MET = {"b": REPORT_CTES["b"], "t": "SELECT block_id, floor(epoch_us(min(ts)) / 1000000) AS s, floor(epoch_us(max(ts)) / 1000000) AS e FROM v_sections GROUP BY block_id",
        "m": """SELECT dataset_id, CAST(count(*) AS DOUBLE) AS n_blocks, CAST(sum(n_slices) AS DOUBLE) AS n_slices_input, CAST(sum(n_passed) AS DOUBLE) AS n_slices_passed, sum(n_passed) / CAST(sum(n_slices) AS DOUBLE) AS retention_rate,
 sum(quality * n_slices) / sum(n_slices) AS quality_score, CAST(sum(n_missing) AS DOUBLE) AS n_missing, CAST(sum(n_corrupt) AS DOUBLE) AS n_corrupt, CAST(max(e) - min(s) AS DOUBLE) AS duration_s,
 CAST(count(*) FILTER (CAST(substr(b.block_id, 2) AS INTEGER) % 2 = 0) AS DOUBLE) AS n_train_blocks, CAST(coalesce(sum(n_slices) FILTER (CAST(substr(b.block_id, 2) AS INTEGER) % 2 = 0), 0) AS DOUBLE) AS n_train_slices,
 CAST(sum(n_ok) * 65536 AS DOUBLE) AS bytes_read FROM b JOIN t ON t.block_id = b.block_id GROUP BY dataset_id""",
        "f": "SELECT dataset_id, CAST(sum(n) AS DOUBLE) AS n_findings, concat('{', string_agg(concat('\"', failure_type, '\":', n), ',' ORDER BY failure_type), '}') AS extra FROM (SELECT dataset_id, failure_type, count(*) AS n FROM v_findings GROUP BY ALL) GROUP BY dataset_id",
        "w": "SELECT m.*, coalesce(n_findings, 0) AS n_findings, coalesce(n_findings, 0) AS findings_by_type, coalesce(extra, '{}') AS extra FROM m LEFT JOIN f ON f.dataset_id = m.dataset_id"}


@query("dataset_metrics", "AGG12", sql("v_slices", "v_findings", ctes=_MET, body="""
SELECT dataset_id, 'dataset' AS stage, metric_name, round(metric_value, 6) AS metric_value, CASE WHEN metric_name = 'findings_by_type' THEN extra END AS extra FROM w
 UNPIVOT (metric_value FOR metric_name IN (n_blocks, n_slices_input, n_slices_passed, retention_rate, quality_score, n_findings, n_missing, n_corrupt, duration_s, n_train_blocks, n_train_slices, bytes_read, findings_by_type))"""))
def dataset_metrics(spark, sf):
    t = T.sections(spark, sf).groupBy("block_id").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    sec = lambda c: F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz")) / 1_000_000)
    even = F.substring("block_id", 2, 9).cast("int") % 2 == 0
    b = _report(spark, sf).join(t.select("block_id", sec("a").alias("started"), sec("z").alias("ended")), "block_id").withColumn("bytes_read", F.col("n_ok") * 65536).withColumn("split", F.when(even, "train").otherwise("val"))
    return R.dataset_metrics(b, S.findings(rolled(spark, sf))).withColumn("metric_value", F.round("metric_value", 6))


@query("findings_page", "PRJ9, PRJ11", sql("v_findings", ctes={"o": "SELECT dataset_id, block_id, z, check_name, sev, row_number() OVER (ORDER BY sev DESC, dataset_id, block_id, z, check_name) - 1 AS i, count(*) OVER () AS total FROM v_findings"}, body="""
SELECT dataset_id, block_id, z, check_name, CAST(sev AS INTEGER) AS sev, total, CASE WHEN 600 < total THEN 600 END AS next_offset FROM o WHERE i >= 400 AND i < 600"""))
def findings_page(spark, sf):
    f = S.findings(rolled(spark, sf)).select("dataset_id", "block_id", "z", "check_name", "sev")
    return R.page(f, [F.col("sev").desc(), "dataset_id", "block_id", "z", "check_name"], 400, 200)


@query("findings_filter", "PRJ8, PRJ9", sql("v_findings", body="""
SELECT dataset_id, block_id, z, check_name, failure_type, CAST(sev AS INTEGER) AS sev, round(score, 6) AS score FROM v_findings WHERE sev >= 3
ORDER BY dataset_id, z, block_id, check_order LIMIT 500"""))
def findings_filter(spark, sf):
    f = S.findings(rolled(spark, sf)).where("sev >= 3").orderBy("dataset_id", "z", "block_id", "check_order").limit(500)
    return f.select("dataset_id", "block_id", "z", "check_name", "failure_type", "sev", F.round("score", 6).alias("score"))


@query("findings_by_type", "AGG13", sql("v_findings", body="""
SELECT coalesce(check_name, '*') AS check_name, coalesce(CAST(sev AS VARCHAR), '*') AS sev, count(*) AS n FROM v_findings GROUP BY CUBE (check_name, sev)"""))
def findings_by_type(spark, sf):
    return S.findings(rolled(spark, sf)).cube("check_name", "sev").agg(F.count(F.lit(1)).alias("n")).select(
        F.coalesce("check_name", F.lit("*")).alias("check_name"), F.coalesce(F.col("sev").cast("string"), F.lit("*")).alias("sev"), "n")


@query("block_difficulty", "SMP16", sql("v_slices", ctes={"b": REPORT_CTES["b"], "m": "SELECT block_id, count(*) FILTER (max_sev >= 2) AS n_medium FROM v_slices GROUP BY block_id"}, body="""
SELECT b.block_id, round(CASE WHEN n_passed / CAST(n_slices AS DOUBLE) < 0.6e0 THEN greatest(d, 0.9e0) ELSE d END, 6) AS difficulty FROM
 (SELECT b.*, 0.5e0 * (1e0 - quality) + 0.3e0 * (1e0 - n_passed / CAST(n_slices AS DOUBLE)) + 0.2e0 * least(1e0, n_medium / CAST(n_slices AS DOUBLE)) AS d FROM b JOIN m ON m.block_id = b.block_id) b"""))
def block_difficulty(spark, sf):
    b = _report(spark, sf)
    return b.select("block_id", F.round(R.difficulty(F.col("quality"), F.col("retention"), F.col("n_medium"), F.col("n_slices"), F.col("grade")), 6).alias("difficulty"))


_EDGE = {
    "s": "SELECT concat(block_id, '/', CAST(z // 16 AS VARCHAR)) AS sub, block_id AS tile, z // 16 AS n, z, status, in_chain FROM v_slices",
    "ch": "SELECT sub, z FROM s WHERE in_chain UNION SELECT b.sub, s.z FROM (SELECT DISTINCT sub, tile, n FROM s) b JOIN s ON s.tile = b.tile AND s.z = b.n * 16 - 1 AND s.status = 'ok'",
}


@query("boundary_reference", "WIN20, JN2", sql("v_slices", ctes=_EDGE, body="""
SELECT s.sub AS block_id, s.z, (SELECT max(ch.z) FROM ch WHERE ch.sub = s.sub AND ch.z < s.z) AS p1_z FROM s"""))
def boundary_reference(spark, sf):
    """Every block cut into ranges of 16 sections; the last section of a range is the first reference of the next one."""
    n = F.floor(F.col("z") / 16).cast("long")
    s = rolled(spark, sf).select("z", "status", "in_chain", F.col("block_id").alias("tile"), F.concat_ws("/", "block_id", n).alias("block_id"))
    b = s.select("block_id", "tile", (n * 16).alias("z_start")).distinct()
    r = cut_lineage(S.with_boundary_sections(s.select("block_id", "z", "status", "in_chain"), b, ["tile"]))  # read several times below
    return S.with_references(S.chain_positions(r), []).where("NOT reference_only").select("block_id", "z", "p1_z")
