"""Streaming queries, run to the end of the available input; every one has a batch statement for its final state."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import slice_checks as S
from ..params import HIGH
from ..sources import tables as T
from ..streaming import operators as O
from ..streaming import stateful as K
from ..streaming.runner import drain, event_time, stream_table
from .registry import query, sql
from .views import SEVERITY_SQL


def stream_events(spark, sf):
    return stream_table(spark, sf, "events").withColumn("ts", event_time("ts"))


_T = "CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)"


def _sliding(key, where, window, slide):
    n = window // slide
    k = f"{key}, " if key else ""
    return f"SELECT {k}({_T} // {slide}) * {slide} - k * {slide} AS start_s, count(*) AS n FROM events, (SELECT unnest(range(0, {n})) AS k) WHERE {where} GROUP BY {k}start_s"


@query("stream_tail", "STR1", sql(body="SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' AND contains(props, '7')"))
def stream_tail(spark, sf):
    e = O.log_tail(stream_events(spark, sf), (F.col("event_type") == "error") & F.col("props").contains("7"))
    return drain(e.select("event_id", "user_id", "event_type"), "append")


# the supplied events are minutes apart, so the windows here are hours instead of the default seconds
@query("stream_throttle", "STR5", sql(ctes={"w": _sliding("user_id", "event_type = 'error'", 43200, 3600)}, body="SELECT user_id, start_s, n, n >= 3 AS blocked FROM w"))
def stream_throttle(spark, sf):
    e = stream_events(spark, sf).where("event_type = 'error'")
    return drain(O.failure_windows(e, "user_id", 3, "12 hours", "1 hour", "30 days"), "update", ["user_id", "start_s"])


@query("stream_error_burst", "STR6", sql(ctes={"w": _sliding("", "event_type = 'error'", 7200, 600)}, body="SELECT start_s, n, n >= 5 AS alert FROM w"))
def stream_error_burst(spark, sf):
    e = stream_events(spark, sf).where("event_type = 'error'")
    return drain(O.error_bursts(e, 5, "2 hours", "10 minutes", "30 days"), "update", ["start_s"])


@query("stream_rate_limit", "STR8", sql(ctes={"w": f"SELECT event_type, ({_T} // 3600) * 3600 AS start_s, count(*) AS n FROM events GROUP BY 1, 2"}, body="SELECT event_type, start_s, least(n, 4) AS accepted, greatest(n - 4, 0) AS rejected FROM w"))
def stream_rate_limit(spark, sf):
    return drain(O.rate_limit(stream_events(spark, sf), "event_type", 4, "1 hour", "30 days"), "update", ["event_type", "start_s"])


_SES = {"o": "SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events",
        "g": "SELECT user_id, t, sum(CASE WHEN p IS NULL OR t - p >= 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM o"}


@query("stream_presence", "STR4", sql(ctes=_SES, body="SELECT user_id, min(t) AS start_us, max(t) + 7200000000 AS end_us, count(*) AS n_beats FROM g GROUP BY user_id, s"))
def stream_presence(spark, sf):
    return drain(O.presence(stream_events(spark, sf), "user_id", "2 hours", "30 days"), "complete")


_GATE = {"e": "SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events",
         "w": "SELECT user_id, event_id, t, rn, t AS last, true AS sent FROM e WHERE rn = 1 UNION ALL SELECT e.user_id, e.event_id, e.t, e.rn, CASE WHEN e.t - w.last >= 86400 THEN e.t ELSE w.last END, e.t - w.last >= 86400 FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1"}


@query("stream_alert_dedup", "STR7", sql(ctes=_GATE, body="SELECT user_id, event_id FROM w WHERE sent"))
def stream_alert_dedup(spark, sf):
    e = stream_events(spark, sf).withColumn("ts_s", F.unix_micros("ts") / 1e6)
    return drain(O.alert_gate(e, "user_id", 86400.0), "append").select("user_id", "event_id")


@query("stream_session_state", "STR3", sql(body="""
SELECT user_id, event_type AS state, n AS n_transitions FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE rn = 1"""))
def stream_session_state(spark, sf):
    return drain(O.last_state(stream_events(spark, sf), ["user_id"], "event_type", ["ts", "event_id"]), "update", ["user_id"])


def scored_stream(spark, sf):
    """Row-wise section scores of the event stream (checks that need no block baseline)."""
    e = stream_table(spark, sf, "events")
    i, err = F.col("event_id"), F.col("event_type") == "error"
    s = e.select(T.padded("b", F.col("user_id")).alias("block_id"), F.concat(F.lit("ds"), (F.col("user_id") % 3).cast("string")).alias("dataset_id"),
                 F.when(err & (i % 7 == 0), "missing").when(err & (i % 11 == 0), "corrupt").otherwise("ok").alias("status"), (F.lit(0.05) + ((i * 37) % 101) / 500.0).alias("std"),
                 (F.expr("CAST(substr(props, 7, length(props) - 7) AS DOUBLE)") / 110.0).alias("frac_mode"), F.when(i % 13 == 0, ((i * 29) % 60) / 100.0).otherwise(F.lit(0.0)).alias("frac_fill"), (((i * 17) % 89) / 1000.0).alias("frac_sat"))
    c = S.Config()
    ok = F.col("status") == "ok"
    scores = {"blank_slice": S.blank_score(c.params("blank_slice")), "saturation": F.lit(1.0) - S.clip01(F.col("frac_sat") / 0.2), "crack": S.crack_score(c.params("crack"))}
    s = s.withColumns({k: F.when(ok, v) for k, v in scores.items()})
    worst = F.when(~ok, F.lit(4)).otherwise(F.greatest(*[c.severity(k, F.col(k)) for k in scores]))
    return s.withColumn("quality", F.when(ok, F.least(*[F.col(k) for k in scores])).otherwise(F.lit(0.0))).withColumn("max_sev", worst).withColumn("passed", ok & (F.col("max_sev") < HIGH))


_SC = {"r": f"""SELECT block_id, dataset_id, status, CASE WHEN status <> 'ok' THEN 0e0 ELSE least(blank_slice, saturation, crack) END AS quality,
   CASE WHEN status <> 'ok' THEN 4 ELSE greatest({SEVERITY_SQL['blank_slice']}, {SEVERITY_SQL['saturation']}, {SEVERITY_SQL['crack']}) END AS ms FROM v_scored"""}


@query("stream_block_grade", "STR2", sql("v_scored", ctes={**_SC, "b": "SELECT block_id, count(*) AS n_slices, count(*) FILTER (status = 'ok' AND ms < 3) AS n_passed, sum(quality) AS q, count(*) FILTER (ms >= 4) AS nc FROM r GROUP BY block_id"}, body="""
SELECT block_id, n_slices, n_passed, round(n_passed / CAST(n_slices AS DOUBLE), 6) AS retention, round(q / n_slices, 6) AS quality, CASE WHEN n_passed / CAST(n_slices AS DOUBLE) < 0.6e0 THEN 'D' WHEN n_passed / CAST(n_slices AS DOUBLE) >= 0.95e0 AND nc = 0 THEN 'A'
 WHEN n_passed / CAST(n_slices AS DOUBLE) >= 0.85e0 THEN 'B' ELSE 'C' END AS grade FROM b"""))
def stream_block_grade(spark, sf):
    state = drain(O.block_grades(scored_stream(spark, sf)), "update", ["block_id"])
    expected = T.load(spark, sf, "events").groupBy(T.padded("b", F.col("user_id")).alias("block_id")).agg(F.count(F.lit(1)).alias("n_slices"))
    g = O.finished_blocks(state, expected)
    return g.select("block_id", "n_slices", "n_passed", F.round("retention", 6).alias("retention"), F.round("quality", 6).alias("quality"), "grade")


@query("stream_run_counters", "STR11", sql("v_scored", ctes=_SC, body="SELECT dataset_id, count(*) AS n_sections, count(*) FILTER (status = 'ok' AND ms < 3) AS n_passed, count(*) FILTER (ms >= 1) AS n_flagged FROM r GROUP BY dataset_id"))
def stream_run_counters(spark, sf):
    return drain(O.run_counters(scored_stream(spark, sf), ["dataset_id"]), "complete")


@query("stream_revision", "STR9", sql(ctes={
    "a": "SELECT concat('b', lpad(CAST(conv_id AS VARCHAR), 5, '0')) AS block_id, turn AS seq, CASE WHEN length(text) % 17 = 0 THEN NULL ELSE length(text) % 8 END AS z FROM conversations",
    "s": "SELECT block_id, CAST(k AS BIGINT) AS z FROM (SELECT DISTINCT block_id FROM a), (SELECT unnest(range(0, (SELECT max(z) + 1 FROM a))) AS k)"}, body="""
SELECT s.block_id, s.z, coalesce(max(a.seq), 0) AS rev FROM s LEFT JOIN a ON a.block_id = s.block_id AND (a.z IS NULL OR a.z = s.z) GROUP BY s.block_id, s.z"""))
def stream_revision(spark, sf):
    n = F.length("text")

    def log(c):
        return c.select(T.padded("b", F.col("conv_id")).alias("block_id"), F.col("turn").alias("seq"), F.when(n % 17 == 0, F.lit(None)).otherwise(n % 8).cast("long").alias("z"))

    state = drain(O.revisions(log(stream_table(spark, sf, "conversations"))), "update", ["block_id", "z"])
    entries = log(T.load(spark, sf, "conversations"))
    slots = entries.select("block_id").distinct().crossJoin(F.broadcast(entries.agg(F.max("z").alias("_top")))).select("block_id", F.explode(F.sequence(F.lit(0).cast("long"), "_top")).alias("z"))  # against one row
    return O.fan_out_revisions(state, slots)


# ----------------------------------------------------------------------------- keyed state with timers

_WINDOW, _LIMIT = 259_200, 3  # days instead of the default minute, as the events are hours apart
_LOCK = {
    "a": "SELECT user_id, event_id, epoch_us(ts) AS t, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type IN ('error', 'purchase')",
    "w": f"""SELECT user_id, event_id, rn, t, CASE WHEN failed THEN [t] ELSE CAST([] AS BIGINT[]) END AS hits, CASE WHEN failed THEN 'failed' ELSE 'passed' END AS outcome, 0 AS wait_s, false AS unlocked FROM a WHERE rn = 1
 UNION ALL SELECT user_id, event_id, rn, t, CASE WHEN len(old) >= {_LIMIT} THEN old WHEN failed THEN list_append(old, t) ELSE CAST([] AS BIGINT[]) END,
  CASE WHEN len(old) >= {_LIMIT} THEN 'rejected' WHEN failed THEN 'failed' ELSE 'passed' END, CASE WHEN len(old) >= {_LIMIT} THEN ({_WINDOW}000000 - (t - old[-1])) // 1000000 + 1 ELSE 0 END, len(hits) >= {_LIMIT} AND len(old) < {_LIMIT}
 FROM (SELECT a.*, w.hits, list_filter(w.hits, lambda h: a.t - h < {_WINDOW}000000) AS old FROM w JOIN a ON a.user_id = w.user_id AND a.rn = w.rn + 1)""",
    "e": f"SELECT user_id FROM w WHERE unlocked UNION ALL SELECT user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) AS r FROM w) WHERE r = 1 AND len(hits) >= {_LIMIT} AND hits[-{_LIMIT}] + {_WINDOW}000000 <= (SELECT max(t) - 86400000000 FROM a)"}


@query("stream_lockout", "STR5", sql(ctes=_LOCK, body="SELECT user_id, event_id, outcome, CAST(wait_s AS BIGINT) AS wait_s FROM w UNION ALL SELECT user_id, NULL, 'unlocked', 0 FROM e"))
def stream_lockout(spark, sf):
    e = stream_events(spark, sf).where("event_type IN ('error', 'purchase')").withColumn("failed", F.col("event_type") == "error")
    return drain(K.lockout(e, "user_id", _LIMIT, _WINDOW, "1 day"), "append").withColumnRenamed("key", "user_id")


_CLOCK = {
    "s": "SELECT e.user_id, c_custkey, 40 + c_custkey % 60 AS planned, epoch_us(ts) AS t, event_type <> 'error' AS passed, event_type = 'error' AND event_id % 7 = 0 AS critical, CASE WHEN event_type = 'error' THEN 0.25e0 ELSE 0.875e0 END AS q, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events e LEFT JOIN customer ON c_custkey = user_id",
    "g": "SELECT user_id, count(*) AS n, max(planned) AS planned, max(t) AS last FROM s GROUP BY user_id"}


@query("stream_block_clock", "STR2, STR11", sql(ctes=_CLOCK, body="""
SELECT user_id, CASE WHEN n >= g.planned THEN 'complete' ELSE 'silent' END AS how, count(*) AS n_slices, count(*) FILTER (passed) AS n_passed, count(*) FILTER (critical) AS n_critical, round(avg(q), 8) AS quality
FROM g JOIN s USING (user_id) WHERE (n >= g.planned AND rn <= g.planned) OR (n < coalesce(g.planned, n + 1) AND last + 172800000000 <= (SELECT max(t) - 3600000000 FROM s)) GROUP BY user_id, n, g.planned"""))
def stream_block_clock(spark, sf):
    """A block is a user: its sections are the user's events, the plan comes from the customers."""
    e, error = stream_events(spark, sf), F.col("event_type") == "error"
    s = e.select(F.col("user_id").alias("key"), "ts", "event_id", (~error).alias("passed"), (error & (F.col("event_id") % 7 == 0)).alias("critical"), F.when(error, 0.25).otherwise(0.875).alias("quality"))
    plan = stream_table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.timestamp_seconds(F.lit(1_000_000_000)).alias("ts"), (40 + F.col("c_custkey") % 60).alias("planned"))
    return drain(K.block_clock(s, plan, 172_800, "1 hour"), "append").withColumnRenamed("key", "user_id").withColumn("quality", F.round("quality", 8))


@query("stream_quiet_gate", "STR7", sql(ctes=_GATE, body="SELECT user_id, event_id FROM w WHERE sent"))
def stream_quiet_gate(spark, sf):
    return drain(K.quiet_gate(stream_events(spark, sf), "user_id", 86_400, "30 days"), "append").withColumnRenamed("key", "user_id")
