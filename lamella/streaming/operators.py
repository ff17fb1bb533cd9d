"""Streaming operators. Each takes a DataFrame with an event-time column and works the same on a stream and on a batch."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.rollup import grade


def log_tail(events: DataFrame, keep: Column) -> DataFrame:
    """Incremental tail of an append-only log; the file source checkpoint replaces "id > last seen"."""
    return events.where(keep)


def failure_windows(events: DataFrame, key: str, limit: int = 5, window: str = "60 seconds", slide: str = "5 seconds", late: str = "10 minutes") -> DataFrame:
    """Sliding failure counts per key; windows at or above `limit` are throttled."""
    w = events.withWatermark("ts", late).groupBy(key, F.window("ts", window, slide)).agg(F.count(F.lit(1)).alias("n"))
    return w.select(key, F.unix_timestamp("window.start").alias("start_s"), "n", (F.col("n") >= limit).alias("blocked"))


def error_bursts(events: DataFrame, limit: int = 5, window: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Sliding error counts over the whole stream."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window, slide)).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.unix_timestamp("window.start").alias("start_s"), "n", (F.col("n") >= limit).alias("alert"))


def rate_limit(events: DataFrame, key: str, limit: int = 30, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Accepted and rejected reports per source and tumbling window."""
    w = events.withWatermark("ts", late).groupBy(key, F.window("ts", window)).agg(F.count(F.lit(1)).alias("n"))
    return w.select(key, F.unix_timestamp("window.start").alias("start_s"), F.least(F.col("n"), F.lit(limit)).alias("accepted"), F.greatest(F.col("n") - limit, F.lit(0)).alias("rejected"))


def presence(heartbeats: DataFrame, person: str, ttl: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Online sessions: a heartbeat keeps a person present for `ttl`."""
    s = heartbeats.withWatermark("ts", late).groupBy(person, F.session_window("ts", ttl).alias("s")).agg(F.count(F.lit(1)).alias("n_beats"))
    return s.select(person, F.unix_micros("s.start").alias("start_us"), F.unix_micros("s.end").alias("end_us"), "n_beats")


def alert_gate(alerts: DataFrame, key: str, quiet_s: float = 300.0) -> DataFrame:
    """At most one alert per key within `quiet_s` of the last one that went out. State per key: one timestamp.

    Rows of a micro-batch are taken in time order; rows: key, event_id, ts_s (double seconds)."""
    key_type = dict(alerts.dtypes)[key]

    def step(k, batches, state: GroupState):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts_s", "event_id"])
        keep = []
        for i, t in enumerate(rows["ts_s"]):
            if last is None or t - last >= quiet_s:
                keep.append(i)
                last = float(t)
        state.update((last,))
        yield rows.iloc[keep][[key, "event_id", "ts_s"]]

    return alerts.select(key, "event_id", "ts_s").groupBy(key).applyInPandasWithState(
        step, f"{key} {key_type}, event_id bigint, ts_s double", "last double", "append", GroupStateTimeout.NoTimeout)


def deduplicate_alerts(alerts: DataFrame, keys: list[str], late: str = "5 minutes") -> DataFrame:
    """Built-in variant: one alert per key while the watermark has not moved past it."""
    return alerts.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def last_state(events: DataFrame, keys: list[str], state: str, order: list[str]) -> DataFrame:
    """Newest state and number of transitions per item."""
    return events.groupBy(*keys).agg(F.max_by(F.col(state), F.struct(*order)).alias("state"), F.count(F.lit(1)).alias("n_transitions"))


def revisions(log: DataFrame) -> DataFrame:
    """Largest sequence number per (block, z); block-wide entries keep z = -1."""
    return log.groupBy("block_id", F.coalesce(F.col("z"), F.lit(-1)).alias("z")).agg(F.max("seq").alias("rev"))


def fan_out_revisions(state: DataFrame, slices: DataFrame) -> DataFrame:
    """Section revisions from the streamed maxima: block-wide entries count on every section."""
    from ..operators.ordered import spread_join

    own = state.where("z >= 0").select("block_id", "z", F.col("rev").alias("own"))
    wide = state.where("z < 0").select("block_id", F.col("rev").alias("wide"))
    j = slices.join(own, ["block_id", "z"], "left")
    j = spread_join(j, wide, ["block_id"], F.floor(F.col("z") / 1024).cast("long"), "left")
    return j.select("block_id", "z", F.greatest(F.coalesce("own", F.lit(0)), F.coalesce("wide", F.lit(0))).cast("long").alias("rev"))


def block_grades(scored: DataFrame, key: str = "block_id") -> DataFrame:
    """Running block counters of a stream of scored sections (status, passed, quality, max_sev)."""
    return scored.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_seen"), F.count_if("passed").alias("n_passed"), F.sum("quality").alias("quality_sum"),
        F.count_if((F.col("max_sev") >= 4) | (F.col("status") != "ok")).alias("n_critical"))


def finished_blocks(counters: DataFrame, expected: DataFrame, key: str = "block_id") -> DataFrame:
    """Grades of the blocks whose sections have all arrived; a correction re-emits the block."""
    j = counters.join(expected, key).where(F.col("n_seen") >= F.col("n_slices"))
    r = F.col("n_passed") / F.col("n_seen")
    return j.select(key, "n_slices", "n_passed", r.alias("retention"), (F.col("quality_sum") / F.col("n_seen")).alias("quality"), grade(r, F.col("n_critical"), F.lit(False)).alias("grade"))


def run_counters(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Progress of a run while it is running."""
    return scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sections"), F.count_if("passed").alias("n_passed"), F.sum((F.col("max_sev") >= 1).cast("long")).alias("n_flagged"))


def read_json_log(spark, path: str, schema: str) -> DataFrame:
    """JSON-lines log whose last line may be torn by an interrupted append.

    A damaged line is dropped only when it is the unterminated tail of its file; anywhere else reading fails instead of
    returning a wrong history, also when a damaged line reads like the torn tail. Only the files that hold a damaged line are read whole."""
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file"))
    parsed = lines.withColumn("r", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})).where(F.length(F.trim("value")) > 0)
    bad = parsed.where("r._bad IS NOT NULL").groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("value"))
    damaged = [r["file"] for r in bad.where("n = 1").select("file").collect()]  # files that a crash left behind
    if damaged:
        files = spark.read.format("binaryFile").load(damaged).select(F.col("path").alias("file"), F.element_at(F.split(F.decode("content", "UTF-8"), "\n"), -1).alias("tail"))
        torn = files.join(bad.where("n = 1"), "file").where("tail = value AND tail <> ''").select("file", "value")
    else:
        torn = bad.where("n < 0").select("file", "value")
    verdict = parsed.join(torn.withColumn("_torn", F.lit(True)), ["file", "value"], "left")
    checked = verdict.withColumn("_drop", F.when(F.col("r._bad").isNull(), F.lit(False)).when(F.col("_torn"), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("damaged log line in "), "file")).cast("boolean")))
    return checked.where("NOT _drop").select("r.*").drop("_bad")
