"""Keyed state with event-time timers: lock-out after failures, blocks that are graded when complete or silent, alerts with a quiet time.

Each processor keeps a few numbers per key in the state store (RocksDB) and lets the watermark end what nobody ends. Of the rows of a key
in a micro-batch only the columns that decide are held, as numbers, and are taken in time order; a micro-batch is bounded by
maxFilesPerTrigger. Late rows behind the watermark are dropped by the engine."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Timers and several state variables per key need this provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _in_time_order(frames, *columns: str) -> list[np.ndarray]:
    """Columns of all rows of a key, sorted by the first two (time in microseconds, event number)."""
    held = [[f[c].to_numpy() for c in columns] for f in frames]
    cols = [np.concatenate([h[k] for h in held]) for k in range(len(columns))] if held else [np.zeros(0, np.int64)] * len(columns)
    order = np.lexsort((cols[1], cols[0]))
    return [c[order] for c in cols]


class Lockout(StatefulProcessor):
    """Attempts of a key: with `limit` failures within the window before it an attempt is rejected and not looked at; a success forgets the failures.
    State: the failures that still count, at most `limit`. The end of a lock is reported: by the next attempt, or by a timer where none comes."""

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window = limit, window_us

    def init(self, handle):
        self.handle = handle
        self.fails = handle.getListState("fails", "t long")

    def _locked_until(self, hits: list[int]) -> int | None:
        return hits[-self.limit] + self.window if len(hits) >= self.limit else None

    def handleInputRows(self, key, rows, timerValues):
        hits = [int(r[0]) for r in self.fails.get()] if self.fails.exists() else []
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        out = []
        for t, event, failed in zip(*_in_time_order(rows, "us", "event_id", "failed"), strict=True):
            before, hits = len(hits), [h for h in hits if t - h < self.window]
            if before >= self.limit > len(hits):  # the lock ended between two attempts, no timer has told it
                out.append((None, "unlocked", 0))
            if len(hits) >= self.limit:
                out.append((int(event), "rejected", int((self.window - (t - hits[-1])) // 1_000_000) + 1))
            elif failed:
                hits.append(int(t))
                out.append((int(event), "failed", 0))
            else:
                hits = []
                out.append((int(event), "passed", 0))
        if hits:
            self.fails.put([(h,) for h in hits])
        else:
            self.fails.clear()
        until = self._locked_until(hits)
        if until is not None:
            self.handle.registerTimer(-(-until // 1000))
        yield pd.DataFrame({"key": [key[0]] * len(out), "event_id": pd.array([o[0] for o in out], "Int64"), "outcome": [o[1] for o in out], "wait_s": pd.Series([o[2] for o in out], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.fails.clear()
        yield pd.DataFrame({"key": [key[0]], "event_id": pd.array([None], "Int64"), "outcome": ["unlocked"], "wait_s": [0]})

    def close(self):
        pass


def lockout(attempts: DataFrame, key: str, limit: int, window_s: int, late: str) -> DataFrame:
    """`attempts`: key, ts, event_id, failed -> key, event_id, outcome (failed, passed, rejected; unlocked without an event), wait_s."""
    use_state_store(attempts.sparkSession)
    rows = attempts.withWatermark("ts", late).select(F.col(key).alias("key"), "ts", F.unix_micros("ts").alias("us"), "event_id", "failed")
    kind = dict(rows.dtypes)["key"]
    return rows.groupBy("key").transformWithStateInPandas(Lockout(limit, window_s * 1_000_000), f"key {kind}, event_id long, outcome string, wait_s long", "Append", "EventTime")


class BlockClock(StatefulProcessor):
    """A block is graded when all its planned sections have come, or when none has come for `quiet`. State: seven numbers."""

    def __init__(self, quiet_us: int):
        self.quiet = quiet_us

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("block", "planned long, seen long, passed long, critical long, quality double, last long, done boolean")

    def _row(self, key, s, how):
        return pd.DataFrame({"key": [key[0]], "how": [how], "n_slices": [s[1]], "n_passed": [s[2]], "n_critical": [s[3]], "quality": [s[4] / max(s[1], 1)]})

    def handleInputRows(self, key, rows, timerValues):
        s = list(self.state.get()) if self.state.exists() else [-1, 0, 0, 0, 0.0, 0, False]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        for t, _, planned, passed, critical, quality in zip(*_in_time_order(rows, "us", "event_id", "planned", "passed", "critical", "quality"), strict=True):
            if planned >= 0:
                s[0] = int(planned)
            elif not s[6]:
                s = [s[0], s[1] + 1, s[2] + int(passed), s[3] + int(critical), s[4] + float(quality), int(t), False]
            if not s[6] and 0 <= s[0] <= s[1]:
                s[6] = True
                yield self._row(key, s, "complete")
        if not s[6] and s[1]:
            self.handle.registerTimer(-(-(s[5] + self.quiet) // 1000))
        self.state.update(tuple(s))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        s = list(self.state.get())
        s[6] = True
        self.state.update(tuple(s))
        yield self._row(key, s, "silent")

    def close(self):
        pass


def block_clock(sections: DataFrame, plan: DataFrame, quiet_s: int, late: str) -> DataFrame:
    """`sections`: key, ts, event_id, passed, critical, quality; `plan`: key, ts, planned -> key, how (complete or silent), n_slices, n_passed, n_critical, quality."""
    use_state_store(sections.sparkSession)
    none = F.lit(-1).cast("long")
    rows = sections.select("key", "ts", "event_id", none.alias("planned"), F.col("passed").cast("long").alias("passed"), F.col("critical").cast("long").alias("critical"), F.col("quality").cast("double").alias("quality"))
    zero = F.lit(0).cast("long")
    rows = rows.unionByName(plan.select("key", "ts", none.alias("event_id"), F.col("planned").cast("long").alias("planned"), zero.alias("passed"), zero.alias("critical"), F.lit(0.0).alias("quality")))
    rows = rows.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    kind = dict(rows.dtypes)["key"]
    return rows.groupBy("key").transformWithStateInPandas(BlockClock(quiet_s * 1_000_000), f"key {kind}, how string, n_slices long, n_passed long, n_critical long, quality double", "Append", "EventTime")


class QuietGate(StatefulProcessor):
    """At most one alert of a key within the quiet time after the last that went out. State: the time of that one, forgotten by a timer."""

    def __init__(self, quiet_us: int):
        self.quiet = quiet_us

    def init(self, handle):
        self.handle = handle
        self.last = handle.getValueState("last", "t long")

    def handleInputRows(self, key, rows, timerValues):
        last = int(self.last.get()[0]) if self.last.exists() else None
        keep = []
        for t, event in zip(*_in_time_order(rows, "us", "event_id"), strict=True):
            if last is None or t - last >= self.quiet:
                keep.append(int(event))
                last = int(t)
        if keep:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.last.update((last,))
            self.handle.registerTimer(-(-(last + self.quiet) // 1000))
        yield pd.DataFrame({"key": pd.Series([key[0]] * len(keep)), "event_id": pd.Series(keep, dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        yield pd.DataFrame({"key": pd.Series([key[0]][:0]), "event_id": pd.Series([], dtype="int64")})

    def close(self):
        pass


def quiet_gate(alerts: DataFrame, key: str, quiet_s: int, late: str) -> DataFrame:
    """`alerts`: key, ts, event_id -> key, event_id of the alerts that go out."""
    use_state_store(alerts.sparkSession)
    rows = alerts.withWatermark("ts", late).select(F.col(key).alias("key"), "ts", F.unix_micros("ts").alias("us"), "event_id")
    return rows.groupBy("key").transformWithStateInPandas(QuietGate(quiet_s * 1_000_000), f"key {dict(rows.dtypes)['key']}, event_id long", "Append", "EventTime")
