"""Streams: late and re-ordered files, duplicates, update semantics; and plan shapes."""
import os

from pyspark.sql import functions as F

from lamella.plans import REGISTRY
from lamella.sources import tables as T
from lamella.streaming import operators as O
from lamella.streaming.runner import drain

SF = "/root/testdata/sf0.001"


def split_events(spark, scratch, order):
    e = T.load(spark, SF, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    d = os.path.join(scratch, "in")
    for i in order:  # the file source takes files in order of their time stamps
        e.where(F.floor(F.col("event_id") / 250) == i).coalesce(1).write.mode("append").parquet(d)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(d), e


def test_file_order_does_not_change_the_final_state(spark, scratch):
    s, e = split_events(spark, scratch, [2, 0, 3, 1])
    got = drain(O.failure_windows(s, "user_id", 3, "12 hours", "1 hour", "365 days"), "update", ["user_id", "start_s"])
    want = O.failure_windows(e, "user_id", 3, "12 hours", "1 hour", "365 days")
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_rows_behind_the_watermark_are_dropped(spark, scratch):
    s, e = split_events(spark, scratch, [3, 2, 0])  # rows are judged by the watermark of the batch before the last
    got = drain(O.rate_limit(s, "event_type", 4, "1 hour", "1 minute"), "update", ["event_type", "start_s"])
    seen = got.agg(F.sum(F.col("accepted") + F.col("rejected"))).first()[0]
    assert seen == e.where("event_id >= 500").count()


def test_alert_gate_keeps_its_state_between_batches(spark, scratch):
    s, e = split_events(spark, scratch, [0, 1, 2, 3])
    got = drain(O.alert_gate(s.withColumn("ts_s", F.unix_micros("ts") / 1e6), "user_id", 86400.0), "append")
    last, want = {}, set()
    for r in e.withColumn("t", F.unix_micros("ts") / 1e6).orderBy("ts", "event_id").collect():
        if r.user_id not in last or r.t - last[r.user_id] >= 86400:
            last[r.user_id] = r.t
            want.add(r.event_id)
    assert {r.event_id for r in got.collect()} == want


def test_built_in_alert_dedup(spark, scratch):
    s, e = split_events(spark, scratch, [0, 1])
    got = drain(O.deduplicate_alerts(s.select("user_id", "ts"), ["user_id"], "365 days"), "append")
    assert got.count() == e.where("event_id < 500").select("user_id").distinct().count()


def test_block_grade_is_corrected_when_more_sections_arrive(spark, scratch):
    s, e = split_events(spark, scratch, [0, 1, 2, 3])
    cols = lambda d: d.select(F.col("user_id").alias("block_id"), F.lit("ok").alias("status"), (F.col("event_type") != "error").alias("passed"), F.lit(0.9).alias("quality"), F.lit(0).alias("max_sev"))
    state = drain(O.block_grades(cols(s)), "update", ["block_id"])
    n = e.groupBy(F.col("user_id").alias("block_id")).agg(F.count(F.lit(1)).alias("n_slices"))
    a = O.finished_blocks(state, n).orderBy("block_id").collect()
    b = O.finished_blocks(O.block_grades(cols(e)), n).orderBy("block_id").collect()
    assert [(r.block_id, r.n_passed, r.grade) for r in a] == [(r.block_id, r.n_passed, r.grade) for r in b] and a


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan_of(REGISTRY["account_events"].run(spark, SF))
    assert "PushedFilters: [In(event_type, [click,error])]" in p  # the other condition is arithmetic on a column
    scan = [x for x in p.split("\n") if "ReadSchema" in x or "FileScan" in x]
    assert scan and all("props" not in x and "value" not in x for x in scan)


def test_sql_operators_do_not_leave_the_jvm(spark):
    for n in ("block_report", "brightness_walk", "patch_leak_check", "last_writer", "export_codes", "holdout_assign", "review_status", "boundary_map"):
        p = plan_of(REGISTRY[n].run(spark, SF))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "MapInPandas" not in p and "CartesianProduct" not in p, n
