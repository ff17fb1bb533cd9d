"""Keyed state with timers does not depend on how the stream is cut into micro-batches."""
import os
import random

import pytest
from pyspark.sql import functions as F

from lamella.streaming import stateful as K
from lamella.streaming.runner import drain


def stream(spark, rows, schema, folder, cuts):
    """Rows in time order, cut into files that come one per micro-batch."""
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        spark.createDataFrame(rows[a:b], schema).withColumn("ts", F.timestamp_seconds("t")).drop("t").coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):  # the file source takes files by their time
            if name.endswith(".parquet") and not name.startswith("part-k"):
                os.rename(os.path.join(folder, name), new := os.path.join(folder, f"part-k{k:03d}.parquet"))
                os.utime(new, (1_600_000_000 + k, 1_600_000_000 + k))
    schema_ = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema_).option("maxFilesPerTrigger", 1).parquet(folder)


def attempts():
    rng, t, out = random.Random(3), 1_000_000, []
    for i in range(300):
        t += rng.choice([1, 3, 10, 40])
        out.append((rng.choice(["a", "b", "c"]), t, i, rng.random() < 0.8))
    return out


def locked(rows, limit, window):
    out, hits, end = [], {}, max(r[1] for r in rows)
    for k, t, i, failed in rows:
        h = hits.setdefault(k, [])
        now = [x for x in h if t - x < window]
        if len(h) >= limit > len(now):
            out.append((k, None, "unlocked", 0))
        if len(now) >= limit:
            out.append((k, i, "rejected", window - (t - now[-1]) + 1))
        elif failed:
            now.append(t)
            out.append((k, i, "failed", 0))
        else:
            now = []
            out.append((k, i, "passed", 0))
        hits[k] = now
    out += [(k, None, "unlocked", 0) for k, h in hits.items() if len(h) >= limit and h[-limit] + window <= end - 30]
    return sorted(out, key=str)


@pytest.mark.parametrize("cuts", [[], [40, 41, 150, 220]])
def test_lockout(spark, scratch, cuts):
    rows = attempts()
    s = stream(spark, rows, "user string, t long, event_id long, failed boolean", os.path.join(scratch, "in"), cuts)
    got = drain(K.lockout(s, "user", 5, 60, "30 seconds"), "append")
    assert sorted((tuple(r) for r in got.collect()), key=str) == locked(rows, 5, 60)


@pytest.mark.parametrize("cuts", [[], [3, 60, 100]])
def test_block_clock(spark, scratch, cuts):
    rng = random.Random(4)
    rows = sorted(((rng.choice(["x", "y", "z"]), 1_000 + rng.randrange(600), i) for i in range(150)), key=lambda r: r[1])
    rows += [("x", 5_000, 1000)]  # time goes on, far beyond the quiet time of the others
    s = stream(spark, [(k, t, i) for k, t, i in rows], "key string, t long, event_id long", os.path.join(scratch, "in"), cuts)
    plan_folder = os.path.join(scratch, "plan")
    spark.createDataFrame([("x", 20, 500), ("y", 500, 500)], "key string, planned long, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t").write.parquet(plan_folder)
    plan = spark.readStream.schema(spark.read.parquet(plan_folder).schema).parquet(plan_folder)
    sections = s.select("key", "ts", "event_id", (F.col("event_id") % 3 > 0).alias("passed"), F.lit(False).alias("critical"), F.lit(0.5).alias("quality"))
    got = {r.key: (r.how, r.n_slices, r.n_passed) for r in drain(K.block_clock(sections, plan, 1_000, "10 seconds"), "append").collect()}
    first = [i for k, _, i in rows if k == "x"][:20]
    size = lambda k: (sum(r[0] == k for r in rows), sum(r[0] == k and r[2] % 3 > 0 for r in rows))
    assert got == {"x": ("complete", 20, sum(i % 3 > 0 for i in first)), "y": ("silent", *size("y")), "z": ("silent", *size("z"))}


def test_quiet_gate(spark, scratch):
    rows = [(k, t, i) for k, t, i, _ in attempts()]
    s = stream(spark, rows, "key string, t long, event_id long", os.path.join(scratch, "in"), [10, 200])
    last, want = {}, set()
    for k, t, i in rows:
        if k not in last or t - last[k] >= 120:
            last[k] = t
            want.add(i)
    assert {r.event_id for r in drain(K.quiet_gate(s, "key", 120, "10 seconds"), "append").collect()} == want
