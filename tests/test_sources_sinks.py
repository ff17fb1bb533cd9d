"""File sources, sinks and resume behaviour."""
import gzip
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.operators import blocks as B
from lamella.operators.delivery import read_export, write_export
from lamella.operators.stats import ingest_sections
from lamella.sources import imagestack as I
from lamella.sources import sinks as K
from lamella.sources import tables as T
from lamella.streaming.operators import read_json_log


def pgm(a):
    top = 255 if a.dtype == np.uint8 else 65535
    return b"P5\n# made in a test\n%d %d\n%d\n" % (a.shape[1], a.shape[0], top) + (a.astype(">u2").tobytes() if top > 255 else a.tobytes())


def test_image_stack_reports_missing_and_corrupt(spark, scratch):
    d = os.path.join(scratch, "vol", "em_1")
    os.makedirs(d)
    rng = np.random.default_rng(0)
    planes = {z: rng.integers(1, 255, (20, 30)).astype(np.uint8) for z in (3, 4, 6, 7)}
    for z, a in planes.items():
        open(os.path.join(d, f"s2_z{z:04d}.pgm"), "wb").write(pgm(a))
    open(os.path.join(d, "s2_z0008.pgm"), "wb").write(b"junk")
    open(os.path.join(d, "s2_z0009.pgm"), "wb").write(pgm(planes[3][:10]))
    s = I.complete_stack(I.read_stack(spark, os.path.join(scratch, "vol"), "*.pgm")).orderBy("z").collect()
    assert [(r.z, r.z_abs, r.status) for r in s] == [(0, 3, "ok"), (1, 4, "ok"), (2, 5, "missing"), (3, 6, "ok"), (4, 7, "ok"), (5, 8, "corrupt"), (6, 9, "corrupt")]
    assert np.array_equal(np.frombuffer(s[1].payload, np.uint8).reshape(20, 30), planes[4]) and s[5].error
    tiles = [("_l", 0, 20, 0, 15), ("_r", 0, 20, 15, 30)]
    got = ingest_sections(I.complete_stack(I.read_stack(spark, os.path.join(scratch, "vol"), "*.pgm")), tiles).collect()
    assert len(got) == 14
    one = next(r for r in got if r.z == 3 and r.block_id.endswith("_r"))
    assert abs(one.mean - planes[6][:, 15:].mean() / 255) < 1e-9 and one.bytes_read == 300
    assert all(r["mean"] is None for r in got if r.status != "ok")
    wide = pgm(rng.integers(0, 60000, (4, 5)).astype(np.uint16))
    assert I.decode_pgm(wide).dtype == np.uint16


def test_npy_axes_and_chunks(spark, scratch):
    a = np.arange(2 * 3 * 4, dtype=np.uint16).reshape(2, 3, 4)  # z, y, x
    np.save(os.path.join(scratch, "v.npy"), np.transpose(a, (2, 1, 0)))
    rows = I.read_npy_volumes(spark, scratch, "xyz").orderBy("z").collect()
    assert [(r.h, r.w) for r in rows] == [(3, 4), (3, 4)]
    assert all(np.array_equal(np.frombuffer(r.payload, np.uint16).reshape(3, 4), a[r.z]) for r in rows)
    with pytest.raises(ValueError):
        I.read_npy_volumes(spark, scratch, "xxz")
    d = os.path.join(scratch, "chunks")
    os.makedirs(d)
    open(os.path.join(d, "0-4_0-3_0-2"), "wb").write(a.tobytes())
    open(os.path.join(d, "4-8_0-3_0-2.gz"), "wb").write(gzip.compress((a + 1).tobytes()))
    got = {(r.z_abs, r.x0): np.frombuffer(r.payload, np.uint16) for r in I.read_chunks(spark, d, "uint16").collect()}
    assert np.array_equal(got[1, 4], (a + 1)[1].ravel()) and len(got) == 4


def test_last_name_counts_and_other_types_are_corrupt(spark, scratch):
    d = os.path.join(scratch, "vol")
    os.makedirs(d)
    pgm = lambda top, px: f"P5 2 1 {top}\n".encode() + px
    for name, data in (("a_0001", pgm(255, b"ab")), ("b_0001", pgm(255, b"cd")), ("a_0002", pgm(255, b"ef")), ("a_0003", pgm(65535, b"abcd"))):
        open(os.path.join(d, name + ".pgm"), "wb").write(data)
    got = {r.z_abs: (r.status, None if r.payload is None else bytes(r.payload)) for r in I.complete_stack(I.read_stack(spark, d, "*.pgm")).collect()}
    assert got == {1: ("ok", b"cd"), 2: ("ok", b"ef"), 3: ("corrupt", None)}


def test_persist_replaces_only_its_partition(spark, scratch):
    mk = lambda run, n: spark.createDataFrame([(run, "d", f"b{i}", i) for i in range(n)], "run_id int, dataset_id string, block_id string, v int")
    K.persist_run({"t": mk(1, 3)}, scratch)
    K.persist_run({"t": mk(2, 5)}, scratch)
    K.persist_run({"t": mk(1, 2).where("v = 1").selectExpr("run_id", "dataset_id", "block_id", "v + 10 AS v")}, scratch)
    got = sorted((r.run_id, r.block_id, r.v) for r in spark.read.parquet(f"{scratch}/t").where("run_id = 1").collect())
    assert got == [(1, "b0", 0), (1, "b1", 11), (1, "b2", 2)]
    assert spark.read.parquet(f"{scratch}/t").where("run_id = 2").count() == 5


def test_export_resumes(spark, scratch):
    planned = spark.createDataFrame([("b", z, z + 4, 4 * 10) for z in (0, 4, 8)], "block_id string, z0 long, z1 long, bytes long")
    sec = spark.createDataFrame([("b", z, bytes([z] * 10)) for z in range(12)], "block_id string, z long, payload binary")
    assert write_export(planned.where("z0 < 8"), sec, f"{scratch}/x")["n_new"] == 2
    assert write_export(planned, sec, f"{scratch}/x")["n_new"] == 1
    assert write_export(planned, sec, f"{scratch}/x")["n_new"] == 0
    sec.limit(1).selectExpr("block_id", "z", "0L AS z0", "4L AS z1", "payload").write.parquet(f"{scratch}/x/sections/attempt=broken")  # broke off before its manifest
    out = read_export(spark, f"{scratch}/x")
    assert out.count() == 12 and out.select("z").distinct().count() == 12


def test_training_pack_layout(spark, scratch):
    idx = spark.createDataFrame([("raw", "slice", "train", "b", 0), ("raw", "patch", "val", "b", 4)], "task string, level string, partition string, block_id string, z0 long")
    K.write_pack(idx, scratch)
    back = spark.read.option("header", "true").csv(f"{scratch}/index")
    assert set(K.INDEX_COLUMNS) <= set(back.columns) and back.count() == 2
    assert spark.read.parquet(f"{scratch}/samples").where("task = 'raw' AND level = 'patch'").count() == 1


def test_lineage_append(spark, scratch):
    row = spark.createDataFrame([("d", "cutout", 10)], "dataset_id string, kind string, n_bytes long")
    K.append_lineage(row, scratch, "serve_log")
    K.append_lineage(row, scratch, "serve_log")
    assert spark.read.parquet(f"{scratch}/serve_log").agg(F.sum("n_bytes")).first()[0] == 20


SCHEMA = "seq bigint, action string, by string"


def test_torn_tail_is_dropped(spark, scratch):
    lines = [json.dumps({"seq": i, "action": "edit", "by": "张三"}, ensure_ascii=False) for i in (1, 2)]
    open(os.path.join(scratch, "a.jsonl"), "w").write("\n".join(lines) + "\n" + '{"seq": 3, "act')
    open(os.path.join(scratch, "b.jsonl"), "w").write(lines[0] + "\n")
    got = sorted((r.seq, r.by) for r in read_json_log(spark, scratch, SCHEMA).collect())
    assert got == [(1, "张三"), (1, "张三"), (2, "张三")]


def test_damage_in_the_middle_is_refused(spark, scratch):
    open(os.path.join(scratch, "a.jsonl"), "w").write('{"seq": 1, "act\n{"seq": 2, "action": "edit", "by": "x"}\n')
    with pytest.raises(Exception, match="damaged log line"):
        read_json_log(spark, scratch, SCHEMA).collect()


def test_damage_that_reads_like_the_tail_is_refused(spark, scratch):
    open(os.path.join(scratch, "a.jsonl"), "w").write('{"seq": 1, "act\n{"seq": 2, "action": "edit", "by": "x"}\n{"seq": 1, "act')
    with pytest.raises(Exception, match="damaged log line"):
        read_json_log(spark, scratch, SCHEMA).collect()


def test_segment_properties_skip_bad_cells(spark):
    doc = {"inline": {"ids": ["9007199254740993", "2", "3"], "properties": [
        {"id": "num_voxels", "type": "number", "values": [10, "x"]}, {"id": "t", "type": "tags", "tags": ["a", "b"], "values": [[0, 1, 7], []]}]}}
    df = spark.createDataFrame([("s", json.dumps(doc))], "source string, doc string")
    rows = {str(r.id): (r.features, r.tags) for r in I.parse_properties(df).collect()}
    assert rows == {"9007199254740993": ({"num_voxels": 10.0}, ["a", "b"]), "2": ({}, []), "3": ({}, [])}


def test_blocks_of_other_datasets_are_no_neighbours(spark):
    from lamella.operators.blocks import face_neighbours

    rows = [("d1", "a", 0, 4, 0, 8, 0, 8), ("d1", "b", 4, 8, 0, 8, 0, 8), ("d2", "b", 4, 8, 0, 8, 0, 8), ("d2", "c", 8, 12, 0, 8, 0, 8)]
    df = spark.createDataFrame(rows, "dataset_id string, block_id string, " + ", ".join(f"{a}_{e} long" for a in "zyx" for e in ("start", "end")))
    got = sorted((r.dataset_id, r.a_block_id, r.b_block_id) for r in face_neighbours(df, {"z": 4, "y": 8, "x": 8}).collect())
    assert got == [("d1", "a", "b"), ("d2", "b", "c")]


def test_a_key_table_is_not_repeated_at_the_driver(spark):
    fact = spark.range(1000).select((F.col("id") * 100 % 200_000).alias("k"), "id")
    for rows in (10, 200_000):
        dim = spark.range(rows).select(F.col("id").alias("d"), (F.col("id") * 2).alias("v"))
        j = T.spread_by(fact, dim, "k", "d", "id")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert not ("BroadcastExchange" in plan and "Generate" in plan)  # 32 copies of each row were collected before
        want = [(i, i * 100 % 200_000) for i in range(1000) if i * 100 % 200_000 < rows]
        assert sorted((r.id, r.v // 2) for r in j.collect()) == want and set(j.columns) == {"k", "id", "d", "v"}


def test_faces_are_not_sent_to_all_tasks(spark):
    b = spark.range(64).select(F.concat(F.lit("b"), "id").alias("block_id"), *[e.cast("long").alias(n) for a, i in (("z", F.col("id") % 4), ("y", F.floor(F.col("id") / 4) % 4), ("x", F.floor(F.col("id") / 16)))
                                                                              for n, e in ((f"{a}_start", i * 100), (f"{a}_end", i * 100 + 100))])
    j = B.face_neighbours(b, {"z": 32, "y": 32, "x": 32})
    assert "BroadcastExchange" not in j._jdf.queryExecution().executedPlan().toString()  # blocks repeated per cell were, three times
    assert j.count() == j.distinct().count() == 3 * 3 * 16
