"""The volume source against arrays in memory: planned partitions, byte ranges, pruning, damaged files."""
import gzip
import json
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.plans.label_runs import HEIGHT, WIDTH
from lamella.plans.volumes import _written
from lamella.sources import volumes as V


def planes(spark, folder, kind, **options):
    rows = V.sections(V.pieces(spark, folder, kind, **options)).collect()
    assert len({(r.dataset_id, r.z) for r in rows}) == len(rows)
    return {(r.dataset_id, r.z): (r.status, None if r.payload is None else np.frombuffer(r.payload, r.dtype).reshape(r.h, r.w)) for r in rows}


@pytest.mark.parametrize("axes", ["zyx", "xyz", "yxz", "zxy"])
@pytest.mark.parametrize("fortran", [False, True])
def test_array_files_of_any_axis_order(spark, scratch, axes, fortran):
    a = np.arange(5 * 7 * 11, dtype=">u2").reshape(5, 7, 11)  # z, y, x
    stored = a.transpose(["zyx".index(c) for c in axes])
    np.save(os.path.join(scratch, "em.npy"), np.asfortranarray(stored) if fortran else np.ascontiguousarray(stored))
    got = planes(spark, scratch, "npy", axes=axes, partition_bytes=200)
    assert set(got) == {("em", z) for z in range(5)} and all(s == "ok" and (p == a[z]).all() for (_, z), (s, p) in got.items())


def test_partitions_are_planned_and_pruned(spark, scratch):
    np.save(os.path.join(scratch, "a.npy"), np.zeros((40, 8, 8), np.uint8))
    p = V.pieces(spark, scratch, "npy", partition_bytes=64 * 4)
    assert p.rdd.getNumPartitions() == 10
    q = p.where("z >= 10 AND z < 13").select("z")
    assert q.rdd.getNumPartitions() == 2 and sorted(r.z for r in q.collect()) == [10, 11, 12]
    with pytest.raises(Exception, match="permutation"):
        V.pieces(spark, scratch, "npy", axes="zyy").count()


def test_chunk_grid_with_absent_and_damaged_chunks(spark, scratch):
    vol = np.random.default_rng(0).integers(1, 255, (8, 6, 4), dtype=np.uint8)
    info = {"data_type": "uint8", "num_channels": 1, "scales": [{"key": "s", "encoding": "raw", "size": [4, 6, 8], "chunk_sizes": [[4, 3, 4]], "voxel_offset": [10, 20, 30]}]}
    os.makedirs(os.path.join(scratch, "v", "s"))
    with open(os.path.join(scratch, "v", "info"), "w") as f:
        json.dump(info, f)

    def put(y0, z0, data):
        name = os.path.join(scratch, "v", "s", f"10-14_{20 + y0}-{23 + y0}_{30 + z0}-{34 + z0}" + (".gz" if z0 else ""))
        with open(name, "wb") as f:
            f.write(gzip.compress(data) if z0 else data)
        return name

    names = {(y0, z0): put(y0, z0, vol[z0 : z0 + 4, y0 : y0 + 3].tobytes()) for y0 in (0, 3) for z0 in (0, 4)}
    got = planes(spark, scratch, "chunks", partition_bytes=30)
    assert all((got["v", z][1] == vol[z]).all() for z in range(8))
    os.remove(names[0, 0])
    put(3, 4, b"no gzip"[:3])
    got = planes(spark, scratch, "chunks")
    assert all((got["v", z][1][:3] == 0).all() and (got["v", z][1][3:] == vol[z, 3:]).all() for z in range(4))
    assert all(got["v", z][0] == "corrupt" for z in range(4, 8))
    os.remove(names[3, 0])
    assert all(planes(spark, scratch, "chunks")["v", z][0] == "missing" for z in range(4))
    box = V.pieces(spark, scratch, "chunks").where("y0 >= 3 AND z = 5").collect()
    assert [(r.z, r.y0, r.status) for r in box] == [(5, 3, "corrupt")]


def test_image_stack_with_gaps_odd_shapes_and_broken_files(spark, scratch):
    d = os.path.join(scratch, "vol")
    os.makedirs(d)
    for name, data in (("s_003", b"P5 2 1 255\nab"), ("s_004", b"P5 2 1 255\ncd"), ("s_006", b"P5 1 1 255\ne"), ("s_007", b"P5 2"), ("s_008", b"P5 2 1 255\nfg"), ("t_008", b"P5 2 1 255\nhi")):
        with open(os.path.join(d, name + ".pgm"), "wb") as f:
            f.write(data)
    got = planes(spark, scratch, "stack", partition_bytes=20)
    assert [got["vol", z][0] for z in range(6)] == ["ok", "ok", "missing", "corrupt", "corrupt", "ok"]
    assert got["vol", 5][1].tobytes() == b"hi" and got["vol", 0][1].tobytes() == b"ab"


@pytest.mark.parametrize("kind", ["npy", "chunks"])
def test_many_small_volumes_share_partitions(spark, scratch, kind):
    """Tasks do not grow in number with the volumes, whatever is read at a time; every section still comes, filters still prune."""
    for v in range(30):
        a = np.full((4, 2, 2), v + 1, np.uint8)
        if kind == "npy":
            np.save(os.path.join(scratch, f"v{v:02d}.npy"), a)
            continue
        os.makedirs(os.path.join(scratch, f"v{v:02d}", "s"))
        with open(os.path.join(scratch, f"v{v:02d}", "info"), "w") as f:
            json.dump({"data_type": "uint8", "scales": [{"key": "s", "size": [2, 2, 4]}]}, f)
        for z in (0, 2):
            with open(os.path.join(scratch, f"v{v:02d}", "s", f"0-2_0-2_{z}-{z + 2}"), "wb") as f:
                f.write(a[:2].tobytes())
    p = V.pieces(spark, scratch, kind, partition_bytes=8, most=6)
    assert 3 <= p.rdd.getNumPartitions() <= 8
    assert p.where("dataset_id = 'v07'").rdd.getNumPartitions() == 2
    got = planes(spark, scratch, kind, partition_bytes=8, most=6)
    assert len(got) == 120 and all(s == "ok" and (a == int(name[1:]) + 1).all() for (name, _), (s, a) in got.items())


def test_chunk_plans_read_each_path_once(scratch, monkeypatch):
    """The files of one volume are a range of the sorted paths: no pass over all files for each volume."""
    seen = []

    class Pattern:
        def fullmatch(self, name):
            seen.append(name)

    for v in range(20):
        os.makedirs(os.path.join(scratch, f"v{v}", "s"))
        with open(os.path.join(scratch, f"v{v}", "info"), "w") as f:
            json.dump({"data_type": "uint8", "scales": [{"key": "s", "size": [1, 1, 1]}]}, f)
        open(os.path.join(scratch, f"v{v}", "s", "0-1_0-1_0-1"), "wb").close()
    monkeypatch.setattr(V, "_CHUNK", Pattern())
    V._chunk_partitions(scratch, {}, 8)
    assert len(seen) == 20


def test_strokes_become_planes_in_one_stream(spark):
    """Strokes of a volume come in many batches and out of order; the newest stays on every pixel, and nothing of one volume shows in the next."""
    strokes = [("ds0", f"b{b}", 1 + (k * 5 + b) % 7, (k * 7) % 9, (k * 3) % 11, (k * 3) % 11 + 1 + k % 6, (k * 37) % 101 + 1, k % 7 + 1) for b in range(3) for k in range(101)]
    log = spark.createDataFrame(strokes, "dataset string, block string, z long, y long, x0 long, x1 long, n long, id long")
    want = {}
    for _, b, z, y, x0, x1, _, i in sorted(strokes, key=lambda s: s[6]):
        want.setdefault(b, np.zeros((7, HEIGHT, WIDTH), np.uint8))[z - 1, y, x0:x1] = i
    expected = {(b, z): want[b][z - 1].tobytes() for b in want for z in range(1, 8)}

    def write(folder, name, z, planes):
        for k, plane in enumerate(planes):
            path = f"{folder}/{name}-{z + k}"
            assert not os.path.exists(path)
            with open(path, "wb") as f:
                f.write(plane.tobytes())

    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        for by_plane in (False, True):
            folder = tempfile.mkdtemp(prefix="lamella-test-", dir="/tmp")
            _written(log.orderBy(F.col("n").desc()), folder, write, by_plane=by_plane)
            got = {}
            for name in os.listdir(folder):
                block, z = name.removeprefix("ds0_").split("-")
                got[block, int(z)] = open(f"{folder}/{name}", "rb").read()
            assert got == expected
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
