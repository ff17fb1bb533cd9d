"""Image volumes as a data source: spark.read.format("volume").option("kind", ...).load(folder).

One row per piece of a section: a box (y0..y1, x0..x1) of section z with its bytes. Partitions are planned before anything is read:
ranges of sections of an array file (its header is read by range, pixels are read by offset), chunk files of a chunk grid, files
of an image stack; each reads about `partition_bytes` at a time. Many small ones share a partition, so tasks do not grow in number with the
volumes (`most`), up to 64 MB. Filters on z, y0, y1, x0, x1 and dataset_id prune partitions and pieces. A file that cannot be read or decoded is a row with status corrupt. sections() puts pieces together.

kind "npy": array files of three axes, option axes (zyx). Where sections are not contiguous in the file, partitions are slabs along its slowest
axis and every piece is the part of a section that lies in the slab, so each byte is read once.
kind "chunks": folders with an `info` document and raw (optionally gzipped) chunk files `x0-x1_y0-y1_z0-z1`.
kind "stack": folders of one image per section, the last integer of the name is its number; decoder "module:function", PGM by default."""
from __future__ import annotations

import ast
import bisect
import gzip
import importlib
import json
import re
import struct
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..operators.ordered import range_rows

PIECES = ("dataset_id string, z long, z_abs long, y0 long, y1 long, x0 long, x1 long, h long, w long, n_z long, z_offset long, dtype string, status string, "
          "payload binary, path string, error string")
NAMES = [c.split()[0] for c in PIECES.split(", ")]
_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
_ARROW = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in PIECES.split(", ")])
_CHUNK = re.compile(r"(\d+)-(\d+)_(\d+)-(\d+)_(\d+)-(\d+)(\.gz)?")
_IMAGE = re.compile(r"(?i)\.(png|tif|tiff|jpg|jpeg|bmp|pgm)$")


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or of a plain path."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _files(uri: str) -> list[fs.FileInfo]:
    """All files below a folder (or the file itself), by path."""
    system, path = opened(uri)
    info = system.get_file_info(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(".")), key=lambda f: f.path)


def _bytes(uri: str, path: str, start: int = 0, length: int | None = None) -> bytes:
    system, _ = opened(uri)
    with system.open_input_file(path) as f:
        data = f.read_at(f.size() - start if length is None else length, start)
    if length is not None and len(data) != length:
        raise EOFError(f"{length} bytes at {start}: only {len(data)} there")
    return data


class Box:
    """Some pieces of one volume, read together: what to read, the range of sections it lies in, and its bytes."""

    def __init__(self, volume: dict, items: list, z0: int, z1: int, size: int):
        self.volume, self.items, self.z0, self.z1, self.size = volume, items, z0, z1, size


class Boxes(InputPartition):
    """The boxes of one task, read one after another."""

    def __init__(self, boxes: list[Box]):
        self.boxes = boxes


_FULL, _OPEN = 64 << 20, 1 << 16  # bytes of a partition; what opening a file weighs, in bytes
_BATCH = 1 << 20  # bytes that leave a worker at once


def _dealt(boxes: list[Box], most: int) -> list[Boxes]:
    """Neighbouring boxes share a partition: as many as make about `most` partitions of all, but no more once they weigh 64 MB."""
    weight = lambda b: b.size + _OPEN * len(b.items)
    full = min(_FULL, sum(map(weight, boxes)) // max(1, most))
    out, group, held = [], [], 0
    for b in boxes:
        if group and held + weight(b) > full:
            out.append(Boxes(group))
            group, held = [], 0
        group.append(b)
        held += weight(b)
    return out + [Boxes(group)] * bool(group)


def _each(fn, items: list) -> list:
    """`fn` of each item; small reads of the planner wait for the file system together."""
    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(fn, items))


def npy_header(uri: str, path: str) -> dict:
    """Type, shape, order and data offset of an array file, from its first bytes."""
    head = _bytes(uri, path, 0, 10)
    if head[:6] != b"\x93NUMPY":
        raise ValueError(f"{path}: not an array file")
    long = head[6] > 1
    size = struct.unpack("<I", _bytes(uri, path, 8, 4))[0] if long else struct.unpack("<H", head[8:10])[0]
    at = 12 if long else 10
    d = ast.literal_eval(_bytes(uri, path, at, size).decode("latin-1" if head[6] < 3 else "utf-8"))
    dtype = np.dtype(d["descr"])
    if dtype.hasobject or len(d["shape"]) != 3:
        raise ValueError(f"{path}: expected a 3-D array of numbers, got {d['descr']} {d['shape']}")
    return {"dtype": dtype, "shape": d["shape"], "fortran": d["fortran_order"], "offset": at + size}


def _npy_partitions(uri: str, options: dict, size: int) -> list[Box]:
    axes = options.get("axes", "zyx").lower()
    if sorted(axes) != ["x", "y", "z"]:
        raise ValueError("axes must be a permutation of xyz")
    out = []
    files = [f for f in _files(uri) if f.base_name.endswith(".npy")]
    for f, h in zip(files, _each(lambda f: npy_header(uri, f.path), files), strict=True):
        order = axes[::-1] if h["fortran"] else axes  # slowest axis first
        extent = dict(zip(axes, h["shape"], strict=True))
        slow, row = order[0], h["dtype"].itemsize * int(np.prod([extent[a] for a in order[1:]]))
        volume = {"kind": "npy", "dataset_id": f.base_name[:-4], "path": f.path, "order": order, "extent": extent, "dtype": h["dtype"].str, "offset": h["offset"], "row": row,
                  "h": extent["y"], "w": extent["x"], "n_z": extent["z"], "z_offset": 0}
        step = max(1, size // max(1, row))
        for a in range(0, extent[slow], step):
            b = min(a + step, extent[slow])
            out.append(Box(volume, [(a, b)], *((a, b) if slow == "z" else (0, extent["z"])), (b - a) * row))
    return out


def _chunk_partitions(uri: str, options: dict, size: int) -> list[Box]:
    files = _files(uri)
    paths = [f.path for f in files]  # sorted: a folder's files are one range
    out = []
    infos = [f for f in files if f.base_name == "info"]
    for info, text in zip(infos, _each(lambda f: _bytes(uri, f.path), infos), strict=True):
        root = info.path.rpartition("/")[0]
        meta = json.loads(text)
        scale = meta["scales"][0]
        if scale.get("encoding", "raw") != "raw":
            raise ValueError(f"{info.path}: encoding {scale['encoding']} is not supported")
        (sx, sy, sz), (ox, oy, oz) = scale["size"], scale.get("voxel_offset", [0, 0, 0])
        dtype = np.dtype(meta["data_type"])
        volume = {"kind": "chunks", "dataset_id": root.rpartition("/")[2], "dtype": dtype.str, "channels": int(meta.get("num_channels", 1)), "h": sy, "w": sx, "n_z": sz, "z_offset": oz, "y": oy, "x": ox}
        layers: dict[tuple, list] = {}
        inside = f"{root}/{scale['key']}"
        for f in files[bisect.bisect_left(paths, inside + "/") : bisect.bisect_left(paths, inside + "0")]:  # "0" comes next to "/"
            if m := _CHUNK.fullmatch(f.base_name):
                x0, x1, y0, y1, z0, z1 = (int(v) for v in m.groups()[:6])
                layers.setdefault((z0, z1), []).append((f.path, (z0, z1, y0 - oy, y1 - oy, x0 - ox, x1 - ox)))
        for (z0, z1), chunks in sorted(layers.items()):
            group, held = [], 0
            for path, box in chunks:
                group.append((path, box))
                held += (z1 - z0) * (box[3] - box[2]) * (box[5] - box[4]) * dtype.itemsize
                if held >= size:
                    out.append(Box(volume, group, z0 - oz, z1 - oz, held))
                    group, held = [], 0
            if group:
                out.append(Box(volume, group, z0 - oz, z1 - oz, held))
    return out


def _stack_partitions(uri: str, options: dict, size: int) -> list[Box]:
    stacks: dict[str, dict[int, fs.FileInfo]] = {}
    want = re.compile(options["pattern"]) if "pattern" in options else None
    for f in _files(uri):
        number = re.search(r"(\d+)\D*$", f.base_name.rpartition(".")[0])
        if _IMAGE.search(f.base_name) and number and (want is None or want.search(f.base_name)):
            stacks.setdefault(f.path.rpartition("/")[0], {})[int(number[1])] = f  # of two files with one number the last name counts
    out = []
    for folder, files in stacks.items():
        first, last = min(files), max(files)
        volume = {"kind": "stack", "dataset_id": folder.rpartition("/")[2], "decoder": options.get("decoder", "lamella.sources.imagestack:decode_pgm"), "n_z": last - first + 1, "z_offset": first}
        group, held = [], 0
        for z, f in sorted(files.items()):
            group.append((z, f.path))
            held += f.size
            if held >= size or z == last:
                out.append(Box(volume, group, group[0][0] - first, z - first + 1, held))
                group, held = [], 0
    return out


_PLANS = {"npy": _npy_partitions, "chunks": _chunk_partitions, "stack": _stack_partitions}


def _row(volume: dict, z: int, **more) -> dict:
    base = {"dataset_id": volume["dataset_id"], "z": z, "z_abs": z + volume["z_offset"], "h": volume.get("h"), "w": volume.get("w"), "n_z": volume["n_z"], "z_offset": volume["z_offset"], "dtype": volume.get("dtype")}
    return base | more


def _npy_pieces(uri: str, part: Box, wanted):
    v, (a, b) = part.volume, part.items[0]
    dtype, order = np.dtype(v["dtype"]), v["order"]
    data = np.frombuffer(_bytes(uri, v["path"], v["offset"] + a * v["row"], (b - a) * v["row"]), dtype).reshape([b - a, *(v["extent"][x] for x in order[1:])])
    planes = data.transpose([order.index(x) for x in "zyx"])
    lo = {x: a if x == order[0] else 0 for x in "zyx"}
    for k in range(planes.shape[0]):
        z = lo["z"] + k
        box = {"y0": lo["y"], "y1": lo["y"] + planes.shape[1], "x0": lo["x"], "x1": lo["x"] + planes.shape[2]}
        if wanted(v["dataset_id"], z, box):
            yield _row(v, z, **box, status="ok", payload=np.ascontiguousarray(planes[k]).tobytes(), path=v["path"])


def _chunk_pieces(uri: str, part: Box, wanted):
    v = part.volume
    for path, (z0, z1, y0, y1, x0, x1) in part.items:
        box = {"y0": y0, "y1": y1, "x0": x0, "x1": x1}
        zs = [z for z in range(z0 - v["z_offset"], z1 - v["z_offset"]) if wanted(v["dataset_id"], z, box)]
        if not zs:
            continue
        try:
            raw = _bytes(uri, path)
            raw = gzip.decompress(raw) if path.endswith(".gz") else raw
            a = np.frombuffer(raw, v["dtype"]).reshape(v["channels"], z1 - z0, y1 - y0, x1 - x0)
        except Exception as e:  # noqa: BLE001 - whatever is wrong with a chunk, its sections are corrupt and the others go on
            yield from (_row(v, z, **box, status="corrupt", path=path, error=f"{type(e).__name__}: {e}") for z in zs)
            continue
        for z in zs:
            yield _row(v, z, **box, status="ok", payload=a[0, z + v["z_offset"] - z0].tobytes(), path=path)


def _stack_pieces(uri: str, part: Box, wanted):
    v = part.volume
    module, _, name = v["decoder"].partition(":")
    decode = getattr(importlib.import_module(module), name)
    for number, path in part.items:
        z = number - v["z_offset"]
        if not wanted(v["dataset_id"], z, {}):
            continue
        try:
            a = decode(_bytes(uri, path))
            if a.ndim != 2:
                raise ValueError(f"shape {a.shape}")
            yield _row(v, z, y0=0, y1=a.shape[0], x0=0, x1=a.shape[1], h=a.shape[0], w=a.shape[1], dtype=a.dtype.str, status="ok", payload=np.ascontiguousarray(a).tobytes(), path=path)
        except Exception as e:  # noqa: BLE001 - any decoder failure means this one file is corrupt
            yield _row(v, z, status="corrupt", path=path, error=f"{type(e).__name__}: {e}")


_READ = {"npy": _npy_pieces, "chunks": _chunk_pieces, "stack": _stack_pieces}
_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.uri = self.options["path"]
        self.filters: list[tuple] = []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("z",), ("y0",), ("y1",), ("x0",), ("x1",), ("dataset_id",)):
                self.filters.append((f.attribute[0], type(f), getattr(f, "value", None)))
            yield f  # Spark applies them again: pruning only has to keep what may pass

    def _may(self, column: str, value) -> bool:
        return value is None or all(_TESTS[kind](value, want) for c, kind, want in self.filters if c == column)

    def partitions(self):
        size = int(self.options.get("partition_bytes", 64 << 20))
        parts = _PLANS[self.options["kind"]](self.uri, self.options, size)
        parts = [p for p in parts if self._may("dataset_id", p.volume["dataset_id"]) and any(self._may("z", z) for z in range(p.z0, p.z1))]
        return _dealt(parts, int(self.options.get("most", 256))) or [Boxes([])]

    def read(self, partition):
        wanted = lambda name, z, box: self._may("dataset_id", name) and self._may("z", z) and all(self._may(c, v) for c, v in box.items())
        rows, held = [], 0
        for piece in (p for box in partition.boxes for p in _READ[self.options["kind"]](self.uri, box, wanted)):
            rows.append({c: piece.get(c) for c in NAMES})
            held += len(piece.get("payload") or b"") + 1024
            if held >= _BATCH:  # a large piece leaves the worker by itself
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class VolumeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "volume"

    def schema(self) -> str:
        return PIECES

    def reader(self, schema) -> VolumeReader:
        return VolumeReader(dict(self.options))


def pieces(spark: SparkSession, folder: str, kind: str, **options) -> DataFrame:
    """The pieces of all volumes below `folder`."""
    spark.dataSource.register(VolumeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"most": max(64, 4 * spark.sparkContext.defaultParallelism)} | options
    return spark.read.format("volume").options(kind=kind, **{k: str(v) for k, v in options.items()}).load(folder)


SECTION = "dataset_id string, z long, z_abs long, status string, h long, w long, dtype string, payload binary, error string"


def sections(found: DataFrame) -> DataFrame:
    """One row per section of each volume. Boxes without a piece are zero; a section without any is missing, one with a corrupt piece corrupt;
    a plane whose shape or type differs from its volume's first readable section is corrupt. A group is one section's pieces."""
    whole = found.groupBy("dataset_id").agg(F.max("n_z").alias("n_z"), F.min("z_offset").alias("z_offset"), F.min(F.when(F.col("status") == "ok", F.struct("z", "h", "w", "dtype"))).alias("p"))
    whole = whole.select("dataset_id", "n_z", "z_offset", F.col("p.h").alias("_h"), F.col("p.w").alias("_w"), F.col("p.dtype").alias("_dtype"))
    grid = range_rows(whole, F.lit(0), F.col("n_z"), 1, "z").select("dataset_id", "z", (F.col("z") + F.col("z_offset")).alias("z_abs"), "_h", "_w", "_dtype")
    j = grid.join(found.select("dataset_id", "z", "y0", "y1", "x0", "x1", "h", "w", "dtype", "status", "payload", "error"), ["dataset_id", "z"], "left")
    odd = (F.col("h") != F.col("_h")) | (F.col("w") != F.col("_w")) | (F.col("dtype") != F.col("_dtype"))
    j = j.withColumn("error", F.when((F.col("status") == "ok") & odd, "shape or type differs").otherwise(F.col("error")))
    j = j.withColumn("status", F.when((F.col("status") == "ok") & odd, "corrupt").otherwise(F.coalesce("status", F.lit("missing")))).drop("_h", "_w", "_dtype")

    def put(pdf):
        first = pdf.iloc[0]
        bad = pdf["status"] != "ok"
        out = {"dataset_id": first["dataset_id"], "z": first["z"], "z_abs": first["z_abs"], "status": "ok", "h": None, "w": None, "dtype": None, "payload": None, "error": None}
        if bad.any():
            worst = pdf[bad].sort_values(["status", "y0", "x0"]).iloc[0]
            out |= {"status": worst["status"], "error": worst["error"]}
        else:
            h, w, dtype = int(first["h"]), int(first["w"]), np.dtype(first["dtype"])
            plane = np.zeros((h, w), dtype)
            for r in pdf.itertuples():
                plane[int(r.y0) : int(r.y1), int(r.x0) : int(r.x1)] = np.frombuffer(r.payload, dtype).reshape(int(r.y1 - r.y0), int(r.x1 - r.x0))
            out |= {"h": h, "w": w, "dtype": dtype.str, "payload": plane.tobytes()}
        return type(pdf)([out])

    return j.groupBy("dataset_id", "z").applyInPandas(put, SECTION)
