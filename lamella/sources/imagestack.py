"""Section sources: image stacks, array volumes, raw chunk grids, and the metadata views over them."""
from __future__ import annotations

import gzip
import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import range_rows

IMAGE_SUFFIX = r"(?i)\.(png|tif|tiff|jpg|jpeg|bmp|pgm)$"


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def last_integer(stem: Column) -> Column:
    """Section number of a file: the last integer of its stem, NULL without one."""
    n = F.regexp_extract(stem, r"(\d+)\D*$", 1)
    return F.when(n != "", n.cast("bigint"))


def section_index(files: DataFrame, key: str, stem: str = "stem") -> DataFrame:
    """(key, z_abs) -> z, path and status for every z between the first and the last file of a stack.

    Gaps become rows with status missing; of two files with one number the last name wins."""
    f = files.withColumn("z_abs", last_integer(F.col(stem))).where("z_abs IS NOT NULL")
    f = f.groupBy(key, "z_abs").agg(F.max("path").alias("path"))
    span = f.groupBy(key).agg(F.min("z_abs").alias("_lo"), (F.max("z_abs") + 1).alias("_hi"))
    grid = range_rows(span, F.col("_lo"), F.col("_hi"), 1, "z_abs").select(key, "z_abs", (F.col("z_abs") - F.col("_lo")).alias("z"))
    return grid.join(f, [key, "z_abs"], "left").withColumn("status", F.when(F.col("path").isNull(), "missing").otherwise("ok"))


def decode_pgm(data: bytes) -> np.ndarray:
    """Binary PGM (8 or 16 bit), the one image codec that needs nothing but NumPy. Other codecs plug in as `decoder`."""
    head, pos = [], 0
    while len(head) < 4:
        if pos >= len(data):
            raise ValueError("truncated PGM header")
        end = pos
        while end < len(data) and data[end:end + 1] not in (b" ", b"\n", b"\t", b"\r"):
            end += 1
        tok = data[pos:end]
        if tok.startswith(b"#"):
            pos = data.index(b"\n", pos) + 1  # a missing line end is a ValueError too
            continue
        if tok:
            head.append(tok)
        pos = end + 1
        if head and head[0] != b"P5":
            raise ValueError("not a binary PGM")
    w, h, top = (int(v) for v in head[1:])
    a = np.frombuffer(data, dtype=">u2" if top > 255 else "u1", offset=pos)
    return a[: h * w].reshape(h, w).astype(np.uint16 if top > 255 else np.uint8)


def decode_npy(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


STACK_SCHEMA = "dataset_id string, z_abs long, path string, status string, h int, w int, dtype string, payload binary, error string"


def read_stack(spark: SparkSession, root: str, pattern: str = "*", decoder=decode_pgm, expected: tuple[int, int] | None = None) -> DataFrame:
    """Decode an image stack directory tree in parallel, one row per file: raw pixels or the reason it is corrupt.

    The dataset is the parent directory. A bad file never fails the job."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    parent = F.element_at(F.split("path", "/"), -2)
    f = files.select(parent.alias("dataset_id"), last_integer(file_stem(F.col("path"))).alias("z_abs"), "path", "content").where("z_abs IS NOT NULL")

    def run(batches):
        for pdf in batches:
            rows = []
            for ds, z, path, data in zip(pdf["dataset_id"], pdf["z_abs"], pdf["path"], pdf["content"]):
                try:
                    a = decoder(bytes(data))
                    if a.ndim != 2 or (expected and a.shape != expected):
                        raise ValueError(f"shape {a.shape}")
                    rows.append((ds, z, path, "ok", a.shape[0], a.shape[1], str(a.dtype), np.ascontiguousarray(a).tobytes(), None))
                except Exception as e:  # noqa: BLE001 - any decoder failure means this one file is corrupt
                    rows.append((ds, z, path, "corrupt", None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in STACK_SCHEMA.split(", ")])

    return f.mapInPandas(run, STACK_SCHEMA)


def complete_stack(decoded: DataFrame) -> DataFrame:
    """One row per section: of several files with one number the last name counts, a number without a file is missing, and a file
    whose shape or type differs from the stack's first readable section is corrupt."""
    last = decoded.groupBy("dataset_id", "z_abs").agg(F.max("path").alias("path"))
    decoded = decoded.join(last, ["dataset_id", "z_abs", "path"], "left_semi")
    first = decoded.where("status = 'ok'").groupBy("dataset_id").agg(F.min(F.struct("z_abs", "h", "w", "dtype")).alias("p"))
    span = decoded.groupBy("dataset_id").agg(F.min("z_abs").alias("_lo"), (F.max("z_abs") + 1).alias("_hi"))
    grid = range_rows(span, F.col("_lo"), F.col("_hi"), 1, "z_abs")
    j = grid.join(decoded, ["dataset_id", "z_abs"], "left").join(first, "dataset_id", "left")
    odd = (F.col("h") != F.col("p.h")) | (F.col("w") != F.col("p.w")) | (F.col("dtype") != F.col("p.dtype"))
    status = F.when(F.col("status").isNull(), "missing").when((F.col("status") == "ok") & odd, "corrupt").otherwise(F.col("status"))
    return j.select("dataset_id", (F.col("z_abs") - F.col("_lo")).alias("z"), "z_abs", status.alias("status"), "h", "w", "dtype", F.when(status == "ok", F.col("payload")).alias("payload"), "error")


def read_npy_volumes(spark: SparkSession, root: str, axes: str = "zyx") -> DataFrame:
    """Array files of any axis order as one row per section: dataset_id, z, h, w, dtype, payload."""
    axes = axes.lower()
    if sorted(axes) != ["x", "y", "z"]:
        raise ValueError("axes must be a permutation of xyz")
    order = [axes.index(a) for a in "zyx"]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(root)

    def run(batches):
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"]):
                a = np.load(io.BytesIO(bytes(data)), allow_pickle=False)
                if a.ndim != 3:
                    raise ValueError(f"{path}: expected a 3-D array, got shape {a.shape}")
                v = np.transpose(a, order)
                name = path.rsplit("/", 1)[-1][:-4]
                for z in range(v.shape[0]):  # one section at a time leaves the worker
                    yield pd.DataFrame([(name, z, v.shape[1], v.shape[2], str(a.dtype), np.ascontiguousarray(v[z]).tobytes())], columns=["dataset_id", "z", "h", "w", "dtype", "payload"])

    return files.select("path", "content").mapInPandas(run, "dataset_id string, z long, h int, w int, dtype string, payload binary")


def chunk_index(names: DataFrame) -> DataFrame:
    """Chunk files `x0-x1_y0-y1_z0-z1[.gz]` as half-open boxes."""
    m = r"^(\d+)-(\d+)_(\d+)-(\d+)_(\d+)-(\d+)(\.gz)?$"
    n = names.where(F.col("name").rlike(m))
    cols = ["cx0", "cx1", "cy0", "cy1", "cz0", "cz1"]
    return n.select("*", *[F.regexp_extract("name", m, i + 1).cast("bigint").alias(c) for i, c in enumerate(cols)], F.col("name").endswith(".gz").alias("gz"))


def section_chunk_status(volumes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per (dataset, z): number of chunks present. A section is missing only when none is; absent chunks read as 0.

    Every chunk is expanded over its own few z values, which turns the range join into an equality join."""
    z = range_rows(chunks, F.col("cz0"), F.col("cz1"), 1, "z_abs").groupBy("dataset_id", "z_abs").agg(F.count(F.lit(1)).alias("n_chunks"))
    grid = range_rows(volumes, F.col("z_lo"), F.col("z_hi"), 1, "z_abs").select("dataset_id", "z_abs", (F.col("z_abs") - F.col("z_lo")).alias("z"))
    j = grid.join(z, ["dataset_id", "z_abs"], "left").fillna(0, ["n_chunks"])
    return j.withColumn("status", F.when(F.col("n_chunks") == 0, "missing").otherwise("ok"))


def read_chunks(spark: SparkSession, root: str, dtype: str) -> DataFrame:
    """Raw chunk files as one row per (chunk, z): box and plane bytes; gz files are unpacked."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).withColumn("name", F.substring_index("path", "/", -1))
    idx = chunk_index(files.select("name", "content"))

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                raw = gzip.decompress(bytes(r.content)) if r.gz else bytes(r.content)
                a = np.frombuffer(raw, dtype=dtype).reshape(r.cz1 - r.cz0, r.cy1 - r.cy0, r.cx1 - r.cx0)
                yield pd.DataFrame([(r.cz0 + k, r.cy0, r.cy1, r.cx0, r.cx1, a[k].tobytes()) for k in range(a.shape[0])], columns=["z_abs", "y0", "y1", "x0", "x1", "payload"])

    return idx.drop("name").mapInPandas(run, "z_abs long, y0 long, y1 long, x0 long, x1 long, payload binary")


def read_cutout(sections: DataFrame, z0: int, z1: int, value: str, fill, key: str = "block_id") -> DataFrame:
    """Sections z0..z1-1 of every key; missing or corrupt ones carry `fill`."""
    if not 0 <= z0 < z1:
        raise ValueError(f"cutout out of bounds: [{z0}, {z1})")
    keys = sections.groupBy(key).agg(F.lit(z0).alias("_a"), F.lit(z1).alias("_b"))
    grid = range_rows(keys, F.col("_a"), F.col("_b"), 1, "z").select(key, "z")
    s = sections.where((F.col("z") >= z0) & (F.col("z") < z1) & (F.col("status") == "ok")).select(key, "z", F.col(value).alias("_v"))
    return grid.join(s, [key, "z"], "left").select(key, "z", F.coalesce("_v", F.lit(fill)).alias(value))


def parse_properties(docs: DataFrame, json_col: str = "doc", key: str = "source") -> DataFrame:
    """Segment-properties documents -> one row per segment: id, features map, tags.

    The document holds parallel arrays; they are zipped and exploded once. Unparsable cells and tag numbers out of range are skipped."""
    schema = "inline struct<ids: array<string>, properties: array<struct<id: string, description: string, type: string, tags: array<string>, values: array<string>>>>"
    d = docs.select(key, F.from_json(json_col, schema).alias("d")).select(key, "d.inline.*")
    num = F.filter("properties", lambda p: p["type"] == "number")
    tag = F.get(F.filter("properties", lambda p: p["type"] == "tags"), F.lit(0))
    rows = d.select(key, num.alias("num"), tag.alias("tag"), F.posexplode("ids").alias("i", "sid"))
    cells = F.filter(F.transform("num", lambda p: F.struct(F.coalesce(p["id"], p["description"], F.lit("value")).alias("k"), F.try_element_at(p["values"], F.col("i") + 1).try_cast("double").alias("v"))), lambda c: c["v"].isNotNull())
    numbers = F.from_json(F.coalesce(F.try_element_at(F.col("tag.values"), F.col("i") + 1), F.lit("[]")), "array<int>")
    names = F.transform(F.filter(F.coalesce(numbers, F.array().cast("array<int>")), lambda t: (t >= 0) & (t < F.size("tag.tags"))), lambda t: F.get(F.col("tag.tags"), t))
    return rows.select(key, F.col("sid").cast("decimal(20,0)").alias("id"), F.map_from_entries(cells).alias("features"), F.coalesce(names, F.array().cast("array<string>")).alias("tags"))


def select_segments(segments: DataFrame, tag: str | None, min_size: float, size_key: str, top: int) -> DataFrame:
    """Largest segments with a tag and a minimum size."""
    size = F.coalesce(F.try_element_at(F.col("features"), F.lit(size_key)), F.lit(0.0))
    s = segments.withColumn("size", size)
    if tag is not None:
        s = s.where(F.array_contains("tags", tag))
    if min_size:
        s = s.where(F.col("size") >= min_size)
    return s.orderBy(F.col("size").desc(), "id").limit(top)


MANIFEST_SCHEMA = """dataset_id string, name string, species string, brain_region string, voxel_size_nm array<double>, voxel_size array<double>, resolution array<double>, staining string,
 imaging_modality string, modality string, acquisition_batch string, batch string, size_class string, z_offset bigint, em struct<path: string, format: string, axes: string, fill_value: double>,
 assets array<struct<type: string, path: string, format: string, version: string>>, versions map<string, string>, extra map<string, string>"""
# fixed values: conventional names of asset directories and of the image directory
ASSET_NAMES = {
    "gt_segmentation": ("gt", "ground_truth", "groundtruth", "seg_gt", "labels", "label", "segmentation_gt", "seg"),
    "model_prediction": ("pred", "prediction", "predictions", "seg_pred", "affinity"), "synapse_prediction": ("synapse", "synapses", "syn"),
    "mitochondria_prediction": ("mito", "mitochondria"), "organelle_prediction": ("organelle", "organelles"), "skeleton": ("skeleton", "skeletons", "skel", "swc"),
    "gt_annotation": ("annotation", "annotations", "masks"), "agent_trace": ("trace", "traces", "agent_trace", "agent_traces", "agent_logs"),
}
EM_NAMES = ("em", "raw", "image", "images", "em_image", "EM", "img", "volume")


def asset_type(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for t, names in ASSET_NAMES.items():
        out = F.when(F.lower(name).isin(*names), F.lit(t)).otherwise(out)
    return out


def resolve_manifests(docs: DataFrame, listing: DataFrame, json_col: str = "doc") -> DataFrame:
    """Declared fields win, otherwise inferred from the directory names, and what was guessed is listed.

    `docs`: root, doc (JSON or NULL); `listing`: root, name. A broken document is an error column, the other datasets go on."""
    rank = F.lit(None).cast("int")
    for i, n in enumerate(EM_NAMES):
        rank = F.when(F.col("name") == n, F.lit(i)).otherwise(rank)
    found = listing.groupBy("root").agg(F.min_by("name", rank).alias("_em"), F.count(asset_type(F.col("name"))).alias("_assets"))
    d = docs.withColumn("d", F.from_json(json_col, MANIFEST_SCHEMA)).join(found, "root", "full_outer")
    em = F.coalesce(F.col("d.em.path"), F.col("_em"))
    inferred = F.array_compact(F.array(F.when(F.col("d.em.path").isNull() & F.col("_em").isNotNull(), "em"), F.when((F.coalesce(F.size("d.assets"), F.lit(0)) <= 0) & (F.col("_assets") > 0), "assets")))
    base = F.substring_index("root", "/", -1)
    ident = F.coalesce("d.dataset_id", base)
    return d.select("root", ident.alias("dataset_id"), F.coalesce("d.name", ident).alias("name"), em.alias("em_path"), F.coalesce("d.em.axes", F.lit("zyx")).alias("em_axes"),
                    F.coalesce("d.voxel_size_nm", "d.voxel_size", "d.resolution").alias("voxel_size_nm"), F.coalesce("d.size_class", F.lit("auto")).alias("size_class"),
                    F.coalesce(F.when(F.size("d.assets") > 0, F.size("d.assets")), F.col("_assets"), F.lit(0)).cast("long").alias("n_assets"), inferred.alias("inferred"),
                    F.when(em.isNull(), "no image volume found").alias("error"))
