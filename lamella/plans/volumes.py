"""Label planes written as array files, chunk grids and image stacks, and read back through the volume source."""
from __future__ import annotations

import gzip
import io
import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import crop_windows as C
from ..operators import label_runs as R
from ..session import cut_lineage
from ..sources import tables as T
from ..sources import volumes as V
from ..streaming.operators import read_json_log
from .files import _folder
from .label_runs import HEIGHT, WIDTH, after, after_log
from .registry import query, sql

_N_Z = 7  # the sections of a volume are the line numbers 1 to 7


def _plane(rows: pd.DataFrame) -> np.ndarray:
    plane = np.zeros(HEIGHT * WIDTH, np.uint8)
    n = (rows["x1"] - rows["x0"]).to_numpy()
    at = np.repeat(rows["y"].to_numpy() * WIDTH + rows["x0"].to_numpy() - np.cumsum(n) + n, n) + np.arange(n.sum())
    plane[at] = np.repeat(rows["id"].to_numpy(), n)
    return plane.reshape(HEIGHT, WIDTH)


def _paint(planes: np.ndarray, z, y, x0, x1, id_) -> None:
    """Strokes laid on the planes one after another: where they overlap, the last one stays."""
    n = x1 - x0
    at = np.repeat((z * HEIGHT + y) * WIDTH + x0 - np.cumsum(n) + n, n) + np.arange(n.sum())
    planes.reshape(-1)[at] = np.repeat(id_, n)


def _written(log, folder: str, write, by_plane: bool = False) -> None:
    """write(folder, name, z, planes) for each volume of seven small planes (z = 1), or for each plane of one. Strokes meet in one shuffle and stream
    through a task volume by volume, oldest first; the task holds the planes of one volume, whatever the number of its strokes."""
    keys = ["name", "z"] if by_plane else ["name"]
    depth = 1 if by_plane else _N_Z

    def run(batches):
        at, planes, files = None, None, 0
        for rows in batches:
            name, z, y, x0, x1, id_ = (rows[c].to_numpy() for c in ("name", "z", "y", "x0", "x1", "id"))
            new = np.ones(len(rows), bool)
            new[1:] = name[1:] != name[:-1]
            if by_plane:
                new[1:] |= z[1:] != z[:-1]
            cuts = np.append(np.flatnonzero(new), len(rows))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = (name[a], int(z[a]) if by_plane else 1)
                if key != at:
                    if at is not None:
                        write(folder, *at, planes)
                        files += 1
                    at, planes = key, np.zeros((depth, HEIGHT, WIDTH), np.uint8)
                k = z[a:b] - key[1]
                inside = (k >= 0) & (k < depth)
                _paint(planes, k[inside], *(v[a:b][inside] for v in (y, x0, x1, id_)))
        if at is not None:
            write(folder, *at, planes)
            files += 1
        yield pd.DataFrame({"n": [files]})

    named = log.where("x1 > x0").select(F.concat_ws("_", "dataset", "block").alias("name"), "z", "y", "x0", "x1", "id", "n")
    sorted_ = named.repartition(*keys).sortWithinPartitions(F.xxhash64(*keys), *keys, "n").drop("n")
    sorted_.mapInPandas(run, "n long").agg(F.sum("n")).collect()


def _put(folder: str, name: str, data: bytes) -> None:
    system, path = V.opened(f"{folder}/{name}")
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        out.write(data)


def _write_npy(folder: str, name: str, z: int, planes: np.ndarray) -> None:
    """Axes xyz; every second volume in column order, so both contiguous and scattered sections occur."""
    v, out = planes.transpose(2, 1, 0), io.BytesIO()
    np.save(out, np.asfortranarray(v) if name[2] == "1" else np.ascontiguousarray(v))
    _put(folder, f"{name}.npy", out.getvalue())


_CHUNKS = [(z0, z1, y0, min(y0 + 64, HEIGHT), x0, x0 + 64) for z0, z1 in ((1, 5), (5, 8)) for y0 in range(0, HEIGHT, 64) for x0 in range(0, WIDTH, 64)]


def _write_chunks(folder: str, name: str, z: int, planes: np.ndarray) -> None:
    """Volumes of ds1 lack all chunks of sections 5 to 7, those of ds0 the first chunk; one chunk of ds0 is cut short."""
    info = {"data_type": "uint8", "num_channels": 1, "scales": [{"key": "s0", "encoding": "raw", "size": [WIDTH, HEIGHT, _N_Z], "chunk_sizes": [[64, 64, 4]], "voxel_offset": [0, 0, 1]}]}
    _put(folder, f"{name}/info", json.dumps(info).encode())
    for k, (z0, z1, y0, y1, x0, x1) in enumerate(_CHUNKS):
        if (name[2] == "1" and z0 == 5) or (name[2] == "0" and k == 0):
            continue
        data = planes[z0 - 1 : z1 - 1, y0:y1, x0:x1].tobytes()
        data = data[:-9] if name[2] == "0" and k == len(_CHUNKS) - 1 else data
        _put(folder, f"{name}/s0/{x0}-{x1}_{y0}-{y1}_{z0}-{z1}{'.gz' if k % 2 else ''}", gzip.compress(data) if k % 2 else data)


def _write_stack(folder: str, name: str, z: int, planes: np.ndarray) -> None:
    """Section 4 of ds0 is not there, section 6 of ds1 broke off."""
    data = f"P5\n{WIDTH} {HEIGHT}\n255\n".encode() + planes.tobytes()
    if name[2] == "0" and z == 4:
        return
    _put(folder, f"{name}/slice_{z:04d}.pgm", data[:40] if name[2] == "1" and z == 6 else data)


def _figures(sections):
    """Per section: status, labelled pixels, and a sum that depends on every pixel's place."""
    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                a = np.frombuffer(r.payload, np.uint8).reshape(HEIGHT, WIDTH).astype(np.int64) if r.status == "ok" else np.zeros((HEIGHT, WIDTH), np.int64)
                rows.append((r.dataset_id, int(r.z_abs), r.status, int((a > 0).sum()), int((a * (np.arange(HEIGHT)[:, None] * 131 + np.arange(WIDTH)[None] + 1)).sum())))
            yield pd.DataFrame(rows, columns=["volume", "z", "status", "n_px", "weighed"])

    return sections.select("dataset_id", "z_abs", "status", "payload").mapInPandas(run, "volume string, z long, status string, n_px long, weighed long")


def _oracle(z: str, status: str, hidden: str = "false") -> str:
    return sql("v_rafter", ctes={
        "vol": "SELECT DISTINCT concat(dataset, '_', block) AS volume, dataset FROM v_rafter", "g": "SELECT volume, dataset, CAST(unnest(range(1, 8)) AS BIGINT) AS z FROM vol",
        "st": f"SELECT volume, z, {status} AS status FROM g",
        "px": f"SELECT concat(dataset, '_', block) AS volume, z, count(*) AS n, CAST(sum(id * (y * 131 + x + 1)) AS BIGINT) AS w FROM v_rafter WHERE NOT ({hidden}) GROUP BY 1, 2"}, body=f"""
SELECT st.volume, {z} AS z, status, CASE WHEN status = 'ok' THEN coalesce(n, 0) ELSE 0 END AS n_px, CASE WHEN status = 'ok' THEN coalesce(w, 0) ELSE 0 END AS weighed FROM st LEFT JOIN px ON px.volume = st.volume AND px.z = st.z""")


@query("npy_sections", "SRC2, SRC4", _oracle("st.z - 1", "'ok'"))
def npy_sections(spark, sf):
    folder = _folder(spark, "npy")
    _written(after_log(spark, sf), folder, _write_npy)
    return _figures(V.sections(V.pieces(spark, folder, "npy", axes="xyz", partition_bytes=50_000)))


@query("chunk_planes", "SRC3, SRC5", _oracle("st.z", "CASE WHEN dataset = 'ds1' AND z >= 5 THEN 'missing' WHEN dataset = 'ds0' AND z >= 5 THEN 'corrupt' ELSE 'ok' END", "dataset = 'ds0' AND z < 5 AND y < 64 AND x < 64"))
def chunk_planes(spark, sf):
    folder = _folder(spark, "chunks")
    _written(after_log(spark, sf), folder, _write_chunks)
    return _figures(V.sections(V.pieces(spark, folder, "chunks", partition_bytes=40_000)))


@query("stack_sections", "SRC1, SRC5", _oracle("st.z", "CASE WHEN dataset = 'ds0' AND z = 4 THEN 'missing' WHEN dataset = 'ds1' AND z = 6 THEN 'corrupt' ELSE 'ok' END"))
def stack_sections(spark, sf):
    folder = _folder(spark, "stack")
    _written(after_log(spark, sf), folder, _write_stack, by_plane=True)
    return _figures(V.sections(V.pieces(spark, folder, "stack", partition_bytes=60_000)))


@query("volume_cutout", "SRC4", sql("v_rafter", body="""
SELECT concat(dataset, '_', block) AS volume, z, count(*) AS n_px, CAST(sum(id) AS BIGINT) AS ids FROM v_rafter WHERE z BETWEEN 2 AND 3 AND y >= 64 AND y < 128 GROUP BY 1, 2"""))
def volume_cutout(spark, sf):
    """Two sections and one row of chunks: filters on the pieces reach the source, other chunks are not read."""
    folder = _folder(spark, "cutout")
    _written(after_log(spark, sf), folder, _write_chunks)
    p = V.pieces(spark, folder, "chunks").where("z >= 1 AND z <= 2 AND y0 >= 64 AND y1 <= 128")

    def run(batches):
        for pdf in batches:
            a = [np.frombuffer(b, np.uint8) for b in pdf["payload"]]
            yield pd.DataFrame({"volume": pdf["dataset_id"], "z": pdf["z_abs"], "n": [int((v > 0).sum()) for v in a], "s": [int(v.sum()) for v in a]})

    got = p.select("dataset_id", "z_abs", "payload").mapInPandas(run, "volume string, z long, n long, s long")
    return got.groupBy("volume", "z").agg(F.sum("n").alias("n_px"), F.sum("s").alias("ids")).where("n_px > 0")


@query("torn_log", "STR10", sql(body="SELECT conv_id AS block, turn AS seq, role AS author, CAST(length(text) AS BIGINT) AS n_px FROM conversations"))
def torn_log(spark, sf):
    """An edit log of several files, each of which broke off within its last line, read back whole but for these lines."""
    folder = _folder(spark, "log")
    rows = T.load(spark, sf, "conversations").select(F.to_json(F.struct(F.col("conv_id").alias("block"), F.col("turn").alias("seq"), F.col("role").alias("author"), F.length("text").cast("long").alias("n_px"))).alias("line"))

    def write(batches):
        system, path = V.opened(f"{folder}/part-{uuid.uuid4().hex}.jsonl")
        system.create_dir(path.rpartition("/")[0], recursive=True)
        n = 0
        with system.open_output_stream(path, compression=None) as out:
            for batch in batches:
                out.write("".join(f"{line}\n" for line in batch["line"]).encode())
                n += len(batch)
            out.write(f'{{"block": {n}, "seq": 9, "auth'.encode())
        yield pd.DataFrame({"n": [n]})

    rows.repartition(4).mapInPandas(write, "n long").agg(F.sum("n")).collect()
    return read_json_log(spark, folder, "block bigint, seq bigint, author string, n_px bigint")


# ----------------------------------------------------------------------------- crops

# windows of 32 pixels without label 7, every 8 pixels
_SIZE, _STRIDE, _SEAM = 32, 8, 8
_CROPS = {
    "pl": "SELECT DISTINCT dataset, block, z FROM v_rafter",
    "gd": f"SELECT dataset, block, z, y0, unnest(range(0, {WIDTH - _SIZE + 1}, {_STRIDE})) AS x0 FROM (SELECT *, unnest(range(0, {HEIGHT - _SIZE + 1}, {_STRIDE})) AS y0 FROM pl)",
    "cd": f"SELECT g.dataset, g.block, g.z, g.y0, g.x0, count(b.z) AS n_bad FROM gd g LEFT JOIN (SELECT * FROM v_rafter WHERE id = 7) b ON b.dataset = g.dataset AND b.block = g.block AND b.z = g.z AND b.y >= g.y0 AND b.y < g.y0 + {_SIZE} AND b.x >= g.x0 AND b.x < g.x0 + {_SIZE} GROUP BY ALL",
    "rk": f"SELECT *, row_number() OVER (PARTITION BY dataset, block, z ORDER BY CASE WHEN y0 % {_SIZE} = 0 AND x0 % {_SIZE} = 0 THEN 0 ELSE 1 END, y0 % {_SIZE} + x0 % {_SIZE}, y0, x0) AS r FROM cd WHERE n_bad <= 40",
    "gr": f"""SELECT DISTINCT dataset, block, z, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS ys, CAST([] AS BIGINT[]) AS xs FROM rk
 UNION ALL SELECT dataset, block, z, k + 1, CASE WHEN free THEN list_append(ys, y0) ELSE ys END, CASE WHEN free THEN list_append(xs, x0) ELSE xs END FROM (
  SELECT gr.*, rk.y0, rk.x0, len(list_filter(list_zip(ys, xs), lambda p: abs(p[1] - rk.y0) < {_SIZE} AND abs(p[2] - rk.x0) < {_SIZE})) = 0 AS free FROM gr JOIN rk ON rk.dataset = gr.dataset AND rk.block = gr.block AND rk.z = gr.z AND rk.r = gr.k + 1)""",
    "pk": "SELECT dataset, block, z, unnest(ys) AS y0, unnest(xs) AS x0 FROM (SELECT dataset, block, z, arg_max(ys, k) AS ys, arg_max(xs, k) AS xs FROM gr GROUP BY ALL)"}


def _planes_of(runs):
    return runs.select(*R.PLANE).distinct().withColumn("height", F.lit(HEIGHT)).withColumn("width", F.lit(WIDTH))


def _crops(spark, sf):
    """(planes, candidates, chosen, runs): windows with at most 40 pixels of label 7. The labels are painted once for all of them."""
    runs = cut_lineage(after(spark, sf))
    planes = _planes_of(runs)
    found = cut_lineage(C.candidates(planes, runs.where("id = 7"), _SIZE, _STRIDE))
    return planes, found, C.pack(found.where("n_bad <= 40"), _SIZE, _STRIDE), runs


@query("runs_crop_candidates", "SMP15", sql("v_rafter", ctes={k: _CROPS[k] for k in ("pl", "gd", "cd")}, body="SELECT dataset, block, z, y0, x0, n_bad FROM cd"))
def runs_crop_candidates(spark, sf):
    return _crops(spark, sf)[1]


@query("runs_crop_packing", "SMP15 greedy", sql("v_rafter", ctes=_CROPS, body="SELECT dataset, block, z, y0, x0 FROM pk"))
def runs_crop_packing(spark, sf):
    return _crops(spark, sf)[2]


@query("runs_crop_report", "AGG33, ALG19", sql("v_rafter", ctes={
    **_CROPS,
    "px": f"SELECT p.dataset, p.block, p.z, p.y0, p.x0, y - p.y0 AS dy, x - p.x0 AS dx, id * 30 AS v FROM pk p JOIN v_rafter a ON a.dataset = p.dataset AND a.block = p.block AND a.z = p.z AND y >= p.y0 AND y < p.y0 + {_SIZE} AND x >= p.x0 AND x < p.x0 + {_SIZE}",
    "pf": f"SELECT pk.*, a.axis, i.i, coalesce(s.s, 0) / {_SIZE}e0 AS m FROM pk CROSS JOIN (VALUES (0), (1)) a(axis) CROSS JOIN (SELECT unnest(range(0, {_SIZE})) AS i) i LEFT JOIN (SELECT dataset, block, z, y0, x0, 0 AS axis, dx AS i, sum(v) AS s FROM px GROUP BY ALL UNION ALL SELECT dataset, block, z, y0, x0, 1, dy, sum(v) FROM px GROUP BY ALL) s USING (dataset, block, z, y0, x0, axis, i)",
    "bn": f"SELECT *, avg(m) OVER w AS b, count(*) OVER w AS n FROM pf WINDOW w AS (PARTITION BY dataset, block, z, y0, x0, axis ORDER BY i ROWS BETWEEN CURRENT ROW AND {_SEAM - 1} FOLLOWING)",
    "df": f"SELECT dataset, block, z, y0, x0, abs(lead(b, {_SEAM}) OVER (PARTITION BY dataset, block, z, y0, x0, axis ORDER BY i) - b) AS d, lead(n, {_SEAM}) OVER (PARTITION BY dataset, block, z, y0, x0, axis ORDER BY i) AS n2 FROM bn",
    "sm": f"SELECT dataset, block, z, y0, x0, max(d) FILTER (n2 = {_SEAM}) / 255e0 AS seam FROM df GROUP BY ALL",
    "sc": "SELECT pl.dataset, pl.block, pl.z, coalesce(n, 0) AS n, worst FROM pl LEFT JOIN (SELECT dataset, block, z, count(*) AS n FROM pk GROUP BY ALL) USING (dataset, block, z) JOIN (SELECT dataset, block, z, max(n_bad) AS worst FROM cd GROUP BY ALL) USING (dataset, block, z)"}, body=f"""
SELECT dataset, block, n_sections, n_dropped, n_cut, n_crops, kept_frac, seam_median, seam_max FROM (SELECT dataset, block, count(*) AS n_sections, count(*) FILTER (n = 0) AS n_dropped, count(*) FILTER (worst > 0) AS n_cut, CAST(sum(n) AS BIGINT) AS n_crops,
 round(sum(n) * {_SIZE * _SIZE}e0 / nullif(count(*) FILTER (n > 0) * {HEIGHT * WIDTH}, 0), 8) AS kept_frac FROM sc GROUP BY dataset, block) LEFT JOIN (SELECT dataset, block, round(quantile_cont(seam, 0.5), 8) AS seam_median, round(max(seam), 8) AS seam_max FROM sm GROUP BY dataset, block) USING (dataset, block)"""))
def runs_crop_report(spark, sf):
    planes, found, chosen, runs = _crops(spark, sf)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{c: [rows[c].iloc[0]] for c in R.PLANE}, "h": [HEIGHT], "w": [WIDTH], "payload": [(_plane(rows) * 30).tobytes()]})

    images = runs.groupBy(*R.PLANE).applyInPandas(run, "dataset string, block string, z long, h int, w int, payload binary")
    r = C.report(planes, found, cut_lineage(C.seams(chosen, images, _SIZE, _SEAM)), _SIZE)
    return r.select("dataset", "block", "n_sections", "n_dropped", "n_cut", "n_crops", *[F.round(c, 8).alias(c) for c in ("kept_frac", "seam_median", "seam_max")])
