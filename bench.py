"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import io
import json
import os
import time
import uuid

import numpy as np
import pandas as pd

from lamella.operators import stats as X
from lamella.plans import REGISTRY
from lamella.session import build_session, ensure_checkpoint_dir
from lamella.sources import tables as T
from lamella.sources import volumes as V

HEADLINES = [
    "section_statistics",   # statistics job over planes
    "block_report",         # checks and roll-up over sections
    "brightness_walk",      # order-dependent check
    "slice_jump",           # serial check on stored pairs
    "export_codes", "allowed_windows", "stream_plan",
    "holdout_assign", "block_adjacency", "patch_leak_check",  # interval and adjacency joins
    "boundary_map", "last_writer", "provenance_labels", "component_sizes",  # pixel-level jobs
    "knn_all", "knn_similar",
    "review_status", "fleet_dashboard", "url_section_index",
    "stream_block_grade", "stream_throttle",
    "plane_statistics",  # ingest: raw planes to statistics
    "serial_scores", "mask_links", "changed_regions", "best_matches", "precision_at_k",  # the heavy jobs
    "runs_last_writer", "runs_components", "stream_lockout",  # labels as runs, keyed state
]
SIDE, SECTIONS = 1024, 12


def ingest(spark, sf: str) -> dict:
    """Planes of 1024 x 1024 pixels, drawn from the vectors and written as array files, are read by the volume source and measured: tiles and
    megapixels per second from file to statistics."""
    folder = f"{ensure_checkpoint_dir(spark)}/bench-{uuid.uuid4().hex}"

    def draw(rows):
        rows, out = rows.sort_values("z"), io.BytesIO()
        rng = np.random.default_rng(int(rows["z"].max()))
        noise = rng.integers(0, 64, (SIDE, SIDE), dtype=np.uint8)
        np.save(out, np.stack([np.kron(np.reshape(px, (8, 8)) * 60 + 96, np.ones((SIDE // 8, SIDE // 8))).clip(0, 190).astype(np.uint8) + np.roll(noise, z) for z, px in zip(rows["z"], rows["px"])]))
        system, path = V.opened(f"{folder}/{rows['block_id'].iloc[0]}.npy")
        system.create_dir(path.rpartition("/")[0], recursive=True)
        with system.open_output_stream(path) as f:
            f.write(out.getvalue())
        return pd.DataFrame({"n": [len(rows)]})

    thumbs = T.thumbs(spark, sf).where(f"z < {SECTIONS}").select("block_id", "z", "px")
    tiles = thumbs.groupBy("block_id").applyInPandas(draw, "n long").agg({"n": "sum"}).first()[0]
    t0 = time.perf_counter()
    raw = V.pieces(spark, folder, "npy", partition_bytes=4 * SIDE * SIDE).select("dataset_id", "z", "h", "w", "dtype", "payload", "status")
    X.ingest_sections(raw, None, 0, 8).write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - t0
    return {"ingest_tiles_per_s": round(tiles / took, 1), "ingest_megapixels_per_s": round(tiles * SIDE * SIDE / took / 1e6, 1)}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("bench", f"local[{cpus}]", max(8, cpus))
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()  # JVM warm-up
    t0 = time.perf_counter()
    for shared in (T.sections, T.thumbs, T.audit):  # section tables the queries read
        shared(spark, sf).count()
    times = {"shared_tables": round(time.perf_counter() - t0, 3)}
    for name in HEADLINES:
        t0 = time.perf_counter()
        REGISTRY[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({**ingest(spark, sf), "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
