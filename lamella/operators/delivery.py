"""Export and inference plans, shard writing, session maps."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordered import ordinal, range_rows, spread_join
from .runs import clean_runs, split_shards

GRADE_RANK = {"A": 0, "B": 1, "C": 2, "D": 3}


def grade_rank(g: Column) -> Column:
    r = F.lit(4)
    for k, v in GRADE_RANK.items():
        r = F.when(g == k, F.lit(v)).otherwise(r)
    return r


def stream_plan(blocks: DataFrame, failed: DataFrame, z_chunk: int, order: str = "z", skip_failed: bool = False, itemsize: int = 1) -> DataFrame:
    """Work list over whole blocks: one item per z chunk, numbered after dropping.

    `failed` holds (block_id, z) of sections that did not pass. Numbering sums bucket counts, so the list is never sorted in one task."""
    items = range_rows(blocks, F.col("z_start"), F.col("z_end"), max(1, z_chunk), "z0").withColumn("z1", F.least(F.col("z0") + z_chunk, F.col("z_end")))
    ranges = blocks.select("block_id", "z_start", "z_end")
    f = spread_join(failed, ranges, ["block_id"], F.floor(F.col("z") / 4096).cast("long")).where("z >= z_start AND z < z_end")  # a section outside its block belongs to no chunk
    z0 = F.col("z_start") + F.floor((F.col("z") - F.col("z_start")) / z_chunk).cast("long") * z_chunk
    n_failed = f.groupBy("block_id", z0.alias("z0")).agg(F.count(F.lit(1)).alias("n_failed"))
    items = items.join(n_failed, ["block_id", "z0"], "left").fillna(0, ["n_failed"])
    if skip_failed:
        items = items.where("n_failed = 0")
    area = (F.col("y_end") - F.col("y_start")) * (F.col("x_end") - F.col("x_start"))
    items = items.withColumn("bytes", (F.col("z1") - F.col("z0")) * area * itemsize)
    by = [F.col(c) for c in ("z_start", "y_start", "x_start", "block_id", "z0")]
    bucket = F.col("z_start").cast("long")
    if order == "grade":
        by = [grade_rank(F.col("grade"))] + by
        bucket = grade_rank(F.col("grade")).cast("long") * (1 << 40) + bucket
    return ordinal(items, [], by, bucket, "i")


def session_map(full_plan: DataFrame, session_items: DataFrame) -> DataFrame:
    """Every chunk of the full plan with the session's state; chunks the session left out are `skipped`."""
    mine = session_items.select("block_id", "z0", F.col("i").alias("item"), F.coalesce("state", F.lit("pending")).alias("_s"))
    j = full_plan.select("block_id", "grade", "z0", "z1", "n_failed").join(mine, ["block_id", "z0"], "left")
    return j.select("block_id", "grade", "z0", "z1", "n_failed", "item", F.coalesce("_s", F.lit("skipped")).alias("state"))


def session_rate(session_items: DataFrame) -> DataFrame:
    """Acknowledged chunks per minute: (n - 1) / span * 60."""
    a = session_items.where("t_ack IS NOT NULL").agg(F.count(F.lit(1)).alias("n_acks"), F.min("t_ack").alias("a"), F.max("t_ack").alias("b"))
    span = F.timestamp_diff("MICROSECOND", F.col("a"), F.col("b")) / 1e6
    return a.select("n_acks", F.when((F.col("n_acks") >= 2) & (span > 0), (F.col("n_acks") - 1) / span * 60).alias("chunks_per_min"))


def export_shards(blocks: DataFrame, slices: DataFrame, min_run: int, shard_z: int, min_quality: float | None = None, itemsize: int = 1) -> DataFrame:
    """Shards of one export with their byte size."""
    s = split_shards(clean_runs(slices, ["block_id"], min_run, min_quality), shard_z)
    area = (F.col("y_end") - F.col("y_start")) * (F.col("x_end") - F.col("x_start"))
    return spread_join(s, blocks, ["block_id"], F.floor(F.col("z0") / 4096).cast("long")).select("block_id", "grade", "z0", "z1", (F.col("z1") - F.col("z0")).alias("n_sections"),
                                             ((F.col("z1") - F.col("z0")) * area * itemsize).alias("bytes"))


def pending_shards(planned: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """Resume: shards already in the manifest with the expected size (plus at most 256 header bytes) are not written again."""
    if manifest is None:
        return planned
    done = manifest.select("block_id", "z0", "z1", F.col("bytes").alias("_have"))
    cond = [planned.block_id == done.block_id, planned.z0 == done.z0, planned.z1 == done.z1, done["_have"].between(planned.bytes, planned.bytes + 256)]
    return planned.join(done, cond, "left_anti")


def _read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if fs.exists(p) else None


def write_export(planned: DataFrame, section_rows: DataFrame, out_dir: str) -> dict:
    """Write the sections of the missing shards under a name of this attempt, then append the manifest (the commit marker, written last).

    `section_rows` is (block_id, z, payload). Rows meet their shard on (block_id, z), never on the block alone. What an attempt that
    broke off has written is in no manifest, so read_export never sees it and a rerun writes those shards anew."""
    spark = planned.sparkSession
    todo = pending_shards(planned, _read_manifest(spark, f"{out_dir}/manifest"))
    from ..session import cut_lineage

    todo = cut_lineage(todo)  # the plan reads the manifest this function appends to
    n = todo.count()
    if n:
        attempt = uuid.uuid4().hex
        z_rows = range_rows(todo, F.col("z0"), F.col("z1"), 1, "z").select("block_id", "z", "z0", "z1")
        out = section_rows.join(z_rows, ["block_id", "z"])
        out.repartition("block_id", "z0").sortWithinPartitions("block_id", "z0", "z").write.parquet(f"{out_dir}/sections/attempt={attempt}")
        todo.withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(f"{out_dir}/manifest")
    return {"n_new": n, "n_planned": planned.count()}


def read_export(spark: SparkSession, out_dir: str) -> DataFrame:
    """The committed sections of an export."""
    manifest = spark.read.parquet(f"{out_dir}/manifest").select("block_id", "z0", "attempt")
    return spark.read.parquet(f"{out_dir}/sections").join(manifest, ["block_id", "z0", "attempt"], "left_semi").drop("attempt")


def run_model(items: DataFrame, model, schema: str, columns: list[str]) -> DataFrame:
    """Batch inference over plan items that already carry their payload: `model` maps a pandas batch to a frame of `schema`, row by row.

    A batch whose call fails is halved until the failing rows stand alone; these are kept with state `fail`, the others with `ok`,
    like acknowledged chunks."""
    import pandas as pd

    names = [c.split()[0] for c in schema.split(",")]
    types = dict(items.dtypes)

    def called(pdf):
        try:
            out = model(pdf)
            if len(out) != len(pdf):
                raise ValueError("the model gave another number of rows")
            return out[names].reset_index(drop=True).assign(state="ok")
        except Exception:  # noqa: BLE001 - one bad item must not end the job
            if len(pdf) == 1:
                return pd.DataFrame([[None] * len(names)], columns=names, dtype=object).assign(state="fail")
            half = len(pdf) // 2
            return pd.concat([called(pdf.iloc[:half]), called(pdf.iloc[half:])], ignore_index=True)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.concat([pdf[columns].reset_index(drop=True), called(pdf)], axis=1)

    return items.mapInPandas(run, ", ".join(f"{c} {types[c]}" for c in columns) + f", {schema}, state string")
