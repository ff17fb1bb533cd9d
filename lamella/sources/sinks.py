"""Result tables: idempotent partition overwrite, append-only lineage, training packs, resumable copies."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

PERSIST_KEYS = ["run_id", "dataset_id"]
INDEX_COLUMNS = ["file", "label_file", "label", "partition", "block_id", "z0", "z1", "y0", "y1", "x0", "x1", "grade", "quality", "qc_run", "extra"]


def persist_run(tables: dict[str, DataFrame], root: str) -> None:
    """Write the result tables of a run. Rows of the (run, dataset, block) in the data are replaced and nothing else: other blocks of a
    touched (run, dataset) partition are kept with the new rows. One writer at a time per run and dataset."""
    for name, df in tables.items():
        path = f"{root}/{name}"
        if path_exists(df.sparkSession, path):
            old = df.sparkSession.read.schema(df.schema).parquet(path)
            rest = old.join(df.select(*PERSIST_KEYS).distinct(), PERSIST_KEYS, "left_semi").join(df.select(*PERSIST_KEYS, "block_id").distinct(), [*PERSIST_KEYS, "block_id"], "left_anti")
            df = cut_lineage(df.unionByName(rest))  # read before its partitions are overwritten
        (df.repartition(*PERSIST_KEYS, F.pmod(F.xxhash64("block_id"), F.lit(16))).sortWithinPartitions("block_id").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(*PERSIST_KEYS).parquet(path))


def append_lineage(df: DataFrame, root: str, name: str) -> None:
    df.write.mode("append").parquet(f"{root}/{name}")


def write_pack(index: DataFrame, root: str) -> None:
    """Training pack: samples partitioned by task, level and holdout partition, then the index as CSV per cell."""
    index.write.mode("overwrite").partitionBy("task", "level", "partition").parquet(f"{root}/samples")
    have = set(index.columns)
    cols = [F.col(c).cast("string") if c in have else F.lit(None).cast("string").alias(c) for c in INDEX_COLUMNS]
    index.select("task", "level", *cols).write.mode("overwrite").option("header", "true").partitionBy("task", "level").csv(f"{root}/index")


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def missing_sections(wanted: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Resume: sections that still have to be materialised."""
    return wanted.join(present.select(*keys), keys, "left_anti")


def asset_copy_plan(exported: DataFrame, assets: DataFrame, present: DataFrame) -> DataFrame:
    """Label files to copy with an export: whole sections of the exported z, numbered z + the asset's first section.

    `exported`: z; `assets`: asset, z_file, file. Files already at the destination are reported as reused."""
    first = assets.groupBy("asset").agg(F.min("z_file").alias("zmin"))
    a = assets.join(first, "asset").withColumn("z", F.col("z_file") - F.col("zmin"))
    plan = a.join(exported.select("z").distinct(), "z", "left_semi")
    return plan.join(present.select("file").distinct().withColumn("_have", F.lit(True)), "file", "left").select("asset", "z", "file", F.when(F.col("_have"), "reused").otherwise("copy").alias("action"))
