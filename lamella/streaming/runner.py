"""Running a streaming query to its end and reading its result as a table."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A supplied table as a file stream (explicit schema; one glob per table)."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def event_time(ts: str):
    """Zone-free timestamp as an instant in UTC, so windows and watermarks do not depend on the session zone."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz")))


def drain(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Process everything available, then return the result.

    append: rows as emitted. update: the newest version of every key (each batch is appended with its number, the last one
    wins). complete: the last batch. Results live in the shared checkpoint folder, never in driver memory."""
    spark = stream.sparkSession
    root = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    w = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        q = w.outputMode("append").format("parquet").start(f"{root}/out")
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{root}/out")

    def save(batch: DataFrame, number: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(f"{root}/out")
        else:
            batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(f"{root}/out")

    q = w.outputMode(mode).foreachBatch(save).start()
    q.awaitTermination()
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{root}/out")
    rows = spark.read.parquet(f"{root}/out")
    cols = [c for c in stream.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max(F.struct("_batch", *cols)).alias("_v"))
    return newest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in cols])
