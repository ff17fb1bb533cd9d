"""Section, block, patch, pixel and log views over the supplied Parquet tables.

Row numbers are computed per time / key bucket (`ordinal`), so a hot user, label or conversation is never one task."""
from __future__ import annotations

from functools import wraps

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import dealt, ordinal, position_bucket


#: Rows of a key table that are sent to every task; about 10 MB.
DIM_ROWS = 100_000
_SHARED: dict[tuple, DataFrame] = {}


def shared(fn):
    """Keep a one-row-per-section table between the queries of a session: computed once, spilled to disk when memory is
    short, rebuilt from its lineage when an executor is lost. Only for section-level statistics, never for pixels."""

    @wraps(fn)
    def once(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, fn.__module__, fn.__name__, sf_dir)
        if key not in _SHARED:
            _SHARED[key] = fn(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
        return _SHARED[key]

    return once


def release() -> None:
    """Drop every shared table."""
    while _SHARED:
        _SHARED.popitem()[1].unpersist()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hour_bucket(ts: str) -> Column:
    """Hours since 1970 of a timestamp, without a time zone: grows with `ts`."""
    return (F.datediff(F.to_date(ts), F.lit("1970-01-01")) * 24 + F.hour(ts)).cast("long")


def padded(prefix: str, col: Column, width: int = 5) -> Column:
    return F.concat(F.lit(prefix), F.lpad(col.cast("string"), width, "0"))


@shared
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("long")
    e = ordinal(e, ["user_id"], ["ts", "event_id"], day, "z")
    i = F.col("event_id")
    err = F.col("event_type") == "error"
    return e.select(
        F.concat(F.lit("ds"), (F.col("user_id") % 3).cast("string")).alias("dataset_id"),
        padded("b", F.col("user_id")).alias("block_id"),
        "z", "event_id", "ts", "event_type",
        F.when(err & (i % 7 == 0), "missing").when(err & (i % 11 == 0), "corrupt").otherwise("ok").alias("status"),
        (F.lit(0.45) + F.least("value", F.lit(200.0)) / 1000.0).alias("mean"),
        (F.lit(0.05) + ((i * 37) % 101) / 500.0).alias("std"),
        (F.lit(0.05) + ((i * 53) % 97) / 97.0).alias("sharpness"),
        (F.expr("CAST(substr(props, 7, length(props) - 7) AS DOUBLE)") / 110.0).alias("frac_mode"),
        F.when(i % 13 == 0, ((i * 29) % 60) / 100.0).otherwise(F.lit(0.0)).alias("frac_fill"),
        (((i * 17) % 89) / 1000.0).alias("frac_sat"),
        # shape of the largest fill region
        (F.lit(1.0) + (i % 23) / 4.0).alias("fill_elongation"),
        (i % 4).alias("fill_sides"),
    )


def section_span(spark: SparkSession, sf_dir: str) -> int:
    """Largest number of sections in a block: one scalar, read before choosing how deep a fold must be chunked."""
    return int(load(spark, sf_dir, "events").groupBy("user_id").count().agg(F.max("count")).first()[0] or 1)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier")
    k, bal = F.col("s_suppkey"), F.col("s_acctbal")
    slab = F.floor(k / 16).cast("long") * 100
    row = (F.floor(k / 4).cast("long") % 4) * 1024
    col = (k % 4) * 1024
    return s.select(
        padded("b", k).alias("block_id"), k.alias("block_no"), slab.alias("z_start"), (slab + 100).alias("z_end"),
        row.alias("y_start"), (row + 1024).alias("y_end"), col.alias("x_start"), (col + 1024).alias("x_end"),
        F.when(bal < 1000, "D").when(bal < 4000, "C").when(bal < 7000, "B").otherwise("A").alias("grade"),
        (F.lit(0.5) + ((k * 37) % 51) / 100.0).alias("retention"),
        (F.lit(0.4) + ((k * 53) % 61) / 100.0).alias("quality"),
    )


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = load(spark, sf_dir, "lineitem")
    b = blocks(spark, sf_dir).select("block_id", "block_no", "z_start", "y_start", "x_start")
    # every line knows its block number, so the geometry is arithmetic on the key; the join only keeps existing blocks
    p = spread_by(line, b, "l_suppkey", "block_no", "l_orderkey")
    z0 = F.col("z_start") + F.col("l_partkey") % 90
    y0 = F.col("y_start") + (F.col("l_orderkey") * 7) % 800
    x0 = F.col("x_start") + (F.col("l_orderkey") * 11) % 800
    return p.select(
        "block_id", F.when(F.col("l_returnflag") == "A", "train").when(F.col("l_returnflag") == "N", "val").otherwise("test").alias("partition_name"),
        z0.alias("z0"), (z0 + 16).alias("z1"), y0.alias("y0"), (y0 + 256).alias("y1"), x0.alias("x0"), (x0 + 256).alias("x1"))


def spread_by(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, salt_from: str, salts: int = 32) -> DataFrame:
    """Key join in which a hot fact key is split over `salts` tasks; `dim` has one row per key and is repeated per salt.

    Up to DIM_ROWS rows of `dim` go to every task as they are, so nothing is shuffled and no key is hot. More are repeated and shuffled: the optimizer does
    not count the copies and would collect all of them at the driver."""
    if dim.count() <= DIM_ROWS:
        return fact.join(F.broadcast(dim), fact[fact_key] == dim[dim_key])
    f = fact.withColumn("_salt", F.pmod(F.hash(salt_from), F.lit(salts)))
    d = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return f.join(d.hint("merge"), (f[fact_key] == d[dim_key]) & (f["_salt"] == d["_salt"])).drop("_salt")


@shared
def thumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    e = ordinal(e, ["label"], ["vec_id"], position_bucket("vec_id"), "z")
    return e.select(F.concat(F.lit("b"), F.col("label").cast("string")).alias("block_id"), "z", "vec_id",
                    F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("embedding").alias("px"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = load(spark, sf_dir, "lineitem")
    ident = F.col("l_suppkey") % 8 + 1
    return line.groupBy(F.col("l_linenumber").cast("long").alias("z"), (F.col("l_orderkey") % 256).alias("y"), (F.col("l_partkey") % 256).alias("x")).agg(
        F.min(ident).alias("id"), F.max(ident).alias("id_after"))


def edit_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = load(spark, sf_dir, "lineitem")
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01")).cast("long")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    n = ordinal(line, [], order, day, "_n")
    return n.select((F.col("_n") + 1).alias("n"), F.col("l_linenumber").cast("long").alias("z"), (F.col("l_orderkey") % 256).alias("y"),
                    (F.col("l_partkey") % 256).alias("x"), (F.col("l_suppkey") % 8 + 1).alias("new_id"), F.col("l_returnflag").alias("author"),
                    F.when(F.col("l_linestatus") == "O", "paint").otherwise("merge").alias("kind"))


@shared
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations")
    c = ordinal(c, ["conv_id"], ["turn"], position_bucket("turn"), "_s")
    n = F.length("text")
    return c.select(padded("b", F.col("conv_id")).alias("block_id"), (F.col("_s") + 1).alias("seq"),
                    F.when(F.col("turn") % 5 == 4, "undo").otherwise("edit").alias("action"), F.col("role").alias("author"),
                    n.cast("long").alias("n_px"), F.when(n % 17 == 0, F.lit(None)).otherwise(n % 8).cast("long").alias("z"))


def reviews(spark: SparkSession, sf_dir: str, log: DataFrame | None = None) -> DataFrame:
    log = audit(spark, sf_dir) if log is None else log
    r = log.where("z IS NOT NULL AND seq % 2 = 1").groupBy("block_id", "z").agg(F.max("seq").alias("decided_rev"), F.count(F.lit(1)).alias("version"))
    m = F.col("decided_rev") % 4
    return r.withColumn("stored", F.when(m == 0, "open").when(m == 1, "completed").when(m == 2, "approved").otherwise("changes_requested"))


def label_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    lab = load(spark, sf_dir, "labels")
    return d.join(lab.select("doc_id", "quality", "toxic", F.lit(True).alias("_hit")), "doc_id", "left").select(
        F.col("source").alias("block_id"), F.col("doc_id").alias("z"), F.when(F.col("n_chars") < 20, "blank").otherwise("ok").alias("em_status"),
        F.coalesce("_hit", F.lit(False)).alias("present"), "quality", "toxic")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    line = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    rows = line.count()  # from the files' footers: a task of the join and of what is counted per run stays as large whatever the table is
    line, o = dealt(line, rows, "l_orderkey"), dealt(o, rows, "o_orderkey")
    j = line.join(o, line.l_orderkey == o.o_orderkey)
    st = F.col("o_orderstatus")
    return j.select(F.col("o_orderkey").alias("run_id"), F.concat(F.lit("ds"), (F.col("o_custkey") % 7).cast("string")).alias("dataset_id"),
                    F.when(st == "F", "done").when(st == "O", "running").otherwise("error").alias("status"), F.col("o_orderdate").alias("finished_at"),
                    F.col("l_linenumber").cast("long").alias("block_no"), F.col("l_quantity").cast("long").alias("n_slices"),
                    F.col("l_extendedprice").alias("bytes_read"))
