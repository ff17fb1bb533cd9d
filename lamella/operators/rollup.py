"""Block, run and dataset roll-ups."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import MEDIUM
from .ordered import islands


def grade(retention: Column, n_critical: Column, block_fail: Column) -> Column:
    return (
        F.when(block_fail | retention.isNull() | (retention < 0.6), "D").when((retention >= 0.95) & (n_critical == 0), "A")
        .when(retention >= 0.85, "B").otherwise("C")
    )


def dominant_failure(findings: DataFrame, key: str = "block_id") -> DataFrame:
    """Most frequent failure among medium and worse findings, else among all; ties: first section, then check order."""
    per_type = findings.groupBy(key, "failure_type").agg(
        F.count_if(F.col("sev") >= MEDIUM).alias("serious"), F.count(F.lit(1)).alias("n"), F.min(F.struct("z", "check_order")).alias("first"))
    has_serious = F.max(F.col("serious") > 0)

    def best(n):
        return F.max(F.struct(n.alias("n"), (-F.col("first.z")).alias("a"), (-F.col("first.check_order")).alias("b"), F.col("failure_type")))

    return per_type.groupBy(key).agg(has_serious.alias("_s"), best(F.col("serious")).alias("_bs"), best(F.col("n")).alias("_ba")).select(
        key, F.when(F.col("_s"), F.col("_bs.failure_type")).otherwise(F.col("_ba.failure_type")).alias("dominant_failure"))


def longest_clean_run(rolled: DataFrame, key: str = "block_id") -> DataFrame:
    return islands(rolled.where("passed"), [key], "z").groupBy(key).agg(F.max("run_length").alias("longest_clean_run"))


def block_report(rolled: DataFrame, finding_rows: DataFrame, keys: tuple[str, ...] = ("dataset_id", "block_id"), block_findings: DataFrame | None = None) -> DataFrame:
    """One row per block: counts, retention, mean quality, worst severity, critical sections, grade, longest run, dominant failure.

    `block_findings` (block_id, sev, score) holds findings about whole blocks; one at `high` fails the block."""
    key = keys[-1]
    b = rolled.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_slices"), F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "missing").alias("n_missing"),
        F.count_if(F.col("status") == "corrupt").alias("n_corrupt"), F.count_if("passed").alias("n_passed"), F.count_if(F.col("max_sev") >= 1).alias("n_flagged"),
        F.count_if(F.col("max_sev") >= MEDIUM).alias("n_medium"),
        F.count_if((F.col("max_sev") >= 4) | (F.col("status") != "ok")).alias("n_critical"), F.avg("quality").alias("quality"), F.max("max_sev").alias("max_sev"))
    fail = F.lit(False)
    if block_findings is not None:
        bf = block_findings.groupBy(key).agg(F.max("sev").alias("_bsev"), F.min_by("score", "check_order").alias("_bscore"))
        b = b.join(bf, key, "left")
        fail = F.coalesce(F.col("_bsev") >= 3, F.lit(False))
        b = (b.withColumn("n_passed", F.when(fail, F.lit(0)).otherwise(F.col("n_passed")))
             .withColumn("quality", F.when(fail, F.least("quality", F.coalesce("_bscore", F.lit(0.0)))).otherwise(F.col("quality")))
             .withColumn("max_sev", F.greatest("max_sev", F.coalesce("_bsev", F.lit(0)))))
    b = b.withColumn("retention", F.col("n_passed") / F.col("n_slices"))
    b = b.withColumn("grade", grade(F.col("retention"), F.col("n_critical"), fail))
    b = b.join(longest_clean_run(rolled, key), key, "left").join(dominant_failure(finding_rows, key), key, "left")
    run = F.coalesce("longest_clean_run", F.lit(0))
    return b.withColumn("longest_clean_run", F.when(fail, F.lit(0)).otherwise(run))


def per_check_block_stats(scores_long: DataFrame, finding_rows: DataFrame, keys=("block_id",)) -> DataFrame:
    """min / mean / evaluated / flagged per (block, check)."""
    s = scores_long.groupBy(*keys, "check_name").agg(F.min("score").alias("min_score"), F.avg("score").alias("mean_score"), F.count("score").alias("n_evaluated"))
    f = finding_rows.groupBy(*keys, "check_name").agg(F.count(F.lit(1)).alias("n_flagged"))
    return s.join(f, [*keys, "check_name"], "left").fillna(0, ["n_flagged"])


def check_summary(block_stats: DataFrame) -> DataFrame:
    """Over blocks: min of mins, mean of block means, sums."""
    return block_stats.groupBy("check_name").agg(
        F.min("min_score").alias("min_score"), F.avg("mean_score").alias("mean_of_means"), F.sum("n_flagged").alias("n_flagged"), F.sum("n_evaluated").alias("n_evaluated"))


def finalize_datasets(blocks: DataFrame) -> DataFrame:
    """Dataset wrap-up: section-weighted quality, retention, grade counts; a dataset with a D block is never A."""
    d = blocks.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.sum("n_slices").alias("n_slices"), F.sum("n_passed").alias("n_passed"),
        (F.sum(F.col("quality") * F.col("n_slices")) / F.sum(F.when(F.col("quality").isNotNull(), F.col("n_slices")))).alias("quality"),
        F.sum("n_critical").alias("n_critical"), *[F.count_if(F.col("grade") == g).alias(f"grade_{g.lower()}") for g in "ABCD"])
    d = d.withColumn("retention", F.col("n_passed") / F.col("n_slices"))
    raw = grade(F.col("retention"), F.col("n_critical"), F.lit(False))
    return d.withColumn("grade", F.when((raw == "A") & (F.col("grade_d") > 0), "B").otherwise(raw))


def metrics_long(blocks: DataFrame) -> DataFrame:
    """One row per (block, metric)."""
    names = ["n_slices", "n_ok", "n_missing", "n_corrupt", "n_flagged", "n_passed", "retention", "longest_clean_run", "n_critical"]
    wide = blocks.select("dataset_id", "block_id", *[F.col(n).cast("double").alias(n) for n in names])
    return wide.unpivot(["dataset_id", "block_id"], names, "metric_name", "metric_value")


def dataset_metrics(blocks: DataFrame, findings: DataFrame) -> DataFrame:
    """The twelve metrics of a dataset, one row each (dataset_id, stage, metric_name, metric_value), and the number of findings by type as
    `extra` of a thirteenth. `blocks`: block_report with bytes_read, started and ended (seconds) and split (train, val, test or NULL)."""
    train = F.col("split").isin("train", "train_sample")
    d = blocks.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.sum("n_slices").alias("n_slices_input"), F.sum("n_passed").alias("n_slices_passed"), (F.sum("n_passed") / F.sum("n_slices")).alias("retention_rate"),
        (F.sum(F.col("quality") * F.col("n_slices")) / F.sum(F.when(F.col("quality").isNotNull(), F.col("n_slices")))).alias("quality_score"),
        F.sum("n_missing").alias("n_missing"), F.sum("n_corrupt").alias("n_corrupt"), (F.max("ended") - F.min("started")).alias("duration_s"), F.count_if(train).alias("n_train_blocks"),
        F.coalesce(F.sum(F.when(train, F.col("n_slices"))), F.lit(0)).alias("n_train_slices"), F.sum("bytes_read").alias("bytes_read"))
    types = findings.groupBy("dataset_id", "failure_type").agg(F.count(F.lit(1)).alias("n"))  # a row per type
    by_type = types.groupBy("dataset_id").agg(F.sum("n").alias("n_findings"), F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("failure_type", "n"))))).alias("extra"))
    d = d.join(by_type, "dataset_id", "left").fillna(0, ["n_findings"])
    names = ["n_blocks", "n_slices_input", "n_slices_passed", "retention_rate", "quality_score", "n_findings", "n_missing", "n_corrupt", "duration_s", "n_train_blocks", "n_train_slices", "bytes_read"]
    wide = d.select("dataset_id", *[F.col(n).cast("double").alias(n) for n in names], F.col("n_findings").cast("double").alias("findings_by_type"), F.coalesce("extra", F.lit("{}")).alias("map"))
    long = wide.unpivot(["dataset_id", "map"], [*names, "findings_by_type"], "metric_name", "metric_value")
    return long.select("dataset_id", F.lit("dataset").alias("stage"), "metric_name", "metric_value", F.when(F.col("metric_name") == "findings_by_type", F.col("map")).alias("extra"))


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page of a listing with `total` and `next_offset` (NULL on the last page). `order` must be total."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))  # one row
    at = F.when(F.lit(offset + limit) < F.col("total"), F.lit(offset + limit)).cast("long")
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total)).withColumn("next_offset", at)


def difficulty(quality: Column, retention: Column, n_medium: Column, n_slices: Column, grade_col: Column) -> Column:
    """0 easy .. 1 hard: half lost quality, 0.3 lost retention, 0.2 density of medium findings; D is at least 0.9."""
    q = F.lit(1.0) - F.coalesce(quality, F.lit(0.0))
    r = F.lit(1.0) - F.coalesce(retention, F.lit(0.0))
    density = F.when(n_slices > 0, F.least(F.lit(1.0), n_medium / n_slices)).otherwise(F.lit(0.0))
    d = 0.5 * q + 0.3 * r + 0.2 * density
    d = F.when(grade_col == "D", F.greatest(d, F.lit(0.9))).otherwise(d)
    return F.when(quality.isNotNull() | retention.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), d)))
