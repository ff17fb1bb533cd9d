"""Review workflow: display state, batch validation of actions, queue order, progress, release plan."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import ordinal, spread_join

STATES = ("not_started", "in_progress", "pending", "approved", "changed", "returned", "fixed")
QUEUE = ("pending", "changed")
# fixed values: action -> (display states it may start from, stored state it leads to)
TRANSITIONS = {
    "complete": (("not_started", "in_progress", "returned", "fixed"), "completed"),
    "uncomplete": (("pending",), "open"),
    "approve": (("pending", "changed"), "approved"),
    "request_changes": (("pending", "approved", "changed"), "changes_requested"),
    "revoke": (("approved", "changed"), "completed"),
}
DECISIONS = ("approve", "request_changes", "revoke")


def display_status(stored: Column, has_edits: Column, fresh: Column, edited_since: Column) -> Column:
    return (
        F.when(stored == "completed", "pending").when(stored == "approved", F.when(fresh, "approved").otherwise("changed"))
        .when(stored == "changes_requested", F.when(edited_since, "fixed").otherwise("returned")).otherwise(F.when(has_edits, "in_progress").otherwise("not_started"))
    )


def slice_states(slices: DataFrame, reviews: DataFrame, revisions: DataFrame, live: DataFrame, people: DataFrame, marks: DataFrame) -> DataFrame:
    """One row per (block, z): stored and display status, version, revision, live edits, contributors, open marks.

    Every side is one row per (block, z) before the join. Content counts as unchanged when the revision did not move or
    the content hash is the approved one (`sha`, `decided_sha`, where supplied)."""
    k = ["block_id", "z"]
    j = slices.select(*k).join(revisions, k, "left").join(reviews, k, "left").join(live, k, "left").join(people, k, "left").join(marks, k, "left")
    j = j.fillna(0, ["rev", "n_edits", "n_people", "open_marks", "version"]).withColumn("stored", F.coalesce("stored", F.lit("open")))
    same = F.col("rev") == F.col("decided_rev")
    if "sha" in slices.columns:
        same = same | (F.col("sha") == F.col("decided_sha"))
    same = F.coalesce(same, F.lit(False))
    return j.withColumn("status", display_status(F.col("stored"), F.col("n_edits") > 0, same, ~same))


def progress(states: DataFrame, keys: list[str]) -> DataFrame:
    return states.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_slices"), *[F.count_if(F.col("status") == s).alias(s) for s in STATES],
                                     F.count_if(F.col("status").isin(*QUEUE) & ~F.col("mine")).alias("reviewable"), F.count_if(F.col("status").isin("returned", "fixed") & (F.col("mine") | (F.col("n_people") == 0))).alias("todo"))


def validate_actions(requests: DataFrame, states: DataFrame) -> DataFrame:
    """Accept or reject a batch of requested actions with the first failing reason.

    `requests`: block_id, z, action, actor, role, is_contributor, expect_rev, expect_version, comment, confirm_marks, confirm_unattributed, completed_by_me."""
    j = requests.join(states, ["block_id", "z"], "left")
    a = F.col("action")
    allowed, to = F.lit(False), F.lit(None).cast("string")
    for name, (frm, target) in TRANSITIONS.items():
        allowed = F.when(a == name, F.col("status").isin(*frm)).otherwise(allowed)
        to = F.when(a == name, F.lit(target)).otherwise(to)
    decides = a.isin(*DECISIONS)
    reviewer = F.col("role").isin("reviewer", "admin")
    text = F.length(F.trim(F.coalesce("comment", F.lit("")))) > 0
    reason = (
        F.when(F.col("status").isNull(), "no_such_slice")
        .when(decides & ~reviewer, "forbidden")
        .when(decides & (F.col("expect_rev") != F.col("rev")), "stale")
        .when(F.col("expect_version") != F.col("version"), "conflict")
        .when(~allowed, "state")
        .when((a == "approve") & F.col("is_contributor"), "four_eyes")
        .when((a == "uncomplete") & ~reviewer & ~F.col("completed_by_me"), "forbidden")
        .when((a == "approve") & (((F.col("open_marks") > 0) & ~F.col("confirm_marks")) | ((F.col("n_unattributed") > 0) & ~F.col("confirm_unattributed"))), "confirm")
        .when((a == "request_changes") & ~text & (F.col("open_marks") == 0), "comment")
        .when((a == "revoke") & ~text, "comment")
    )
    return j.withColumn("reason", reason).withColumn("accepted", reason.isNull()).withColumn("new_stored", F.when(reason.isNull(), to))


def next_to_review(states: DataFrame, order: DataFrame, batch: str, block: str, z: int) -> DataFrame:
    """The next reviewable section from (block, z): rest of this block, following blocks of the batch around the circle,
    the start of this block, then the other batches around the circle. One row.

    `order`: batch_id, block_id, batch_no, block_no (positions in the overview)."""
    here = order.where((F.col("batch_id") == batch) & (F.col("block_id") == block)).select(F.col("batch_no").alias("_bt"), F.col("block_no").alias("_bl"))
    j = spread_join(states.where(F.col("reviewable")), order, ["block_id"], F.floor(F.col("z") / 1024).cast("long")).join(F.broadcast(here), F.lit(True))  # one row
    same_batch, same_block = F.col("batch_no") == F.col("_bt"), F.col("block_no") == F.col("_bl")
    phase = (
        F.when(same_block & (F.col("z") > z), 0).when(same_batch & ~same_block, F.when(F.col("block_no") > F.col("_bl"), 1).otherwise(2))
        .when(same_block & (F.col("z") < z), 3).when(~same_batch, F.when(F.col("batch_no") > F.col("_bt"), 4).otherwise(5))
    )
    j = j.withColumn("phase", phase).where("phase IS NOT NULL")
    return j.orderBy("phase", "batch_no", "block_no", "z").limit(1).select("batch_id", "block_id", "z", (F.col("phase") >= 4).alias("crossed_batch"))


def release_plan(states: DataFrame, keys: list[str] = ("block_id",)) -> tuple[DataFrame, DataFrame]:
    """(section plan, blocks left out): approved sections whose content did not change are released, others excluded with a reason."""
    plan = states.withColumn("included", F.col("status") == "approved").withColumn("reason", F.when(F.col("status") == "approved", F.lit(None)).otherwise(F.col("status")))
    skipped = plan.groupBy(*keys).agg(F.bool_or("included").alias("_any"), F.count(F.lit(1)).alias("n_slices")).where("NOT _any").select(*keys, "n_slices", F.lit("none_approved").alias("reason"))
    return plan, skipped


def released_planes(pixels: DataFrame, plan: DataFrame) -> DataFrame:
    """Label pixels of the release: sections that are not included are written as background, i.e. without pixels."""
    keep = plan.where("included").select("block_id", "z", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("_s"))
    return pixels.withColumn("_s", F.pmod(F.xxhash64("y", "x"), F.lit(32)).cast("int")).join(keep, ["block_id", "z", "_s"], "left_semi").drop("_s")


def content_hash(pixels: DataFrame, keys: list[str], width: int = 1) -> DataFrame:
    """Content hash of a label plane from its pixel rows: one digest per row of the plane (bounded by its width), then a digest of the row digests (bounded by its height)."""
    strip = F.floor(F.col("y") / width).cast("long")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "id"))), lambda p: F.concat_ws(":", p["y"], p["x"], p["id"])), ",")
    parts = pixels.groupBy(*keys, strip.alias("_strip")).agg(F.sha2(text, 256).alias("_h"))
    return parts.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_strip", "_h"))), lambda p: p["_h"]), ""), 256).alias("sha"))


def mark_threads(marks: DataFrame, comments: DataFrame) -> DataFrame:
    """Each mark's comments numbered in order; long threads are ranked in buckets of the comment id."""
    t = ordinal(comments, ["mark_id"], ["comment_id"], F.floor(F.col("comment_id") / 4096).cast("long"), "position")
    return t.join(marks.select("mark_id", "block_id", "z", "status"), "mark_id")


def protected_marks(marks: DataFrame, event_marks: DataFrame) -> DataFrame:
    """Marks cited by a review decision cannot be edited or deleted."""
    return marks.join(event_marks.select("mark_id"), "mark_id", "left_semi")
