"""Edit logs, provenance, review state and queue."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotation as A
from ..operators import review as R
from ..operators.ordered import spread_join
from ..sources import tables as T
from .registry import query, sql
from .views import view

# edits with a wider set of kinds than the supplied two
view("v_edits", """SELECT n, z, y, x, new_id, author, CASE n % 7 WHEN 0 THEN 'sam' WHEN 1 THEN 'repair' WHEN 2 THEN 'seed' WHEN 3 THEN 'other' ELSE kind END AS kind FROM v_edit_voxels""", "v_edit_voxels")

view("v_prov", """
SELECT p.z, p.y, p.x, CASE WHEN p.id = 1 THEN 0 ELSE p.id END AS before, CASE WHEN p.id_after = 8 THEN 0 ELSE p.id_after END AS after, w.n,
  CASE WHEN w.new_id = CASE WHEN p.id_after = 8 THEN 0 ELSE p.id_after END THEN w.author END AS author0,
  CASE WHEN w.n IS NULL THEN CASE WHEN p.id <> p.id_after THEN 'unknown' ELSE 'baseline' END
       WHEN w.new_id <> CASE WHEN p.id_after = 8 THEN 0 ELSE p.id_after END THEN 'unknown' WHEN kind = 'sam' THEN 'sam' WHEN kind = 'repair' THEN 'interpolation' WHEN kind = 'seed' THEN 'assisted'
       WHEN kind IN ('paint', 'merge') THEN 'manual' ELSE 'unknown' END AS source0
FROM v_pixels p LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY z, y, x ORDER BY n DESC) AS rn FROM v_edits) WHERE rn = 1) w ON w.z = p.z AND w.y = p.y AND w.x = p.x""", "v_pixels", "v_edits")
# edit number 1000 of section 2 and edit 500 of the whole block cannot be read
view("v_provu", """SELECT z, y, x, before, after, CASE WHEN n < CASE WHEN z = 2 THEN 1000 ELSE 500 END THEN 'unknown' ELSE source0 END AS source,
  CASE WHEN n < CASE WHEN z = 2 THEN 1000 ELSE 500 END THEN NULL ELSE author0 END AS author FROM v_prov""", "v_prov")


def edits(spark, sf):
    k = F.col("n") % 7
    return T.edit_voxels(spark, sf).withColumn("kind", F.when(k == 0, "sam").when(k == 1, "repair").when(k == 2, "seed").when(k == 3, "other").otherwise(F.col("kind")))


def provenance(spark, sf):
    p = T.pixels(spark, sf)
    before = p.select("z", "y", "x", F.when(F.col("id") == 1, 0).otherwise(F.col("id")).alias("id"))
    after = p.select("z", "y", "x", F.when(F.col("id_after") == 8, 0).otherwise(F.col("id_after")).alias("id"))
    gone = spark.createDataFrame([(1000, 2), (500, None)], "n long, z long")  # two damaged log entries
    return A.pixel_provenance(before, after, edits(spark, sf), gone)


@query("last_writer", "WIN9, JN13", sql("v_edits", body="""
SELECT z, y, x, n, new_id, author, kind FROM (SELECT *, row_number() OVER (PARTITION BY z, y, x ORDER BY n DESC) AS rn FROM v_edits) WHERE rn = 1"""))
def last_writer(spark, sf):
    return A.last_writes(edits(spark, sf)).select("z", "y", "x", "n", "new_id", "author", "kind")


_SRC = ", ".join(f"count(*) FILTER (source = '{s}') AS {s}_px" for s in A.SOURCES)


@query("provenance_totals", "AGG26, JN12, SET5", sql("v_provu", body=f"""
SELECT z, count(*) AS px, count(*) FILTER (before <> after) AS changed_px, count(*) FILTER (before = 0 AND after <> 0) AS added_px, count(*) FILTER (before <> 0 AND after = 0) AS removed_px,
 count(*) FILTER (before <> 0 AND after <> 0 AND before <> after) AS relabeled_px, {_SRC} FROM v_provu GROUP BY ROLLUP (z)"""))
def provenance_totals(spark, sf):
    return A.provenance_totals(provenance(spark, sf))


_SRCL = ", ".join(f"count(*) FILTER (source = '{s}') AS {s}" for s in A.SOURCES)
_LAB = {"b": "SELECT z, before AS label, count(*) AS before_px FROM v_provu GROUP BY z, before",
        "a": f"SELECT z, after AS label, count(*) AS current_px, count(*) FILTER (before <> after) AS changed_px, {_SRCL} FROM v_provu GROUP BY z, after"}
_LABB = "SELECT coalesce(a.z, b.z) AS z, coalesce(a.label, b.label) AS label, coalesce(before_px, 0) AS before_px, coalesce(current_px, 0) AS current_px, coalesce(changed_px, 0) AS changed_px, " + ", ".join(
    f"coalesce({s}, 0) AS {s}" for s in A.SOURCES) + ", " + " + ".join(f"CASE WHEN {s} > 0 THEN 1 ELSE 0 END" for s in A.SOURCES) + " > 1 AS mixed FROM a FULL OUTER JOIN b ON a.z = b.z AND a.label = b.label"


@query("provenance_labels", "AGG26", sql("v_provu", ctes=_LAB, body=_LABB))
def provenance_labels(spark, sf):
    return A.provenance_labels(provenance(spark, sf))


@query("provenance_editors", "AGG26", sql("v_provu", body="SELECT z, after AS label, author, count(*) AS px FROM v_provu WHERE author IS NOT NULL GROUP BY z, after, author"))
def provenance_editors(spark, sf):
    return A.provenance_editors(provenance(spark, sf))


@query("provenance_csv", "SNK7", sql("v_provu", ctes={**_LAB, "l": _LABB, "e": "SELECT z, after AS label, string_agg(concat(author, ':', px), ';' ORDER BY px DESC, author) AS editors FROM (SELECT z, after, author, count(*) AS px FROM v_provu WHERE author IS NOT NULL GROUP BY z, after, author) GROUP BY z, after"}, body="""
SELECT CASE WHEN l.label % 2 = 0 THEN '''=block' ELSE 'block' END AS block_id, l.z, CAST(l.label AS VARCHAR) AS label_id, before_px, current_px, changed_px, editors FROM l LEFT JOIN e ON e.z = l.z AND e.label = l.label"""))
def provenance_csv(spark, sf):
    p = provenance(spark, sf)
    # at most one entry per editor and label
    e = A.provenance_editors(p).groupBy("z", "label").agg(F.sort_array(F.collect_list(F.struct((-F.col("px")).alias("o"), "author"))).alias("l"))
    e = e.select("z", "label", F.array_join(F.transform("l", lambda s: F.concat_ws(":", s["author"], -s["o"])), ";").alias("editors"))
    j = A.provenance_labels(p).join(e, ["z", "label"], "left")
    name = A.csv_guard(F.when(F.col("label") % 2 == 0, "=block").otherwise("block"))
    return j.select(name.alias("block_id"), "z", F.col("label").cast("string").alias("label_id"), "before_px", "current_px", "changed_px", "editors")


# undone as a whole: label 3 written by A; undone on section 3 only: label 5
@query("edit_replay", "ALG7", sql("v_edits", "v_pixels", ctes={
    "live": "SELECT * FROM v_edits WHERE NOT (new_id = 3 AND author = 'A') AND NOT (new_id = 5 AND z = 3)",
    "w": "SELECT z, y, x, new_id FROM (SELECT *, row_number() OVER (PARTITION BY z, y, x ORDER BY n DESC) AS rn FROM live) WHERE rn = 1"}, body="""
SELECT coalesce(p.z, w.z) AS z, coalesce(p.y, w.y) AS y, coalesce(p.x, w.x) AS x, coalesce(new_id, id) AS id FROM v_pixels p FULL OUTER JOIN w ON w.z = p.z AND w.y = p.y AND w.x = p.x"""))
def edit_replay(spark, sf):
    e = edits(spark, sf)
    undone = e.where("new_id = 3 AND author = 'A'").select("n", F.lit(None).cast("long").alias("z")).unionByName(e.where("new_id = 5 AND z = 3").select("n", "z"))
    return A.replay(T.pixels(spark, sf), e, undone)


@query("label_merge", "ALG7 merge", sql("v_pixels", body="SELECT z, CASE WHEN id = 2 AND z = 4 THEN 6 WHEN id = 2 THEN 5 WHEN id = 3 THEN 7 ELSE id END AS id, count(*) AS n FROM v_pixels GROUP BY 1, 2"))
def label_merge(spark, sf):
    rules = spark.createDataFrame([(2, 5, None), (2, 6, 4), (3, 7, None)], "from_id long, to_id long, z long")
    return A.merge_labels(T.pixels(spark, sf).select("z", "y", "x", "id"), rules).groupBy("z", "id").agg(F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------------------------- audit log

view("v_slots", "SELECT b.block_id, CAST(k AS BIGINT) AS z FROM (SELECT DISTINCT block_id FROM v_audit) b, (SELECT unnest(range(0, (SELECT max(z) + 1 FROM v_audit))) AS k)", "v_audit")


def slots(spark, sf):
    """Every section of every block, up to the largest that the log names."""
    a = T.audit(spark, sf)
    top = a.agg(F.max("z").alias("_top"))
    return a.select("block_id").distinct().crossJoin(F.broadcast(top)).select("block_id", F.explode(F.sequence(F.lit(0).cast("long"), "_top")).alias("z"))  # against one row


@query("slice_revision", "WIN10", sql("v_slots", body="SELECT s.block_id, s.z, coalesce(max(a.seq), 0) AS rev FROM v_slots s LEFT JOIN v_audit a ON a.block_id = s.block_id AND (a.z IS NULL OR a.z = s.z) GROUP BY s.block_id, s.z"))
def slice_revision(spark, sf):
    return A.slice_revisions(T.audit(spark, sf), slots(spark, sf))


@query("conflicts", "WIN11", sql("v_slots", body="""
SELECT block_id, z, viewer, since, seq, author, action FROM (SELECT s.block_id, s.z, v.viewer, 1 AS since, a.seq, a.author, a.action, row_number() OVER (PARTITION BY s.block_id, s.z, v.viewer ORDER BY a.seq DESC) AS rn
 FROM v_slots s, (SELECT unnest(['user', 'assistant']) AS viewer) v, v_audit a WHERE a.block_id = s.block_id AND (a.z IS NULL OR a.z = s.z) AND a.seq > 1 AND a.author <> v.viewer) WHERE rn = 1"""))
def conflicts(spark, sf):
    v = slots(spark, sf).withColumn("viewer", F.explode(F.array(F.lit("user"), F.lit("assistant")))).withColumn("since", F.lit(1))
    return A.conflicts(T.audit(spark, sf), v)


_CONTRIB = {
    # live edits: section edits not followed by an undo of their block later on
    "live": "SELECT a.block_id, a.z, a.seq AS n, a.author AS person FROM v_audit a WHERE action = 'edit' AND z IS NOT NULL AND seq % 3 <> 0",
    "rows": """SELECT block_id, z, person, 1 AS c FROM live UNION ALL SELECT block_id, z, CASE WHEN n_px % 5 = 0 THEN NULL ELSE author END, 1 FROM v_audit WHERE z IS NOT NULL
       UNION ALL SELECT s.block_id, s.z, CASE WHEN n_px % 5 = 0 THEN NULL ELSE author END, 1 FROM v_audit a JOIN v_slots s ON s.block_id = a.block_id WHERE a.z IS NULL AND (action = 'undo' OR seq % 2 = 1 OR s.z IN (1, 2))""",
}


def _log(spark, sf):
    """Audit rows with a person (some unattributed) and, for even block-wide edits, the list of sections they reached."""
    a = T.audit(spark, sf)
    zs = F.when(F.col("z").isNull() & (F.col("action") == "edit") & (F.col("seq") % 2 == 0), F.array(F.lit(1).cast("long"), F.lit(2).cast("long")))
    return a.withColumn("person", F.when(F.col("n_px") % 5 != 0, F.col("author"))).withColumn("zs", zs).withColumn("n", F.col("seq"))


def _live(spark, sf):
    return T.audit(spark, sf).where("action = 'edit' AND z IS NOT NULL AND seq % 3 <> 0").select("block_id", "z", F.col("seq").alias("n"), F.col("author").alias("person"))


@query("contributors", "AGG28", sql("v_slots", ctes=_CONTRIB, body="SELECT block_id, z, person, CAST(sum(c) AS BIGINT) AS n FROM rows WHERE person IS NOT NULL GROUP BY block_id, z, person"))
def contributors(spark, sf):
    people, _ = A.contributors(_live(spark, sf), _log(spark, sf), slots(spark, sf))
    return people


@query("editor_activity", "AGG27", sql("v_audit", body="""
SELECT author AS person, count(*) AS n, CAST(sum(n_px) AS BIGINT) AS n_px, count(DISTINCT block_id) AS n_blocks, min(seq) AS first, max(seq) AS last FROM v_audit GROUP BY author"""))
def editor_activity(spark, sf):
    return A.editor_activity(T.audit(spark, sf).select(F.col("author").alias("person"), "block_id", "n_px", F.col("seq").alias("ts")))


# ----------------------------------------------------------------------------- review

_ST = {
    "rev": "SELECT s.block_id, s.z, coalesce(max(a.seq), 0) AS rev FROM v_slots s LEFT JOIN v_audit a ON a.block_id = s.block_id AND (a.z IS NULL OR a.z = s.z) GROUP BY s.block_id, s.z",
    "lv": "SELECT block_id, z, count(*) AS n_edits FROM v_audit WHERE action = 'edit' AND z IS NOT NULL GROUP BY block_id, z",
    "pp": "SELECT block_id, z, count(DISTINCT author) AS n_people, bool_or(author = 'user') AS mine FROM v_audit WHERE z IS NOT NULL GROUP BY block_id, z",
    "mk": "SELECT block_id, z, count(*) AS open_marks FROM v_audit WHERE z IS NOT NULL AND n_px % 9 = 0 GROUP BY block_id, z",
    "st0": """SELECT rev.block_id, rev.z, coalesce(stored, 'open') AS stored, coalesce(version, 0) AS version, rev, coalesce(n_edits, 0) AS n_edits, coalesce(n_people, 0) AS n_people, coalesce(mine, false) AS mine, coalesce(open_marks, 0) AS open_marks,
       coalesce(rev = decided_rev, false) AS same FROM rev LEFT JOIN v_reviews r ON r.block_id = rev.block_id AND r.z = rev.z LEFT JOIN lv ON lv.block_id = rev.block_id AND lv.z = rev.z
       LEFT JOIN pp ON pp.block_id = rev.block_id AND pp.z = rev.z LEFT JOIN mk ON mk.block_id = rev.block_id AND mk.z = rev.z""",
    "st": """SELECT *, CASE stored WHEN 'completed' THEN 'pending' WHEN 'approved' THEN CASE WHEN same THEN 'approved' ELSE 'changed' END WHEN 'changes_requested' THEN CASE WHEN same THEN 'returned' ELSE 'fixed' END
       ELSE CASE WHEN n_edits > 0 THEN 'in_progress' ELSE 'not_started' END END AS status FROM st0""",
}


def states(spark, sf):
    a = T.audit(spark, sf)
    own = a.where("z IS NOT NULL")
    k = ["block_id", "z"]
    live = own.where("action = 'edit'").groupBy(*k).agg(F.count(F.lit(1)).alias("n_edits"))
    people = own.select(*k, "author").distinct().groupBy(*k).agg(F.count(F.lit(1)).alias("n_people"), F.bool_or(F.col("author") == "user").alias("mine"))
    marks = own.where("n_px % 9 = 0").groupBy(*k).agg(F.count(F.lit(1)).alias("open_marks"))
    s = slots(spark, sf)
    return R.slice_states(s, T.reviews(spark, sf, a), A.slice_revisions(a, s), live, people, marks).withColumn("mine", F.coalesce("mine", F.lit(False)))


@query("review_status", "ALG15, JN16, AGG30", sql("v_slots", "v_reviews", ctes=_ST, body="SELECT block_id, z, stored, status, version, rev, n_edits, n_people, open_marks FROM st"))
def review_status(spark, sf):
    return states(spark, sf).select("block_id", "z", "stored", "status", "version", "rev", "n_edits", "n_people", "open_marks")


_PROG = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in R.STATES)


@query("batch_progress", "AGG29", sql("v_slots", "v_reviews", ctes=_ST, body=f"""
SELECT concat('batch', substr(block_id, length(block_id), 1)) AS batch_id, count(*) AS n_slices, {_PROG}, count(*) FILTER (status IN ('pending', 'changed') AND NOT mine) AS reviewable,
 count(*) FILTER (status IN ('returned', 'fixed') AND (mine OR n_people = 0)) AS todo FROM st GROUP BY 1"""))
def batch_progress(spark, sf):
    s = states(spark, sf).withColumn("batch_id", F.concat(F.lit("batch"), F.substring("block_id", -1, 1)))
    return R.progress(s, ["batch_id"])


# one request per section: actor, role and expectations derived from the section itself
_RQ = """SELECT *, CASE (rev + z) % 5 WHEN 0 THEN 'complete' WHEN 1 THEN 'uncomplete' WHEN 2 THEN 'approve' WHEN 3 THEN 'request_changes' ELSE 'revoke' END AS action,
  CASE z % 3 WHEN 0 THEN 'annotator' ELSE 'reviewer' END AS role, CASE WHEN z = 7 THEN rev + 1 ELSE rev END AS expect_rev, CASE WHEN z = 6 THEN version + 1 ELSE version END AS expect_version, CASE WHEN z % 2 = 0 THEN 'why' ELSE ' ' END AS comment FROM st"""
_VA = """CASE WHEN action IN ('approve', 'request_changes', 'revoke') AND role <> 'reviewer' THEN 'forbidden' WHEN action IN ('approve', 'request_changes', 'revoke') AND expect_rev <> rev THEN 'stale'
  WHEN expect_version <> version THEN 'conflict'
  WHEN NOT CASE action WHEN 'complete' THEN status IN ('not_started', 'in_progress', 'returned', 'fixed') WHEN 'uncomplete' THEN status = 'pending' WHEN 'approve' THEN status IN ('pending', 'changed')
     WHEN 'request_changes' THEN status IN ('pending', 'approved', 'changed') ELSE status IN ('approved', 'changed') END THEN 'state'
  WHEN action = 'approve' AND mine THEN 'four_eyes' WHEN action = 'uncomplete' AND role <> 'reviewer' THEN 'forbidden' WHEN action = 'approve' AND open_marks > 0 THEN 'confirm'
  WHEN action = 'request_changes' AND length(trim(comment)) = 0 AND open_marks = 0 THEN 'comment' WHEN action = 'revoke' AND length(trim(comment)) = 0 THEN 'comment' END"""


@query("review_actions", "ALG16", sql("v_slots", "v_reviews", ctes={**_ST, "rq": _RQ, "va": f"SELECT *, {_VA} AS reason FROM rq"}, body="""
SELECT block_id, z, action, reason IS NULL AS accepted, reason, CASE WHEN reason IS NULL THEN CASE action WHEN 'complete' THEN 'completed' WHEN 'uncomplete' THEN 'open' WHEN 'approve' THEN 'approved' WHEN 'request_changes' THEN 'changes_requested' ELSE 'completed' END END AS new_stored FROM va"""))
def review_actions(spark, sf):
    s = states(spark, sf)
    z, pick = F.col("z"), (F.col("rev") + F.col("z")) % 5
    action = F.when(pick == 0, "complete").when(pick == 1, "uncomplete").when(pick == 2, "approve").when(pick == 3, "request_changes").otherwise("revoke")
    req = s.select("block_id", "z", action.alias("action"), F.when(z % 3 == 0, "annotator").otherwise("reviewer").alias("role"), F.col("mine").alias("is_contributor"),
                   F.when(z == 7, F.col("rev") + 1).otherwise(F.col("rev")).alias("expect_rev"), F.when(z == 6, F.col("version") + 1).otherwise(F.col("version")).alias("expect_version"),
                   F.when(z % 2 == 0, "why").otherwise(" ").alias("comment"), F.lit(False).alias("confirm_marks"), F.lit(False).alias("confirm_unattributed"), F.lit(False).alias("completed_by_me"))
    v = R.validate_actions(req, s.withColumn("n_unattributed", F.lit(0)))
    return v.select("block_id", "z", "action", "accepted", "reason", "new_stored")


_ORD = """SELECT block_id, concat('batch', substr(block_id, length(block_id), 1)) AS batch_id, CAST(substr(block_id, length(block_id), 1) AS INTEGER) AS batch_no, row_number() OVER (ORDER BY block_id) AS block_no FROM (SELECT DISTINCT block_id FROM v_slots)"""


@query("review_queue", "WIN12", sql("v_slots", "v_reviews", ctes={**_ST, "ord": _ORD, "h": "SELECT batch_no AS bt, block_no AS bl FROM ord WHERE block_id = 'b00003'",
    "q": """SELECT ord.batch_id, st.block_id, st.z, batch_no, block_no, CASE WHEN block_no = bl AND z > 2 THEN 0 WHEN batch_no = bt AND block_no > bl THEN 1 WHEN batch_no = bt AND block_no < bl THEN 2 WHEN block_no = bl AND z < 2 THEN 3
       WHEN batch_no > bt THEN 4 WHEN batch_no < bt THEN 5 END AS phase FROM st JOIN ord ON ord.block_id = st.block_id, h WHERE status IN ('pending', 'changed') AND NOT mine"""}, body="""
SELECT batch_id, block_id, z, phase >= 4 AS crossed_batch FROM q WHERE phase IS NOT NULL ORDER BY phase, batch_no, block_no, z LIMIT 1"""))
def review_queue(spark, sf):
    from ..operators.ordered import ordinal

    s = states(spark, sf).withColumn("reviewable", F.col("status").isin(*R.QUEUE) & ~F.col("mine"))
    b = T.audit(spark, sf).select("block_id").distinct()
    last = F.substring("block_id", -1, 1)
    b = ordinal(b, [], ["block_id"], F.substring("block_id", 2, 12).cast("long"), "block_no")
    order = b.select("block_id", F.concat(F.lit("batch"), last).alias("batch_id"), last.cast("int").alias("batch_no"), "block_no")
    return R.next_to_review(s, order, "batch3", "b00003", 2)


@query("release_plan", "ALG17", sql("v_slots", "v_reviews", ctes={**_ST, "b": "SELECT block_id, bool_or(status = 'approved') AS any_ok FROM st GROUP BY block_id"}, body="""
SELECT st.block_id, z, status = 'approved' AS included, CASE WHEN status <> 'approved' THEN status END AS reason, NOT any_ok AS block_skipped FROM st JOIN b ON b.block_id = st.block_id"""))
def release_plan(spark, sf):
    plan, skipped = R.release_plan(states(spark, sf))
    return plan.join(skipped.select("block_id", F.lit(True).alias("_s")), "block_id", "left").select("block_id", "z", "included", "reason", F.coalesce("_s", F.lit(False)).alias("block_skipped"))


@query("content_hash", "ALG8", sql(body="SELECT doc_id, source, sha256(text) AS sha FROM documents"))
def content_hash(spark, sf):
    return T.load(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha"))


@query("plane_hash", "ALG8", sql("v_pixels", ctes={"r": "SELECT z, y, sha256(string_agg(concat(y, ':', x, ':', id), ',' ORDER BY x)) AS h FROM v_pixels GROUP BY z, y"}, body="SELECT z, sha256(string_agg(h, '' ORDER BY y)) AS sha FROM r GROUP BY z"))
def plane_hash(spark, sf):
    return R.content_hash(T.pixels(spark, sf), ["z"])


# the first operation of every section is a mark, later operations there are comments on it; an undo in the block cites its marks
@query("mark_threads", "AGG30, JN17", sql("v_audit", ctes={"m": "SELECT block_id, z, min(seq) AS mark_seq FROM v_audit WHERE z IS NOT NULL GROUP BY block_id, z", "ev": "SELECT DISTINCT block_id FROM v_audit WHERE action = 'undo'"}, body="""
SELECT m.block_id, m.z, m.mark_seq, a.seq AS comment_id, row_number() OVER (PARTITION BY m.block_id, m.z ORDER BY a.seq) - 1 AS position, ev.block_id IS NOT NULL AS protected
FROM m JOIN v_audit a ON a.block_id = m.block_id AND a.z = m.z AND a.seq > m.mark_seq LEFT JOIN ev ON ev.block_id = m.block_id"""))
def mark_threads(spark, sf):
    a = T.audit(spark, sf).withColumn("mark_id", F.concat_ws("/", "block_id", "z"))
    marks = a.where("z IS NOT NULL").groupBy("mark_id", "block_id", "z").agg(F.min("seq").alias("mark_seq")).withColumn("status", F.lit("open"))
    later = spread_join(a.where("z IS NOT NULL").select("mark_id", F.col("seq").alias("comment_id")), marks.select("mark_id", "mark_seq"), ["mark_id"], F.floor(F.col("comment_id") / 4096).cast("long"))
    c = later.where("comment_id > mark_seq")
    t = R.mark_threads(marks, c.select("mark_id", "comment_id")).join(marks.select("mark_id", "mark_seq"), "mark_id")
    cited = marks.join(a.where("action = 'undo'").select("block_id").distinct(), "block_id", "left_semi").select("mark_id")
    guard = R.protected_marks(marks, cited).select("mark_id", F.lit(True).alias("_p"))
    return t.join(guard, "mark_id", "left").select("block_id", "z", "mark_seq", "comment_id", "position", F.coalesce("_p", F.lit(False)).alias("protected"))


@query("neighbour_vote", "ALG18, JN14", sql("v_pixels", ctes={
    "m": "SELECT id AS q, z, y, x FROM v_pixels", "sz": "SELECT q, z, count(*) AS n FROM m GROUP BY q, z",
    "v": "SELECT m.q, m.z AS qz, p.z, p.id, count(*) AS px FROM m JOIN v_pixels p ON p.y = m.y AND p.x = m.x AND p.z <> m.z AND abs(p.z - m.z) <= 3 WHERE p.id <> 0 GROUP BY 1, 2, 3, 4",
    "t": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, qz, z ORDER BY px DESC, id) AS rn FROM v) WHERE rn = 1",
    "s": "SELECT t.q, t.qz, t.z, t.id, t.px, t.px / CAST(sz.n AS DOUBLE) AS share, abs(t.z - t.qz) AS distance, count(*) OVER (PARTITION BY t.q, qz, id) AS n_slices, row_number() OVER (PARTITION BY t.q, qz, id ORDER BY abs(t.z - t.qz), t.px DESC, t.z) AS k FROM t JOIN sz ON sz.z = t.qz AND sz.q = t.q"}, body="""
SELECT q AS label, qz AS z, id, distance, z AS z_src, round(share, 8) AS share, px, n_slices, CAST(row_number() OVER (PARTITION BY q, qz ORDER BY distance, share DESC, id) AS INTEGER) AS rank FROM s WHERE k = 1"""))
def neighbour_vote(spark, sf):
    p = T.pixels(spark, sf).select("z", "y", "x", "id")
    m = p.select(F.col("id").alias("query_id"), "z", "y", "x")
    v = A.neighbour_votes(p, m, 3)
    return v.select(F.col("query_id").alias("label"), F.col("qz").alias("z"), "id", "distance", "z_src", F.round("share", 8).alias("share"), "px", "n_slices", "rank")
