"""Edit logs: last writer, provenance, replay, contributors, revisions, neighbour votes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import label_components
from .ordered import spread_join

SOURCES = ("baseline", "manual", "sam", "interpolation", "assisted", "unknown")
PX = ["z", "y", "x"]


def source_of(kind: Column) -> Column:
    return (
        F.when(kind == "repair", "interpolation").when(kind == "sam", "sam").when(kind.isin("smartfill", "refine", "seed", "bigfill"), "assisted")
        .when(kind.isin("paint", "fill", "merge", "split", "clear"), "manual").otherwise("unknown")
    )


def last_writes(edits: DataFrame) -> DataFrame:
    """Newest edit per pixel: a maximum over (n, payload), combined before the shuffle, so a pixel painted a million times is one row."""
    return edits.groupBy(*PX).agg(F.max(F.struct("n", "new_id", "author", "kind")).alias("w")).select(*PX, "w.*")


def pixel_provenance(before: DataFrame, after: DataFrame, edits: DataFrame, unreadable: DataFrame | None = None, sam_first_id: int | None = None) -> DataFrame:
    """Per pixel: before, after, source, author. Rows: `before` / `after` (z, y, x, id); absent is background 0.

    The newest write counts only if its label is still there; a changed pixel without a matching write is unknown. An edit
    whose pixels cannot be read makes every pixel without a later write unknown (`unreadable`: n and z, NULL z = all)."""
    j = before.select(*PX, F.col("id").alias("_b")).join(after.select(*PX, F.col("id").alias("_a")), PX, "full_outer")
    none = F.lit(0).cast("decimal(20,0)")  # ids are unsigned 64-bit
    wide = "decimal(20,0)" if any(dict(d.dtypes)["id"].startswith("decimal") for d in (before, after)) else "long"
    j = j.join(last_writes(edits), PX, "full_outer")
    j = j.withColumn("before", F.coalesce("_b", none).cast(wide)).withColumn("after", F.coalesce("_a", none).cast(wide)).drop("_b", "_a")
    prefill = (F.col("before") >= sam_first_id) if sam_first_id is not None else F.lit(False)
    base = F.when(F.col("before") != F.col("after"), "unknown").when(prefill, "sam").otherwise("baseline")
    confirmed = F.col("n").isNotNull() & (F.col("new_id") == F.col("after"))
    source = F.when(F.col("n").isNull(), base).when(confirmed, source_of(F.col("kind"))).otherwise("unknown")
    author = F.when(confirmed, F.col("author"))
    if unreadable is not None:
        # one row per section (or per block): the newest unreadable edit that may have touched it
        u = unreadable.groupBy(F.coalesce(F.col("z"), F.lit(-1)).alias("uz")).agg(F.max("n").alias("un"))
        whole = u.where("uz = -1").agg(F.max("un").alias("un_all"))
        per_z = u.where("uz >= 0").select(F.col("uz").alias("z"), F.col("un").alias("un_z"))
        j = spread_join(j, per_z, ["z"], F.floor(F.col("y") / 64).cast("long"), "left").join(F.broadcast(whole), F.lit(True))
        late = F.greatest(F.coalesce("un_z", F.lit(0)), F.coalesce("un_all", F.lit(0)))
        lost = F.coalesce(F.col("n"), F.lit(0)) < late
        source, author = F.when(lost, "unknown").otherwise(source), F.when(~lost, author)
    return j.select(*PX, "before", "after", source.alias("source"), author.alias("author"))


def provenance_totals(prov: DataFrame) -> DataFrame:
    """Per section and for the whole block (z NULL): changed, added, removed, relabelled pixels and pixels per source."""
    b, a = F.col("before"), F.col("after")
    aggs = [F.count(F.lit(1)).alias("px"), F.count_if(b != a).alias("changed_px"), F.count_if((b == 0) & (a != 0)).alias("added_px"),
            F.count_if((b != 0) & (a == 0)).alias("removed_px"), F.count_if((b != 0) & (a != 0) & (a != b)).alias("relabeled_px")]
    aggs += [F.count_if(F.col("source") == s).alias(f"{s}_px") for s in SOURCES]
    return prov.rollup("z").agg(*aggs)


def provenance_labels(prov: DataFrame) -> DataFrame:
    """Per (section, label): pixels before and now, changed pixels, pixels per source, mixed flag."""
    before = prov.groupBy("z", F.col("before").alias("label")).agg(F.count(F.lit(1)).alias("before_px"))
    now = prov.groupBy("z", F.col("after").alias("label")).agg(
        F.count(F.lit(1)).alias("current_px"), F.count_if(F.col("before") != F.col("after")).alias("changed_px"), *[F.count_if(F.col("source") == s).alias(s) for s in SOURCES])
    j = before.join(now, ["z", "label"], "full_outer").fillna(0)
    kinds = sum((F.col(s) > 0).cast("int") for s in SOURCES)
    return j.withColumn("mixed", kinds > 1)


def provenance_editors(prov: DataFrame) -> DataFrame:
    return prov.where("author IS NOT NULL").groupBy("z", F.col("after").alias("label"), "author").agg(F.count(F.lit(1)).alias("px"))


def csv_guard(col: Column) -> Column:
    """Text that a spreadsheet would run as a formula gets a leading quote."""
    return F.when(col.rlike(r"^[=+\-@\t\r\n]"), F.concat(F.lit("'"), col)).otherwise(col)


def changed_regions(prov: DataFrame, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """(regions, hidden totals) of changed pixels, 8-connected, largest first per section, at most `limit` listed per section."""
    changed = prov.where("before <> after")
    lab = label_components(changed, 8).join(changed.select(*PX, "before", "after", "author"), PX)
    base = lab.groupBy("z", "component").agg(F.count(F.lit(1)).alias("px"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"),
                                             F.floor(F.avg("x")).alias("cx"), F.floor(F.avg("y")).alias("cy"))

    def majority(col, out):
        per = lab.where(F.col(col).isNotNull()).groupBy("z", "component", col).agg(F.count(F.lit(1)).alias("_n"))
        best = F.min(F.struct((-F.col("_n")).alias("o"), F.col(col).alias("v")))
        return per.groupBy("z", "component").agg(best.alias("_m")).select("z", "component", F.col("_m.v").alias(out))

    r = base
    for col, out in (("before", "from_id"), ("after", "to_id"), ("author", "by")):
        r = r.join(majority(col, out), ["z", "component"], "left")
    w = Window.partitionBy("z").orderBy(F.col("px").desc(), "component")
    shown = r.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    tot = base.groupBy("z").agg(F.count(F.lit(1)).alias("n_total"), F.sum("px").alias("px_total"))
    seen = shown.groupBy("z").agg(F.count(F.lit(1)).alias("_n"), F.sum("px").alias("_p"))
    hidden = tot.join(seen, "z").select("z", "n_total", (F.col("n_total") - F.col("_n")).alias("hidden"), (F.col("px_total") - F.col("_p")).alias("hidden_px"))
    return shown, hidden


def replay(before: DataFrame, edits: DataFrame, undone: DataFrame) -> DataFrame:
    """Current labels after the edit log: the newest surviving write wins. `undone` rows (n, z) remove an edit on one section, NULL z everywhere."""
    whole = undone.where("z IS NULL").select("n").distinct()
    one = undone.where("z IS NOT NULL").select("n", "z").distinct()
    live = edits.join(whole, "n", "left_anti").join(one, ["n", "z"], "left_anti")
    w = last_writes(live)
    j = before.select(*PX, "id").join(w.select(*PX, "new_id"), PX, "full_outer")
    return j.select(*PX, F.coalesce("new_id", "id").alias("id"))


def merge_labels(pixels: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rename labels through a (from_id, to_id) table; a section-scoped rule carries its z, NULL z is the whole block.

    Rules meet pixels on (label, section), so one label that fills a third of the volume still spreads by section."""
    zs = pixels.select("z", "id").distinct()
    rules = zs.join(mapping.select(F.col("from_id").alias("id"), "to_id", F.col("z").alias("rz")), "id").where("rz IS NULL OR rz = z")
    rules = rules.groupBy("z", "id").agg(F.max_by("to_id", F.coalesce("rz", F.lit(-1))).alias("to_id"))
    j = spread_join(pixels, rules, ["z", "id"], F.floor(F.col("y") / 64).cast("long"), "left")
    return j.withColumn("id", F.coalesce("to_id", "id")).drop("to_id")


def editor_activity(log: DataFrame) -> DataFrame:
    """Per person: edits, pixels, blocks, first and last; people keyed by id, else account, else name."""
    per_block = log.groupBy("person", "block_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_px").alias("n_px"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return per_block.groupBy("person").agg(F.sum("n").alias("n"), F.sum("n_px").alias("n_px"), F.count(F.lit(1)).alias("n_blocks"), F.min("first").alias("first"), F.max("last").alias("last"))


def person_key(by_id: Column, by_user: Column, by: Column) -> Column:
    return F.when(by_id.isNotNull(), F.concat(F.lit("id:"), by_id.cast("string"))).when(by_user.isNotNull() & (by_user != ""), F.concat(F.lit("user:"), by_user)).when(
        by.isNotNull() & (by != ""), F.concat(F.lit("name:"), by))


def slice_revisions(log: DataFrame, slices: DataFrame) -> DataFrame:
    """Per (block, z): the last sequence number that touched it, including block-wide operations (NULL z)."""
    own = log.where("z IS NOT NULL").groupBy("block_id", "z").agg(F.max("seq").alias("own"))
    wide = log.where("z IS NULL").groupBy("block_id").agg(F.max("seq").alias("wide"))
    s = slices.join(own, ["block_id", "z"], "left")
    s = spread_join(s, wide, ["block_id"], F.floor(F.col("z") / 1024).cast("long"), "left")
    return s.select("block_id", "z", F.greatest(F.coalesce("own", F.lit(0)), F.coalesce("wide", F.lit(0))).cast("long").alias("rev"))


def conflicts(log: DataFrame, viewers: DataFrame) -> DataFrame:
    """Newest operation by somebody else after each viewer's revision. `viewers`: block_id, z, since, viewer.

    Per (block, z) only the newest operation and the newest one by a different author can matter, so the log is reduced
    to two candidates before it meets the viewers."""
    def two(df, keys):
        per = df.groupBy(*keys, "author").agg(F.max(F.struct("seq", "action")).alias("t"))
        best = per.groupBy(*keys).agg(F.max(F.struct(F.col("t.seq").alias("seq"), "author", F.col("t.action").alias("action"))).alias("a"))
        rest = per.join(best.select(*keys, F.col("a.author").alias("author")), [*keys, "author"], "left_anti")
        second = rest.groupBy(*keys).agg(F.max(F.struct(F.col("t.seq").alias("seq"), "author", F.col("t.action").alias("action"))).alias("b"))
        return best.join(second, keys, "left")

    own = two(log.where("z IS NOT NULL"), ["block_id", "z"]).select("block_id", "z", F.array("a", "b").alias("c1"))
    wide = two(log.where("z IS NULL"), ["block_id"]).select("block_id", F.array("a", "b").alias("c2"))
    v = viewers.join(own, ["block_id", "z"], "left")
    v = spread_join(v, wide, ["block_id"], F.floor(F.col("z") / 1024).cast("long"), "left")
    none = F.array().cast("array<struct<seq:bigint,author:string,action:string>>")
    cand = F.concat(F.coalesce("c1", none), F.coalesce("c2", none))
    hit = F.array_max(F.filter(cand, lambda c: c.isNotNull() & (c["seq"] > F.col("since")) & (c["author"] != F.col("viewer"))))
    return v.withColumn("_h", hit).where("_h IS NOT NULL").select("block_id", "z", "viewer", "since", F.col("_h.seq").alias("seq"), F.col("_h.author").alias("author"), F.col("_h.action").alias("action"))


def contributors(active: DataFrame, log: DataFrame, slices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(people per section, unattributed counts). `active`: live edits per section (block_id, z, n, person).

    Counted: authors of live edits, of every logged edit of the section, and of undos; a block-wide undo counts on all
    sections, a block-wide edit that is no longer live on the sections it lists (`zs`), or all when unlisted."""
    one = log.where("z IS NOT NULL AND action IN ('edit', 'undo')").select("block_id", "z", "person", "action")
    wide = log.where("z IS NULL")
    dead = wide.where("action = 'edit'").join(active.select("block_id", "n").distinct(), ["block_id", "n"], "left_anti")
    listed = dead.where("zs IS NOT NULL").select("block_id", F.explode("zs").alias("z"), "person", "action")
    every = wide.where("action = 'undo'").select("block_id", "person", "action").unionByName(dead.where("zs IS NULL").select("block_id", "person", "action"))
    # distinct people per block first: the fan-out to sections multiplies people, not log lines
    every_n = every.groupBy("block_id", "person", "action").agg(F.count(F.lit(1)).alias("n"))
    fan = slices.select("block_id", "z", F.pmod("z", F.lit(16)).alias("_s")).join(every_n.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(15)))), ["block_id", "_s"]).drop("_s")
    rows = active.select("block_id", "z", "person", F.lit("live").alias("action"), F.lit(1).cast("long").alias("n")).unionByName(
        one.unionByName(listed).withColumn("n", F.lit(1).cast("long"))).unionByName(fan.select("block_id", "z", "person", "action", "n"))
    people = rows.where("person IS NOT NULL").groupBy("block_id", "z", "person").agg(F.sum("n").alias("n"))
    nobody = rows.where("person IS NULL AND action IN ('live', 'undo')").groupBy("block_id", "z").agg(F.sum("n").alias("n_unattributed"))
    return people, nobody


def neighbour_votes(pixels: DataFrame, masks: DataFrame, radius: int = 10) -> DataFrame:
    """Which label do nearby sections carry under a mask? Rows per (query, id): nearest section, share there, sections seen, rank.

    `masks`: (query_id, z, y, x). Every mask pixel looks at its own position in the sections within `radius`: an equality join on the pixel."""
    size = masks.groupBy("query_id", "z").agg(F.count(F.lit(1)).alias("mask_px"))
    offs = F.array(*[F.lit(d) for d in range(-radius, radius + 1) if d])
    m = masks.withColumn("d", F.explode(offs)).select("query_id", F.col("z").alias("qz"), (F.col("z") + F.col("d")).alias("z"), "y", "x")
    votes = m.join(pixels.where("id <> 0"), PX).groupBy("query_id", "qz", "z", "id").agg(F.count(F.lit(1)).alias("px"))
    top = votes.groupBy("query_id", "qz", "z").agg(F.min(F.struct((-F.col("px")).alias("o"), "id")).alias("t"))
    top = top.join(size.withColumnRenamed("z", "qz"), ["query_id", "qz"]).select("query_id", "qz", "z", F.col("t.id").alias("id"), (-F.col("t.o")).alias("px"), (-F.col("t.o") / F.col("mask_px")).alias("share"))
    dist = F.abs(F.col("z") - F.col("qz"))
    c = top.groupBy("query_id", "qz", "id").agg(F.min(F.struct(dist.alias("distance"), (-F.col("share")).alias("s"), "z", "px")).alias("b"), F.count(F.lit(1)).alias("n_slices"))
    c = c.select("query_id", "qz", "id", F.col("b.distance").alias("distance"), F.col("b.z").alias("z_src"), (-F.col("b.s")).alias("share"), F.col("b.px").alias("px"), "n_slices")
    # at most 2 * radius candidates per query
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "qz").orderBy("distance", F.col("share").desc(), "id")))
