"""Labels as runs: one row (dataset, block, z, y, x0, x1, id) per stretch of equal ids in a pixel row, x1 exclusive, absent pixels background 0.

No pixel becomes a row. Layers of one volume meet row by row: the rows of a band of BAND pixel rows go to one partition, sorted, and Python
takes whole pixel rows from the sorted stream, many at a time. Their runs lie on one axis (row number times a stride plus x), so
overlaying layers, painting strokes over each other, counting masks and finding neighbours are searches in sorted arrays, no loop over
runs. Strokes are painted over each other on the map side first, so a row that was painted a million times is at most one
segment per pixel and task when it is shuffled. Keys hold dataset and block: sections of two volumes never meet."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .annotation import SOURCES, source_of
from .components import _star_rounds

PLANE = ["dataset", "block", "z"]
ROW = [*PLANE, "y"]
BAND = 64
HOT = 16  # strokes of one pixel row in a batch, beyond which they are painted before the shuffle
_ROW_SCHEMA = "dataset string, block string, z long, y long, x0 long, x1 long"


def band(y: Column | str = "y") -> Column:
    return F.floor((F.col(y) if isinstance(y, str) else y) / BAND).cast("long")


def _cut(pdf: pd.DataFrame, whole: str) -> np.ndarray:
    """Where a new row (or band) begins: True at the first run of each."""
    y = pdf["y"].to_numpy() if whole == "row" else pdf["y"].to_numpy() // BAND if whole == "band" else pdf["_band"].to_numpy()
    new = np.ones(len(pdf), bool)
    new[1:] = y[1:] != y[:-1]
    for c in [*PLANE, *pdf.columns.intersection(["_band"])]:
        v = pdf[c].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return new


def _streamed(fn: Callable[[pd.DataFrame], pd.DataFrame], whole: str):
    """`fn` over frames of whole rows (bands) of a sorted stream."""
    def run(batches):
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(rows):
                continue
            last = int(np.flatnonzero(_cut(rows, whole))[-1])
            if last:
                yield fn(rows.iloc[:last].reset_index(drop=True))
            held = rows.iloc[last:]
        if held is not None and len(held):
            yield fn(held.reset_index(drop=True))

    return run


def by_rows(runs: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, whole: str = "row") -> DataFrame:
    """One shuffle by band, then `fn` over frames that hold whole pixel rows, each sorted by x0. Rows come in the order of a hash, which is compared before their
    names; frames of bands (whole="band", or "halo": of `_band`s) come in the order of plane, y, x0."""
    at = [*PLANE, F.col("_band") if whole == "halo" else band()]
    order = [*PLANE, "_band", "y", "x0"] if whole == "halo" else [*ROW, "x0"] if whole == "band" else [_row_key(), *ROW, "x0"]
    return runs.where("x1 > x0").repartition(*at).sortWithinPartitions(*order).mapInPandas(_streamed(fn, whole), schema)


def _axis(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """First run of each row, start and end of every run on the common axis, stride."""
    new = _cut(pdf, "row")
    stride = int(pdf["x1"].max()) + 3
    base = (np.cumsum(new) - 1) * stride + 1
    return np.flatnonzero(new), base + pdf["x0"].to_numpy(), base + pdf["x1"].to_numpy(), stride


def _located(pdf: pd.DataFrame, first: np.ndarray, start: np.ndarray, end: np.ndarray, stride: int) -> dict:
    """Row columns and x0, x1 of stretches on the axis."""
    row = (start - 1) // stride
    out = {c: pdf[c].to_numpy()[first[row]] for c in ROW}
    return out | {"x0": start - 1 - row * stride, "x1": end - 1 - row * stride}


def cover(points: np.ndarray, start: np.ndarray, end: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each stretch between neighbouring points the interval of largest rank that covers it, -1 for none. Intervals begin and end at
    points. An interval is the union of two stretches of a power of two; these hand their best down, level by level."""
    order = np.argsort(rank, kind="stable")
    i, j = np.searchsorted(points, start[order]), np.searchsorted(points, end[order])
    level = np.log2(j - i).astype(np.int64)
    best = np.full(max(len(points) - 1, 0), -1, np.int64)
    for k in range(int(level.max(initial=0)), -1, -1):
        half = 1 << k
        lower = best.copy()
        lower[half:] = np.maximum(lower[half:], best[: max(len(best) - half, 0)])
        best = lower
        here = np.flatnonzero(level == k)  # rising rank: of equal places the last one written stays
        for at in (i[here], j[here] - half):
            mine = np.full(len(best), -1, np.int64)
            mine[at] = here
            best = np.maximum(best, mine)
    return np.where(best >= 0, order[np.maximum(best, 0)] if len(order) else -1, -1)


def _joined(a: np.ndarray, b: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the groups of touching stretches with equal values."""
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != b[:-1]
    for v in values:
        new[1:] |= v[1:] != v[:-1]
    lead = np.flatnonzero(new)
    return lead, np.append(lead[1:], len(a))[: len(lead)] - 1


def _painted(pdf: pd.DataFrame) -> pd.DataFrame:
    first, a, b, stride = _axis(pdf)
    points = np.unique(np.concatenate([a, b]))
    won = cover(points, a, b, pdf["n"].to_numpy())
    at = np.flatnonzero(won >= 0)
    s, e, won = points[:-1][at], points[1:][at], won[at]
    lead, last = _joined(s, e, won)
    cols = _located(pdf, first, s[lead], e[last], stride)
    return pd.DataFrame(cols | {c: pdf[c].to_numpy()[won[lead]] for c in pdf.columns if c not in cols})


def _row_key() -> Column:
    return F.xxhash64(*ROW)


def _hot_first(batches, paint: Callable[[pd.DataFrame], pd.DataFrame]):
    """Of each batch the rows that occur more than HOT times go through `paint`; the others pass as they are. Rows are told apart by `_key`."""
    for batch in batches:
        _, at, times = np.unique(batch["_key"].to_numpy(), return_inverse=True, return_counts=True)
        hot = times[at] > HOT
        batch = batch.drop(columns="_key")
        if hot.any():
            yield paint(batch[hot].sort_values([*ROW, "x0"], ignore_index=True))[list(batch.columns)]
        if not hot.all():
            yield batch[~hot]


def painted(strokes: DataFrame, combine: bool = True) -> DataFrame:
    """Strokes (row columns, n, others; n is distinct within a volume) painted over each other: the newest stroke of every pixel, as runs."""
    schema = strokes.schema.simpleString()[len("struct<") : -1]
    columns = strokes.columns
    if combine:
        strokes = strokes.where("x1 > x0").withColumn("_key", _row_key()).mapInPandas(lambda batches: _hot_first(batches, _painted), schema)
    return by_rows(strokes, lambda pdf: _painted(pdf)[columns], schema)


def merged(runs: DataFrame, *payload: str) -> DataFrame:
    """Disjoint runs with touching runs of equal payload joined."""
    names = [*ROW, "x0", "x1", *payload]

    def fn(pdf):
        first, a, b, stride = _axis(pdf)
        lead, last = _joined(a, b, *[pd.factorize(pdf[c], use_na_sentinel=True)[0] for c in payload])
        return pd.DataFrame(_located(pdf, first, a[lead], b[last], stride) | {c: pdf[c].to_numpy()[lead] for c in payload})[names]

    kinds = dict(runs.dtypes)
    return by_rows(runs.select(*names), fn, ", ".join([_ROW_SCHEMA, *[f"{c} {kinds[c]}" for c in payload]]))


def overlaid(layers: dict[str, DataFrame], payload: dict[str, dict[str, str]]) -> DataFrame:
    """Layers of disjoint runs laid over each other: row columns, x0, x1 and for each layer its payload as <layer>_<column> (null where the
    layer has no run). `payload`: layer -> column -> type. All layers meet in one shuffle; stretches that no layer covers are left out."""
    cols = {c: kind for p in payload.values() for c, kind in p.items()}
    parts = None
    for k, (name, runs) in enumerate(layers.items()):
        blank = {c: F.lit(0 if kind == "long" else None).cast(kind) for c, kind in cols.items()}  # no null among numbers: pandas would make them floats
        part = runs.select(*ROW, "x0", "x1", F.lit(k).alias("_layer"), *[(F.col(c).cast(kind) if c in payload[name] else blank[c]).alias(c) for c, kind in cols.items()])
        parts = part if parts is None else parts.unionByName(part)
    return _laid(parts, payload)


def _laid(parts: DataFrame, payload: dict[str, dict[str, str]], then: Callable[[pd.DataFrame], pd.DataFrame] | None = None, then_schema: str = "") -> DataFrame:
    """Runs numbered by `_layer` in the order of `payload`, laid over each other. `then` turns frames of whole rows, each sorted by x0, into rows of
    `then_schema` in the same pass."""
    layers = list(payload)
    out, count = [(k, name, c) for k, name in enumerate(layers) for c in payload[name]], len(layers)
    schema = ", ".join([_ROW_SCHEMA, *[f"{name}_{c} {payload[name][c]}" for _, name, c in out]])

    def fn(pdf):
        first, a, b, stride = _axis(pdf)
        points = np.unique(np.concatenate([a, b]))
        layer, found = pdf["_layer"].to_numpy(), []
        for k in range(count):
            mine = np.flatnonzero(layer == k)
            at = np.searchsorted(a[mine], points[:-1], "right") - 1
            hit = at >= 0
            hit[hit] = points[:-1][hit] < b[mine[at[hit]]]
            found.append(np.where(hit, mine[np.maximum(at, 0)] if len(mine) else -1, -1))
        some = np.flatnonzero(np.max(found, axis=0) >= 0)
        done = _located(pdf, first, points[:-1][some], points[1:][some], stride)
        for k, name, c in out:
            at = found[k][some]
            value = pdf[c].to_numpy()[np.maximum(at, 0)]
            done[f"{name}_{c}"] = pd.arrays.IntegerArray(value.astype(np.int64), at < 0) if payload[name][c] == "long" else pd.Series(value, dtype=object).where(at >= 0, None)
        return pd.DataFrame(done) if then is None else then(pd.DataFrame(done))

    return by_rows(parts, fn, then_schema if then else schema)


def _length() -> Column:
    return F.col("x1") - F.col("x0")


def provenance(before: DataFrame, after: DataFrame, edits: DataFrame) -> DataFrame:
    """Runs with before, after, source, author: the newest write counts only where its label still stands; changed pixels without one are unknown.
    `edits`: strokes (row columns, n, id, author, kind)."""
    ids = {"id": "long"}
    writes = painted(edits.select(*ROW, "x0", "x1", "n", "id", "author", "kind"))
    j = overlaid({"b": before, "a": after, "w": writes}, {"b": ids, "a": ids, "w": {"n": "long", "id": "long", "author": "string", "kind": "string"}})
    j = j.withColumn("before", F.coalesce("b_id", F.lit(0))).withColumn("after", F.coalesce("a_id", F.lit(0)))
    stands = F.col("w_n").isNotNull() & (F.col("w_id") == F.col("after"))
    source = F.when(F.col("w_n").isNull(), F.when(F.col("before") != F.col("after"), "unknown").otherwise("baseline")).when(stands, source_of(F.col("w_kind"))).otherwise("unknown")
    return j.select(*ROW, "x0", "x1", "before", "after", source.alias("source"), F.when(stands, F.col("w_author")).alias("author"))


def _layered(pdf: pd.DataFrame, layers: tuple[str, ...]) -> tuple:
    """Axis of the rows, the stretches that some layer's strokes cover, and each layer's newest stroke there (-1: none)."""
    first, a, b, stride = _axis(pdf)
    points = np.unique(np.concatenate([a, b]))
    n, won = pdf["n"].to_numpy(), []
    for c in layers:
        mine = np.flatnonzero(pdf[c].to_numpy())
        at = cover(points, a[mine], b[mine], n[mine])
        won.append(np.where(at >= 0, mine[np.maximum(at, 0)] if len(mine) else -1, -1))
    some = np.flatnonzero(np.max(won, axis=0) >= 0)
    return first, stride, points[:-1][some], points[1:][some], [w[some] for w in won]


_LAYERS = ("_before", "_after", "_edit")


def _seen(pdf: pd.DataFrame) -> pd.DataFrame:
    """The parts of strokes that stay visible in at least one layer, once for each stroke."""
    first, stride, s, e, won = _layered(pdf, _LAYERS)
    parts = []
    for k, c in enumerate(_LAYERS):
        done = [won[j] == won[k] for j in range(k)]
        at = np.flatnonzero((won[k] >= 0) & ~np.any(done, axis=0)) if done else np.flatnonzero(won[k] >= 0)
        flags = {d: won[j][at] == won[k][at] for j, d in enumerate(_LAYERS)}
        rows = _located(pdf, first, s[at], e[at], stride)
        parts.append(pd.DataFrame(rows | {d: pdf[d].to_numpy()[won[k][at]] for d in pdf.columns if d not in rows and d not in flags} | flags))
    return pd.concat(parts, ignore_index=True)


def stroke_provenance(strokes: DataFrame, before: Column, after: Column, edit: Column) -> DataFrame:
    """`provenance` of labels that are strokes themselves (row columns, n, id, author, kind; n distinct within a volume): the conditions say which strokes
    made the labels before, the labels now, and which are edits. All three are painted and laid over each other in one pass and one shuffle."""
    given = [*ROW, "x0", "x1", "n", "id", "author", "kind"]
    dealt = strokes.select(*given, *[F.coalesce(c, F.lit(False)).alias(k) for k, c in zip(_LAYERS, (before, after, edit), strict=True)]).where("x1 > x0").where(" OR ".join(_LAYERS))
    schema = dealt.schema.simpleString()[len("struct<") : -1]
    dealt = dealt.withColumn("_key", _row_key()).mapInPandas(lambda batches: _hot_first(batches, _seen), schema)

    def fn(pdf):
        first, stride, s, e, (b, a, w) = _layered(pdf, _LAYERS)
        ids = pdf["id"].to_numpy()
        was, now, wrote = (np.where(k >= 0, ids[np.maximum(k, 0)], 0) for k in (b, a, w))
        author, kind = (pdf[c].to_numpy()[np.maximum(w, 0)] for c in ("author", "kind"))
        out = pd.DataFrame(_located(pdf, first, s, e, stride) | {"before": was, "after": now, "written": w >= 0, "stands": (w >= 0) & (wrote == now)})
        return out.assign(author=pd.Series(author, dtype=object).where(out["stands"], None), kind=pd.Series(kind, dtype=object).where(out["stands"], None))

    j = by_rows(dealt, fn, f"{_ROW_SCHEMA}, before long, after long, written boolean, stands boolean, author string, kind string")
    source = F.when(~F.col("written"), F.when(F.col("before") != F.col("after"), "unknown").otherwise("baseline")).when(F.col("stands"), source_of(F.col("kind"))).otherwise("unknown")
    return j.select(*ROW, "x0", "x1", "before", "after", source.alias("source"), "author")


def _px(condition: Column | None = None) -> Column:
    return F.coalesce(F.sum(_length() if condition is None else F.when(condition, _length())), F.lit(0)).cast("long")


def provenance_totals(prov: DataFrame) -> DataFrame:
    """Pixels, changed, added, removed, relabelled and per source: by section, by block (z NULL), by dataset, over all."""
    b, a = F.col("before"), F.col("after")
    aggs = [_px().alias("px"), _px(b != a).alias("changed_px"), _px((b == 0) & (a != 0)).alias("added_px"), _px((b != 0) & (a == 0)).alias("removed_px"),
            _px((b != 0) & (a != 0) & (a != b)).alias("relabeled_px"), *[_px(F.col("source") == s).alias(f"{s}_px") for s in SOURCES]]
    return prov.rollup(*PLANE).agg(*aggs)


def provenance_labels(prov: DataFrame) -> DataFrame:
    """Per section and label: pixels before and now, changed pixels, pixels per source, mixed flag."""
    before = prov.groupBy(*PLANE, F.col("before").alias("label")).agg(_px().alias("before_px"))
    now = prov.groupBy(*PLANE, F.col("after").alias("label")).agg(_px().alias("current_px"), _px(F.col("before") != F.col("after")).alias("changed_px"), *[_px(F.col("source") == s).alias(s) for s in SOURCES])
    j = before.join(now, [*PLANE, "label"], "full_outer").fillna(0)
    return j.withColumn("mixed", sum((F.col(s) > 0).cast("int") for s in SOURCES) > 1)


# ----------------------------------------------------------------------------- components


def _least_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that can be reached over the links (a, b)."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(root, np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_])
        while (root[root] != root).any():
            root = root[root]
    return root


def _links(pdf: pd.DataFrame, reach: int, by_value: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs that touch: side by side in a row, or in neighbouring rows (reach 1: over corners as well)."""
    first, a, b, stride = _axis(pdf)
    y = pdf["y"].to_numpy()[first]
    plane = _cut(pdf, "row")
    same = np.zeros(len(first), bool)  # the next row is the next pixel row of the same plane
    same[:-1] = y[1:] == y[:-1] + 1
    for c in [*PLANE, *pdf.columns.intersection(["_band"])]:
        v = pdf[c].to_numpy()[first]
        same[:-1] &= v[1:] == v[:-1]
    row = np.cumsum(plane) - 1
    side = np.flatnonzero((a[1:] == b[:-1]) & (row[1:] == row[:-1]))
    ask = np.flatnonzero(same[row])
    lo = np.searchsorted(b, a[ask] + stride - reach, "right")
    hi = np.searchsorted(a, b[ask] + stride + reach, "left")
    count = np.maximum(hi - lo, 0)
    up = np.repeat(ask, count)
    down = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    p, q = np.concatenate([side, up]), np.concatenate([side + 1, down])
    if by_value:
        v = pdf["id"].to_numpy()
        equal = v[p] == v[q]
        p, q = p[equal], q[equal]
    return p, q


def components(runs: DataFrame, connectivity: int = 4, by_value: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """`runs` (disjoint; id; the columns `keep`) with cy, cx: the first pixel, in raster order, of the component that a run belongs to. Runs of a band are
    joined in one task; a band's first rows also see the last row of the band above, and only these border links become edges."""
    if not by_value:
        runs = runs.withColumn("id", F.lit(1).cast("long"))
    last = F.col("y") % BAND == BAND - 1
    cols, kinds = [*ROW, "x0", "x1", "id", *keep], dict(runs.dtypes)
    dealt = runs.select(*cols, F.explode(F.when(last, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_h"))
    dealt = dealt.withColumn("_band", band() + F.col("_h"))
    reach = 1 if connectivity == 8 else 0

    def fn(pdf):
        p, q = _links(pdf, reach, by_value)
        halo = pdf["_h"].to_numpy() == 1
        inside = ~halo[p] & ~halo[q]
        root = _least_roots(len(pdf), p[inside], q[inside])
        y, x = pdf["y"].to_numpy(), pdf["x0"].to_numpy()
        out = pdf[cols].assign(ry=y[root], rx=x[root], edge=False)[~halo]
        over = halo[p] & ~halo[q]  # a border run of the band above and a component of this one
        e = pdf[cols].iloc[p[over]].assign(ry=y[root[q[over]]], rx=x[root[q[over]]], edge=True)
        return pd.concat([out, e], ignore_index=True)

    local = cut_lineage(by_rows(dealt, fn, ", ".join([_ROW_SCHEMA, "id long", *[f"{c} {kinds[c]}" for c in keep], "ry long, rx long, edge boolean"]), "halo"))
    node = lambda y, x: F.struct(*PLANE, F.col(y).alias("y"), F.col(x).alias("x"))
    crossing = local.where("edge").select(node("y", "x0").alias("a"), node("ry", "rx").alias("b"))
    border = local.where(f"NOT edge AND y % {BAND} = {BAND - 1}").select(node("y", "x0").alias("a"), node("ry", "rx").alias("b"))
    runs_ = local.where("NOT edge").drop("edge")
    if crossing.isEmpty():
        return runs_.withColumnsRenamed({"ry": "cy", "rx": "cx"})
    roots = _star_rounds(crossing.unionByName(border))
    roots = roots.select(*[F.col(f"node.{c}").alias(c) for c in PLANE], F.col("node.y").alias("ry"), F.col("node.x").alias("rx"), F.col("root.y").alias("_y"), F.col("root.x").alias("_x"))
    j = runs_.join(roots, [*PLANE, "ry", "rx"], "left")
    return j.select(*cols, F.coalesce("_y", "ry").alias("cy"), F.coalesce("_x", "rx").alias("cx"))


COMPONENT = [*PLANE, "cy", "cx"]


def component_table(labelled: DataFrame) -> DataFrame:
    """Per component: id, pixels, box."""
    return labelled.groupBy(*COMPONENT).agg(F.min("id").alias("id"), _px().alias("px"), F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), (F.max("y") + 1).alias("y1"))


def changed_regions(prov: DataFrame) -> DataFrame:
    """All regions of changed pixels, 8-connected: pixels, box, centre, commonest ids before and after, commonest author, rank by size in the section."""
    changed = prov.where("before <> after").select(*ROW, "x0", "x1", F.lit(1).cast("long").alias("id"), "before", "after", "author")
    lab = components(changed, 8, by_value=False, keep=("before", "after", "author"))
    # a run votes three times: counted per value first, so a region with many runs is few rows when its votes meet
    no_id, no_name, n = F.lit(None).cast("long"), F.lit(None).cast("string"), _length()
    votes = [F.struct(F.lit(k).alias("k"), i.alias("i"), s.alias("s")) for k, (i, s) in enumerate(((F.col("before"), no_name), (F.col("after"), no_name), (no_id, F.col("author"))))]
    per = lab.select(*COMPONENT, "y", "x0", "x1", F.explode(F.array(*votes)).alias("_v")).groupBy(*COMPONENT, "_v").agg(
        F.sum(n).alias("n"), F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), (F.max("y") + 1).alias("y1"),
        F.sum((F.col("x0") + F.col("x1") - 1) * n).alias("xs"), F.sum(F.col("y") * n).alias("ys"))
    first = F.col("_v.k") == 0  # every run once
    px = F.sum(F.when(first, F.col("n")))

    def majority(k: int, value: str):
        return F.min(F.when((F.col("_v.k") == k) & F.col(f"_v.{value}").isNotNull(), F.struct((-F.col("n")).alias("o"), F.col(f"_v.{value}").alias("v"))))["v"]

    base = per.groupBy(*COMPONENT).agg(
        px.cast("long").alias("px"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.floor(F.sum(F.when(first, F.col("xs"))) / 2 / px).alias("mx"), F.floor(F.sum(F.when(first, F.col("ys"))) / px).alias("my"),
        majority(0, "i").alias("from_id"), majority(1, "i").alias("to_id"), majority(2, "s").alias("by"))
    return base.withColumn("rank", F.row_number().over(Window.partitionBy(*PLANE).orderBy(F.col("px").desc(), "cy", "cx")))


# ----------------------------------------------------------------------------- neighbours and masks


def edges(runs: DataFrame, height: int, width: int) -> DataFrame:
    """Runs of pixels whose label differs from the right (rdiff) or the lower (ddiff) neighbour. A run goes out twice: as its own row and as the
    row below the one above it."""
    own = runs.where("id <> 0").select(*ROW, "x0", "x1", "id")
    places = F.array(F.struct("y", F.lit(0).alias("_layer")), F.struct((F.col("y") - 1).alias("y"), F.lit(1).alias("_layer")))
    both = own.withColumn("_p", F.explode(places)).select(*PLANE, "_p.y", "x0", "x1", "_p._layer", "id").where("_layer = 0 OR y >= 0")

    def fn(pdf):
        first, a, b, stride = _axis(pdf)
        row = (a - 1) // stride
        o, u = (pdf[c].to_numpy(np.int64, na_value=0) for c in ("o_id", "u_id"))
        x0, x1 = pdf["x0"].to_numpy(), pdf["x1"].to_numpy()
        under = pdf["y"].to_numpy() < height - 1
        down = (o != u) & under
        # pixels before a change of the own label: at the end of a stretch, and left of a stretch that nothing precedes
        follows = np.zeros(len(a), bool)
        follows[:-1] = (a[1:] == b[:-1]) & (row[1:] == row[:-1])
        nexts = np.where(follows, np.append(o[1:], 0), 0)
        end = (o != nexts) & (x1 < width)
        led = np.zeros(len(a), bool)
        led[1:] = follows[:-1]
        front = ~led & (o != 0) & (x0 > 0)
        pieces = [(b[end] - 1, b[end], True, down[end]), (a[front] - 1, a[front], True, np.zeros(front.sum(), bool))]
        body = np.where(end, b - 1, b)
        keep = down & (body > a)
        pieces.append((a[keep], body[keep], False, np.ones(keep.sum(), bool)))
        s, e = np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces])
        r = np.concatenate([np.full(len(p[0]), p[2]) for p in pieces])
        d = np.concatenate([p[3] for p in pieces])
        order = np.argsort(s, kind="stable")
        return pd.DataFrame(_located(pdf, first, s[order], e[order], stride) | {"rdiff": r[order], "ddiff": d[order]})

    return _laid(both, {"o": {"id": "long"}, "u": {"id": "long"}}, fn, f"{_ROW_SCHEMA}, rdiff boolean, ddiff boolean")


def mask_overlap(masks: DataFrame) -> DataFrame:
    """Runs (row columns, mask; runs of one mask may overlap) -> row columns, x0, x1, n: by how many masks a stretch is claimed."""
    def fn(pdf):
        first, a, b, stride = _axis(pdf)
        mask = pd.factorize(pdf["mask"])[0]
        row = (a - 1) // stride
        order = np.lexsort((a, mask, row))
        s, e, group = a[order], b[order], row[order] * (mask.max() + 1) + mask[order]
        # ends so far within a group: groups are lifted over each other, so one running maximum serves all
        step = int(b.max()) + 1
        rank = np.cumsum(np.append(True, group[1:] != group[:-1])) - 1
        reach = np.maximum.accumulate(e + rank * step)
        new = np.append(True, (s + rank * step)[1:] > reach[:-1])
        lead = np.flatnonzero(new)
        last = np.append(lead[1:], len(s)) - 1
        s, e = s[lead], (reach - rank * step)[last]
        points = np.unique(np.concatenate([s, e]))
        change = np.bincount(np.searchsorted(points, s), minlength=len(points)) - np.bincount(np.searchsorted(points, e), minlength=len(points))
        n = np.cumsum(change)[:-1]
        some = np.flatnonzero(n > 0)
        lead, last = _joined(points[:-1][some], points[1:][some], n[some])
        return pd.DataFrame(_located(pdf, first, points[:-1][some][lead], points[1:][some][last], stride) | {"n": n[some][lead]})

    return by_rows(masks.select(*ROW, "x0", "x1", "mask"), fn, f"{_ROW_SCHEMA}, n long")


def mask_conflicts(masks: DataFrame, plane_px: int, most: float = 0.001) -> DataFrame:
    """Per section: fraction of the plane that more than one exclusive mask claims; per block (z NULL) the largest and mean of them, and ok or warn."""
    per = mask_overlap(masks).groupBy(*PLANE).agg((_px(F.col("n") > 1) / plane_px).alias("conflict_frac"))
    whole = per.groupBy("dataset", "block").agg(F.max("conflict_frac").alias("conflict_frac"), F.avg("conflict_frac").alias("mean_frac"))
    whole = whole.select("dataset", "block", F.lit(None).cast("long").alias("z"), "conflict_frac", "mean_frac", F.when(F.col("conflict_frac") < most, "ok").otherwise("warn").alias("status"))
    return per.select(*PLANE, "conflict_frac", F.lit(None).cast("double").alias("mean_frac"), F.lit(None).cast("string").alias("status")).unionByName(whole)


def clipped(runs: DataFrame, windows: DataFrame, cell: int = 512) -> DataFrame:
    """Runs cut to the windows (dataset, block, z, window_id, wy0, wy1, wx0, wx1) that they lie in: an equality join on band and cell. Runs are cut at
    cell borders first, so a piece meets a window once."""
    pieces = runs.withColumn("_c", F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor((F.col("x1") - 1) / cell))))
    pieces = pieces.withColumn("x0", F.greatest("x0", F.col("_c") * cell)).withColumn("x1", F.least("x1", (F.col("_c") + 1) * cell)).withColumn("_b", band())
    w = windows.withColumn("_c", F.explode(F.sequence(F.floor(F.col("wx0") / cell), F.floor((F.col("wx1") - 1) / cell))))
    w = w.withColumn("_b", F.explode(F.sequence(F.floor(F.col("wy0") / BAND), F.floor((F.col("wy1") - 1) / BAND))))
    j = pieces.join(w, [*PLANE, "_b", "_c"]).where("y >= wy0 AND y < wy1 AND x0 < wx1 AND x1 > wx0")
    return j.withColumn("x0", F.greatest("x0", "wx0")).withColumn("x1", F.least("x1", "wx1")).drop("_b", "_c")


def window_evidence(runs: DataFrame, windows: DataFrame, height: int, width: int) -> DataFrame:
    """Per window: fraction of foreground, distinct ids, fraction of boundary pixels (differences between pixels of the window only)."""
    area = (F.col("wy1") - F.col("wy0")) * (F.col("wx1") - F.col("wx0"))
    ids = clipped(runs.where("id <> 0"), windows).groupBy("window_id", "id").agg(_px().alias("n"))
    ids = ids.groupBy("window_id").agg(F.sum("n").alias("n_fg"), F.count(F.lit(1)).alias("n_ids"))
    e = clipped(edges(runs, height, width), windows)
    inner = F.when(F.col("ddiff") & (F.col("y") + 1 < F.col("wy1")), _length()).when(F.col("rdiff"), F.greatest(F.least("x1", F.col("wx1") - 1) - F.col("x0"), F.lit(0))).otherwise(0)
    bd = e.groupBy("window_id").agg(F.sum(inner).alias("n_bd"))
    j = windows.join(ids, "window_id", "left").join(bd, "window_id", "left")
    return j.select(*windows.columns, (F.coalesce("n_fg", F.lit(0)) / area).alias("fg_frac"), F.coalesce("n_ids", F.lit(0)).alias("n_ids"), (F.coalesce("n_bd", F.lit(0)) / area).alias("boundary_frac"))


def neighbour_votes(runs: DataFrame, masks: DataFrame, radius: int = 10) -> DataFrame:
    """Which labels do the sections within `radius` carry under a mask (runs with query_id)? A mask's run, not its pixels, goes to each of these
    sections; it meets the runs of its pixel row. Per query and id: nearest section, share there, sections in which the id leads, rank."""
    size = masks.groupBy("query_id", "dataset", "block", F.col("z").alias("qz")).agg(_px().alias("mask_px"))
    away = F.explode(F.array(*[F.lit(d) for d in range(-radius, radius + 1) if d]))
    m = masks.withColumn("_d", away).select("query_id", "dataset", "block", F.col("z").alias("qz"), (F.col("z") + F.col("_d")).alias("z"), "y", F.col("x0").alias("m0"), F.col("x1").alias("m1"))
    met = m.join(runs.where("id <> 0").select(*ROW, "x0", "x1", "id"), ROW).where("x0 < m1 AND x1 > m0")
    key = ["query_id", "dataset", "block", "qz"]
    votes = met.groupBy(*key, "z", "id").agg(F.sum(F.least("x1", "m1") - F.greatest("x0", "m0")).alias("px"))
    top = votes.groupBy(*key, "z").agg(F.min(F.struct((-F.col("px")).alias("o"), "id")).alias("t")).join(size, key)
    top = top.select(*key, "z", F.col("t.id").alias("id"), (-F.col("t.o") / F.col("mask_px")).alias("share"))
    best = F.min(F.struct(F.abs(F.col("z") - F.col("qz")).alias("distance"), (-F.col("share")).alias("s"), "z"))
    c = top.groupBy(*key, "id").agg(best.alias("b"), F.count(F.lit(1)).alias("n_slices"))
    c = c.select(*key, "id", F.col("b.distance").alias("distance"), F.col("b.z").alias("z_src"), (-F.col("b.s")).alias("share"), "n_slices")
    return c.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("distance", F.col("share").desc(), "id")))


# ----------------------------------------------------------------------------- replay


def _live(log: DataFrame, undone: DataFrame) -> DataFrame:
    """Log rows that no undo took back. `undone`: dataset, block, n, z; z NULL takes the edit back on all sections, else on one."""
    whole = undone.where("z IS NULL").select("dataset", "block", "n").distinct()
    one = undone.where("z IS NOT NULL").select("dataset", "block", "n", "z").distinct()
    return log.join(whole, ["dataset", "block", "n"], "left_anti").join(one, ["dataset", "block", "n", "z"], "left_anti")


def replay(base: DataFrame, strokes: DataFrame, merges: DataFrame, undone: DataFrame) -> DataFrame:
    """Labels after an edit log, in the order of the log: a stroke writes its id, a merge (dataset, block, n, z or NULL, from_id, to_id) renames what
    carries from_id at that time, so what is painted later keeps its id. Undone strokes and merges never happened.

    Every merge is an event of its section; the event that its result meets next is found by one sorted pass, and chains of
    events are shortened by pointer jumping. A pixel asks only for the first event behind its own write."""
    strokes = _live(strokes, undone)
    first = base.select(*ROW, "x0", "x1", F.lit(0).cast("long").alias("n"), "id")
    written = cut_lineage(painted(first.unionByName(strokes.select(*ROW, "x0", "x1", "n", "id"))))
    states = written.select(*PLANE, "n", "id").distinct()
    sections = states.select(*PLANE).distinct()
    wide = merges.where("z IS NULL").drop("z").join(sections, ["dataset", "block"])
    events = wide.select(*PLANE, "n", "from_id", "to_id").unionByName(merges.where("z IS NOT NULL").join(sections, PLANE, "left_semi").select(*PLANE, "n", "from_id", "to_id"))
    events = cut_lineage(_live(events, undone).where("from_id <> to_id"))

    def next_event(asks: DataFrame) -> DataFrame:
        """`asks` (plane, id, n) with `next`: number of the first later event that renames the id."""
        both = asks.select(*PLANE, "id", "n", F.lit(None).cast("long").alias("event")).unionByName(events.select(*PLANE, F.col("from_id").alias("id"), "n", F.col("n").alias("event")))
        later = Window.partitionBy(*PLANE, "id").orderBy(F.col("n").desc()).rangeBetween(Window.unboundedPreceding, -1)
        return both.withColumn("next", F.min("event").over(later)).where("event IS NULL").drop("event")

    chain = next_event(events.select(*PLANE, F.col("to_id").alias("id"), "n")).select(*PLANE, "n", F.col("id").alias("final"), F.col("next")).distinct()
    while True:
        chain = cut_lineage(chain)
        if chain.where("next IS NOT NULL").isEmpty():
            break
        ahead = chain.select(*PLANE, F.col("n").alias("next"), F.col("final").alias("_f"), F.col("next").alias("_n"))
        chain = chain.join(ahead, [*PLANE, "next"], "left").select(*PLANE, "n", F.coalesce("_f", "final").alias("final"), F.col("_n").alias("next"))
    named = next_event(states).join(chain.select(*PLANE, F.col("n").alias("next"), "final"), [*PLANE, "next"], "left")
    named = named.select(*PLANE, "n", "id", F.coalesce("final", "id").alias("now"))
    out = written.join(named, [*PLANE, "n", "id"]).select(*ROW, "x0", "x1", F.col("now").alias("id"))
    return merged(out.where("id <> 0"), "id")
