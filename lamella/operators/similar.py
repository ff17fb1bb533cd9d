"""Similar sections: robust feature space, exact nearest neighbours, precision at k, 2-D map."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import exact_percentiles, spread_join

# fixed values: statistic features and how each is transformed; the last group counts as 0 where absent
LINEAR = ("mean", "std", "p1", "p50", "p99", "frac_low_sat", "frac_high_sat", "frac_mode", "entropy_bits", "frac_fill", "n_fill_components", "fill_largest_frac", "fill_span")
LOGARITHMIC = ("lapvar", "sharpness", "fill_elongation")
ABSENT_IS_ZERO = ("frac_fill", "n_fill_components", "fill_largest_frac", "fill_elongation", "fill_span")


def stat_feature(name: str) -> Column:
    v = F.col(name).cast("double")
    t = F.when(v.isNotNull(), F.log10(F.greatest(v, F.lit(0.0)) + 1e-6)) if name in LOGARITHMIC else v
    return F.coalesce(t, F.lit(0.0)) if name in ABSENT_IS_ZERO else t


def robust_space(sections: DataFrame, stats: list[str], scores: list[str]) -> tuple[DataFrame, list[str]]:
    """Adds `fv`: statistics imputed with the median, divided by the IQR, clipped to +-6; scores with NULL = 1. Each half is
    weighted by its number of non-constant columns.

    All features are one long (feature, value) table, so every percentile comes out of the same bucketed pass; only two
    rows of parameters per feature reach the driver."""
    wide = sections.withColumns({f"_f_{s}": stat_feature(s) for s in stats})
    for s in scores:
        wide = wide.withColumn(f"_c_{s}", F.coalesce(F.col(s).cast("double"), F.lit(1.0)))

    def long(exprs):
        return wide.select(F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), e.alias("v")) for k, e in exprs.items()])).alias("e")).select("e.*")

    med = {r["feature"]: r["m"] for r in exact_percentiles(long({s: F.col(f"_f_{s}") for s in stats}), ["feature"], "v", {"m": 0.5}).collect()} if stats else {}
    filled = {s: F.coalesce(F.col(f"_f_{s}"), F.lit(med.get(s, 0.0))) for s in stats}
    quart = {r["feature"]: r for r in exact_percentiles(long(filled), ["feature"], "v", {"q1": 0.25, "q3": 0.75}).collect()} if stats else {}
    spread = wide.agg(*[F.stddev_pop(filled[s]).alias(f"_f_{s}") for s in stats], *[F.stddev_pop(f"_c_{s}").alias(f"_c_{s}") for s in scores]).first().asDict()
    scaled = {}
    for s in stats:
        scale = (quart[s]["q3"] - quart[s]["q1"]) or spread[f"_f_{s}"] or 1.0
        scaled[s] = F.greatest(F.lit(-6.0), F.least(F.lit(6.0), (filled[s] - F.lit(med.get(s, 0.0))) / F.lit(float(scale))))
    after = wide.agg(*[F.stddev_pop(scaled[s]).alias(s) for s in stats]).first().asDict() if stats else {}
    keep_s = [s for s in stats if (after[s] or 0.0) > 1e-9]
    keep_c = [s for s in scores if (spread[f"_c_{s}"] or 0.0) > 1e-9]
    parts = [scaled[s] / F.lit(math.sqrt(len(keep_s))) for s in keep_s] + [F.col(f"_c_{s}") * F.lit(3.0) / F.lit(math.sqrt(len(keep_c))) for s in keep_c]
    out = wide.withColumn("fv", F.array(*parts) if parts else F.array(F.lit(0.0)))
    return out.drop(*[f"_f_{s}" for s in stats], *[f"_c_{s}" for s in scores]), keep_s + keep_c


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def find_similar(space: DataFrame, target: DataFrame, k: int, order: list[str], exclude: Column | None = None) -> DataFrame:
    """The `k` rows nearest to one target row (a single row: `fv` plus the columns `exclude` needs, prefixed q_)."""
    t = target.limit(1).select(F.col("fv").alias("q_fv"), *[F.col(c).alias(f"q_{c}") for c in target.columns if c != "fv"])
    d = space.join(F.broadcast(t), F.lit(True))  # one row: a scan with a constant
    d = d.withColumn("distance", distance(F.col("fv"), F.col("q_fv")))
    if exclude is not None:
        d = d.where(~exclude)
    return d.orderBy("distance", *order).limit(k)


# ----------------------------------------------------------------------------- exact nearest-neighbour join


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b by one matrix product; off by rounding only."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2.0 * (a @ b.T), 0.0)


def _rows(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, width))


def _slices(pdf: pd.DataFrame, rows: int = 1024):
    return (pdf.iloc[at : at + rows] for at in range(0, max(len(pdf), 1), rows))


def _assign(pivots: np.ndarray):
    def run(batches):
        for batch in batches:
            for pdf in _slices(batch):
                m = _rows(pdf["fv"], pivots.shape[1])
                cell = _squared(m, pivots).argmin(axis=1) if len(m) else np.zeros(0, dtype=int)
                yield pdf.assign(cell=cell.astype("int32"), d_pivot=np.sqrt(((m - pivots[cell]) ** 2).sum(axis=1)))

    return run


def _nearest(p: np.ndarray, pid: np.ndarray, pg: np.ndarray, q: np.ndarray, qid: np.ndarray, qg: np.ndarray, theta: np.ndarray, k: int):
    """(query, point, distance) of the k nearest points of every query that are not beyond its `theta`; ties by point id.

    A matrix product with slack for its rounding rules points out; distances are then taken from the differences, at most 65,536 pairs at a time."""
    pp, qq = (p * p).sum(1), (q * q).sum(1)
    slack = 8 * (p.shape[1] + 4) * np.finfo(float).eps * (qq + pp.max())
    d2 = np.maximum(qq[:, None] + pp[None] - 2.0 * (q @ p.T), 0.0)
    d2[(pid[None] == qid[:, None]) | (pg[None] == qg[:, None])] = np.inf
    limit = theta * theta * (1 + 1e-9) + slack
    many = np.flatnonzero((d2 <= limit[:, None]).sum(1) > k)
    if len(many):
        limit[many] = np.minimum(limit[many], np.partition(d2[many], k - 1, axis=1)[:, k - 1] * (1 + 1e-9) + 2 * slack[many])
    i, j = np.nonzero((d2 <= limit[:, None]) & np.isfinite(d2))
    d = np.concatenate([np.sqrt(((p[j[at : at + 65536]] - q[i[at : at + 65536]]) ** 2).sum(axis=1)) for at in range(0, max(len(i), 1), 65536)])
    order = np.lexsort((pid[j], d, i))
    i, j, d = i[order], j[order], d[order]
    first = np.searchsorted(i, i)  # where the rows of the same query begin
    best = np.arange(len(i)) - first < k
    return i[best], j[best], d[best]


def _top(k: int):
    def run(key, points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"qid": [], "pid": [], "distance": []}).astype({"qid": "int64", "pid": "int64", "distance": "float64"})]
        if len(points) and len(queries):
            p, pid = _rows(points["fv"], 0), points["pid"].to_numpy()
            codes, _ = pd.factorize(pd.concat([points["grp"], queries["grp"]]))
            pg, qg = codes[: len(p)], codes[len(p) :]
            for at in range(0, len(queries), 128):  # a block of queries against the whole part
                part = queries.iloc[at : at + 128]
                qid = part["qid"].to_numpy()
                i, j, d = _nearest(p, pid, pg, _rows(part["fv"], 0), qid, qg[at : at + 128], part["theta"].to_numpy(), k)
                found.append(pd.DataFrame({"qid": qid[i], "pid": pid[j], "distance": d}))
        return pd.concat(found)

    return run


def _packed(sizes: dict[int, int], n_cells: int, chunk: int) -> tuple[list[int], list[int], int]:
    """(first part of each cell, parts of each cell, number of parts): neighbouring cells share a part of about `chunk` rows, a larger cell has several."""
    first, split, at, room = [0] * n_cells, [1] * n_cells, 0, chunk
    for c in range(n_cells):
        n = sizes.get(c, 0)
        if n > room and room < chunk:
            at, room = at + 1, chunk
        first[c], split[c] = at, max(1, -(-n // chunk))
        if split[c] > 1:
            at, room = at + split[c], chunk
        else:
            room -= n
    return first, split, at + 1


def knn_join(points: DataFrame, queries: DataFrame, k: int, n_pivots: int | None = None, chunk: int | None = None) -> DataFrame:
    """Exact k nearest points of every query: (qid, pid, distance, rank). `points`: pid, grp, fv; `queries`: qid, grp, fv;
    points of the query's own `grp` do not count.

    Points and queries are cut into cells around pivots, and neighbouring cells go into parts of about `chunk` rows. A query first visits one
    part of its own cell; its k-th distance then rules out every cell whose ball is farther away (triangle inequality). A task sees one
    part of points and one of queries and returns k rows per query, so no pair list ever exists; a query carries the numbers of the parts it
    still has to visit, never a copy per cell. The pivots grow with the square root of the points, up to 1024 (they are known to every task).
    `chunk` grows with the points, from 2048 to 8192. Where no ball can be ruled out, as among many-dimensional vectors without structure, all
    pairs of parts are visited: time and shuffle grow with the square of the points, memory does not."""
    total = points.count() if n_pivots is None or chunk is None else 0
    if n_pivots is None:
        n_pivots = min(1024, max(32, math.isqrt(total)))
    if chunk is None:
        chunk = min(8192, max(2048, total // 16))
    pv = np.array([r[0] for r in points.orderBy(F.xxhash64("pid"), "pid").limit(n_pivots).select("fv").collect()], dtype=np.float64)
    if not len(pv):
        return queries.select("qid", F.lit(None).cast("long").alias("pid"), F.lit(None).cast("double").alias("distance"), F.lit(None).cast("int").alias("rank")).limit(0)
    pc = points.select("pid", "grp", "fv").mapInPandas(_assign(pv), "pid long, grp string, fv array<double>, cell int, d_pivot double")
    qc = queries.select("qid", "grp", "fv").mapInPandas(_assign(pv), "qid long, grp string, fv array<double>, cell int, d_pivot double")
    cells = {r["cell"]: (r["n"], r["r"]) for r in pc.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d_pivot").alias("r")).collect()}  # one row per pivot
    q_cells = {r["cell"]: r["count"] for r in qc.groupBy("cell").count().collect()}  # one row per pivot

    def dealt(df, sizes, key, name):
        first, split, n = _packed(sizes, len(pv), chunk)
        base, width = (F.array(*[F.lit(v) for v in x]) for x in (first, split))
        return df.withColumn(name, (F.get(base, F.col("cell")) + F.pmod(F.xxhash64(key), F.get(width, F.col("cell")))).cast("int")), first, split, n

    pc, first, split, n_parts = dealt(pc, {c: n for c, (n, _) in cells.items()}, "pid", "part")
    qc = dealt(qc, q_cells, "qid", "qpart")[0]
    own_part = F.get(F.array(*[F.lit(v) for v in first]), F.col("cell")) + F.pmod(F.xxhash64("qid"), F.get(F.array(*[F.lit(v) for v in split]), F.col("cell")))
    qc = qc.withColumn("own_part", own_part.cast("int"))

    def visit(q):  # q has a `part` to visit and no interest in what lies beyond its `theta`
        q = q.select("qid", "grp", "fv", "theta", F.col("part").alias("w_part"), F.col("qpart").alias("w_qpart"))
        visits = q.select(F.col("w_part").alias("part"), F.col("w_qpart").alias("qpart")).distinct()
        p = pc.join(visits, "part").select("pid", "grp", "fv", "part", "qpart")  # points go only where some query of the part wants them
        return p.groupBy("part", "qpart").cogroup(q.groupBy("w_part", "w_qpart")).applyInPandas(_top(k), "qid long, pid long, distance double")

    def best(df):  # k smallest per query, never more than k per part enter
        return df.groupBy("qid").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "pid"))), 1, k).alias("b"))

    own = cut_lineage(best(visit(qc.withColumn("part", F.col("own_part")).withColumn("theta", F.lit(float("inf"))))))  # at most k rows per query, read twice
    bound = qc.join(own, "qid", "left").withColumn("theta", F.when(F.size("b") >= k, F.element_at("b", k)["distance"]).otherwise(F.lit(float("inf"))))
    ids = sorted(cells)
    begin = np.array([first[c] for c in ids])
    end = begin + np.array([split[c] for c in ids])

    def others(batches):
        radius = np.array([cells[c][1] for c in ids])
        centre = pv[ids]
        for batch in batches:
            for pdf in _slices(batch):
                if not len(pdf):
                    continue
                d = np.sqrt(_squared(_rows(pdf["fv"], centre.shape[1]), centre))
                reach = pdf["theta"].to_numpy()[:, None] * (1 + 1e-9) + 1e-6 * (1 + d)  # the slack covers the rounding of the distances
                i, c = np.nonzero(~(d - radius[None] > reach))
                wanted = np.zeros((len(pdf), n_parts + 1), dtype=np.int32)  # +1 where a cell's parts begin, -1 behind them
                np.add.at(wanted, (i, begin[c]), 1)
                np.add.at(wanted, (i, end[c]), -1)
                wanted = np.cumsum(wanted, axis=1)[:, :n_parts] > 0
                wanted[np.arange(len(pdf)), pdf["own_part"].to_numpy()] = False
                yield pdf[["qid", "grp", "fv", "qpart", "theta"]].assign(parts=[np.flatnonzero(w).astype("int32") for w in wanted])

    far = bound.select("qid", "grp", "fv", "qpart", "own_part", "theta").mapInPandas(others, "qid long, grp string, fv array<double>, qpart int, theta double, parts array<int>")
    far = far.withColumn("part", F.explode("parts")).drop("parts")
    near = own.select("qid", F.explode("b").alias("e")).select("qid", F.col("e.pid").alias("pid"), F.col("e.distance").alias("distance"))
    top = best(near.unionByName(visit(far)))
    return top.select("qid", F.posexplode("b").alias("rank", "e")).select("qid", F.col("e.pid").alias("pid"), F.col("e.distance").alias("distance"), (F.col("rank") + 1).alias("rank"))


def precision_at_k(neighbours: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """Per class: mean hit rate of the k nearest (fewer when the class is small), the random rate and the lift.

    `neighbours`: qid, pid, rank; `labels`: id, class, grp. Classes are few, so their counts are a broadcast table."""
    total = labels.count()
    per = labels.groupBy("class").agg(F.count(F.lit(1)).alias("_n"))
    own = labels.groupBy("class", "grp").agg(F.count(F.lit(1)).alias("_own"))
    q = labels.join(F.broadcast(per), "class").join(own, ["class", "grp"]).select(
        F.col("id").alias("qid"), F.col("class").alias("qclass"), F.least(F.lit(k), F.col("_n") - F.col("_own")).alias("k_eff"), "_n")
    mine = neighbours.join(q, "qid").where(F.col("rank") <= F.col("k_eff"))
    # some points are neighbours of very many queries
    hits = spread_join(mine, labels.select(F.col("id").alias("pid"), "class"), ["pid"], F.pmod(F.xxhash64("qid"), F.lit(64)))
    rate = hits.groupBy("qid", "qclass", "_n").agg((F.count_if(F.col("class") == F.col("qclass")) / F.count(F.lit(1))).alias("rate"))
    out = rate.groupBy(F.col("qclass").alias("class")).agg(F.count(F.lit(1)).alias("n_queries"), F.avg("rate").alias("precision"), F.max("_n").alias("_n"))
    base = F.col("_n") / float(max(total - 1, 1))
    return out.select("class", "n_queries", "precision", base.alias("random"), (F.col("precision") / base).alias("lift"))


def slice_map(space: DataFrame, names: list[str], keep: list[str]) -> tuple[DataFrame, list[dict]]:
    """2-D map: principal axes from one pass of covariances (d x d numbers reach the driver), then a projection.

    Signs are fixed so that the largest loading of each axis is positive."""
    d = len(names)
    x = [F.col("fv")[i] for i in range(d)]
    aggs = [F.avg(x[i]).alias(f"m{i}") for i in range(d)] + [F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]
    r = space.agg(*aggs).first().asDict()
    cov = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(d)] for i in range(d)])
    val, vec = np.linalg.eigh(cov)
    order = np.argsort(-val)[:2]
    axes, cols = [], []
    for name, a in zip("xy", order):
        v = vec[:, a] * np.sign(vec[np.argmax(np.abs(vec[:, a])), a] or 1.0)
        cols.append(sum((x[i] - F.lit(float(r[f"m{i}"] or 0.0))) * F.lit(float(v[i])) for i in range(d)).alias(name))
        top = np.argsort(-np.abs(v), kind="stable")[:3]
        axes.append({"explained": float(val[a] / max(val.sum(), 1e-12)), "drivers": [(names[i], 1 if v[i] > 0 else -1) for i in top]})
    return space.select(*keep, *cols), axes
