"""Removing passages that an earlier document has, by doubling the length of repeated windows.

A passage of `length` words can only repeat if its shorter windows do. The first level takes short windows (`length` halved `levels`
times) and of these, in each passage, only the one with the smallest hash: equal passages choose equal windows, so a few percent of
the windows are shuffled and no repeat is missed. Windows that two documents share survive. Each further level extends the survivors to
twice the length (at most `length`): a longer window is a candidate if the survivors of the level before cover what it needs,
its hash goes out with its document, and it survives if another document has it. The last level finds whether a smaller document
has the passage; a document loses the words of those passages. Neighbouring candidates go out as one run, and only runs that overlap others in
part are taken apart into passages, see _earlier. Without survivors the later levels have nothing to do.

Passages are told apart by 128 bits (their short window's hash and their own), windows of the levels before by 64 (a false survivor there
only costs work). Which documents share a window is found with partial aggregates (smallest and largest document), so a passage that
a third of all documents have is reduced before it is shuffled; survivors are stored and return to their rows by joins of two plain
shuffles, whose large partitions may be split. Windows are judged on the input, not on what is left.

Nulls and empty texts have no words. Rows with the same key (or without one; these count as the largest) count as one document: they do not
remove each other's words, each loses what a smaller document has. Texts shorter than a passage are kept whole. An empty
table gives an empty result.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import few, picked, stored
from .text import SLICE, fresh, own_memory, window_hashes, word_hashes, words

HOT = 1 << 16


def chosen(h: np.ndarray, short: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `length` words the place of its smallest `short` window; and the hashes of all short windows."""
    w = window_hashes(h, short, 1)
    if len(h) < length:
        return np.empty(0, np.int64), w
    span = length - short + 1
    out = np.empty(len(h) - length + 1, np.int64)
    for at in range(0, len(out), HOT):
        view = sliding_window_view(w[at : at + HOT + span - 1], span)
        out[at : at + HOT] = view.argmin(1)[: len(out) - at] + np.arange(at, min(at + HOT, len(out)))
    return out, w


def removed(n: int, starts: list, length: int) -> np.ndarray:
    """Which of n words lie in a window of `length` from one of the runs (place, number) of starts."""
    edge = np.zeros(n + 1, np.int64)
    for s in starts:
        edge[s["at"]] += 1
        edge[s["at"] + s["n"] - 1 + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def _order(key: str) -> Column:
    return F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1))


def _mark(docs: DataFrame, key: str, text: str) -> Column:
    """Tells apart rows of one key: nothing where keys are distinct, else a hash of the text."""
    own = F.xxhash64(F.col(text).cast("string"))
    twice = docs.groupBy(_order(key)).agg(F.min(own).alias("a"), F.max(own).alias("b")).where("a < b")
    return F.lit(0).cast("long") if twice.isEmpty() else own


def _alive(rows: DataFrame) -> DataFrame:
    """doc, mark, alive: the hashes of each document that another document has as well."""
    shared = rows.groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("h")
    return stored(rows.join(stored(shared, "shared"), "h").groupBy("doc", "mark").agg(F.collect_set("h").alias("alive")), "alive")


def starts(docs: DataFrame, length: int, levels: int, key: str, text: str, mark: Column) -> DataFrame:
    """doc, mark, starts: runs (place, number) of the windows of `length` words that a smaller document has as well."""
    sizes = [length]
    for _ in range(levels):
        sizes.insert(0, -(-sizes[0] // 2))
    base = docs.select(_order(key).alias("doc"), mark.alias("mark"), F.col(text).cast("string").alias("text"))

    def first(batches):
        own_memory("substrings")
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                ids, marks, got = [], [], []
                part = batch.iloc[at : at + SLICE]
                for d, m, t in zip(part["doc"], part["mark"], part["text"], strict=True):
                    ws = words(t)
                    if len(ws) >= length:
                        places, w = chosen(word_hashes(ws), sizes[0], length)
                        hs = np.unique(w[np.unique(places)])
                        ids.append(np.full(len(hs), d))
                        marks.append(np.full(len(hs), m))
                        got.append(hs.view(np.int64))
                if ids:
                    yield pd.DataFrame({"doc": np.concatenate(ids), "mark": np.concatenate(marks), "h": np.concatenate(got)})

    rows = stored(base.mapInPandas(first, "doc long, mark long, h long"), "windows")
    for level in range(1, levels):
        alive = _alive(rows)
        rows = stored(_with_text(base, alive).mapInPandas(_extended(sizes, level), "doc long, mark long, h long"), "windows")
    runs = stored(_with_text(base, _alive(rows)).mapInPandas(_runs(sizes), "doc long, mark long, h long, run long, at int, n int, each binary"), "runs")
    return _earlier(runs)


def _with_text(base: DataFrame, alive: DataFrame) -> DataFrame:
    return picked(base, alive.select("doc").distinct(), ["doc"]).join(alive, ["doc", "mark"])


def _extended(sizes: list[int], level: int):
    """Rows (doc, mark, h) of the candidates of a level between the first and the last."""
    def run(batches):
        for batch in batches:
            for d, m, t, ok in zip(batch["doc"], batch["mark"], batch["text"], batch["alive"], strict=True):
                h = word_hashes(words(t))
                hs = np.unique(window_hashes(h, sizes[level], 2)[_candidates(h, sizes, level, np.asarray(ok, np.int64))]).view(np.int64)
                yield pd.DataFrame({"doc": np.full(len(hs), d), "mark": m, "h": hs})

    return run


def _runs(sizes: list[int]):
    """Rows of the last level. Neighbouring candidates that chose the same short window form a run: h, the hash of that window; run, the hash
    of all passages in it; each, their 64-bit hashes. Equal passages chose equal windows, so hashes only meet under one h."""
    def run(batches):
        for batch in batches:
            out = []
            for d, m, t, ok in zip(batch["doc"], batch["mark"], batch["text"], batch["alive"], strict=True):
                h = word_hashes(words(t))
                at = _candidates(h, sizes, len(sizes) - 1, np.asarray(ok, np.int64))
                if len(at):
                    places, short = chosen(h, sizes[0], sizes[-1])
                    each = window_hashes(h, sizes[-1], 3)[at]
                    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(places[at]) != 0)) + 1
                    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True):
                        raw = each[a:b].tobytes()
                        out.append((d, m, int(short[places[at[a]]].view(np.int64)), xxhash.xxh3_64_intdigest(raw) - (1 << 63), int(at[a]), b - a, raw))
            yield pd.DataFrame(out, columns=["doc", "mark", "h", "run", "at", "n", "each"])

    return run


def _earlier(runs: DataFrame) -> DataFrame:
    """A run that a smaller document has as well goes whole. Of the other runs, those under a window with several kinds of run are taken
    apart, one document for each kind, and their passages are looked up one by one; inside of copied text that is none."""
    kinds = stored(runs.groupBy("h", "run").agg(F.min("doc").alias("first")), "kinds")
    placed = runs.join(kinds, ["h", "run"])
    whole = placed.where("first < doc").select("doc", "mark", "at", "n")
    several = stored(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("h"), "several")

    def apart(batches):
        for batch in batches:
            n = batch["n"].to_numpy(np.int64)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pd.DataFrame({"doc": np.repeat(batch["doc"].to_numpy(), n), "mark": np.repeat(batch["mark"].to_numpy(), n), "h": np.repeat(batch["h"].to_numpy(), n),
                                "w": np.frombuffer(b"".join(batch["each"]), np.int64), "at": (np.repeat(batch["at"].to_numpy(np.int64), n) + inner).astype(np.int32)})

    single = stored(placed.where("first = doc").join(several, "h", "left_semi").select("doc", "mark", "h", "at", "n", "each").mapInPandas(apart, "doc long, mark long, h long, w long, at int"), "passages")
    shared = single.groupBy("h", "w").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
    one = single.join(stored(shared, "shared"), ["h", "w"]).where("first < doc").select("doc", "mark", "at", F.lit(1).alias("n"))
    return stored(whole.unionByName(one).groupBy("doc", "mark").agg(F.collect_list(F.struct("at", "n")).alias("starts")), "starts")


def _candidates(h: np.ndarray, sizes: list[int], level: int, alive: np.ndarray) -> np.ndarray:
    """Places of the windows of sizes[level] words that the survivors of the level before allow. After the first level these are the
    windows whose passage chose a survivor; later, those that begin and end with a survivor."""
    alive, size, before = np.sort(alive), sizes[level], sizes[level - 1]
    if len(h) < sizes[-1]:
        return np.empty(0, np.int64)
    if level == 1:
        places, w = chosen(h, before, sizes[-1])
        ok = np.isin(w[places].view(np.int64), alive)
        passages = np.flatnonzero(ok)
        if size == sizes[-1]:
            return passages
        inside = np.zeros(len(h) + 1, np.int64)
        np.add.at(inside, passages, 1)
        np.add.at(inside, passages + sizes[-1] - size + 1, -1)
        return np.flatnonzero(np.cumsum(inside)[: len(h) - size + 1] > 0)
    ok = np.isin(window_hashes(h, before, 2).view(np.int64), alive)
    n = len(h) - size + 1
    return np.flatnonzero(ok[:n] & ok[size - before : size - before + n])


def _with_cut(docs: DataFrame, length: int, levels: int, key: str, text: str) -> tuple[DataFrame, str]:
    """`docs` and the name of a struct added: kept_text (null if nothing of the text goes), n_words, n_removed."""
    if length < 2 or levels < 1 or length >> levels < 1:
        raise ValueError("length >= 2 and 1 <= levels, and the first level must have a word")
    doc, mark, at, cut = fresh(docs, "doc", "mark", "starts", "cut")
    own = _mark(docs, key, text)
    gone = starts(docs, length, levels, key, text, own).toDF(doc, mark, at)
    rows = docs.withColumns({doc: _order(key), mark: own})
    hit = gone.select(doc).distinct()
    if few(hit):  # texts that lose nothing stay where they are
        rest = rows.join(F.broadcast(hit), doc, "left_anti").withColumn(at, F.lit(None).cast(gone.schema[at].dataType))
        rows = rows.join(F.broadcast(hit), doc, "left_semi").join(gone, [doc, mark], "left").unionByName(rest)
    else:
        rows = rows.join(gone, [doc, mark], "left")

    def run(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        own_memory("substrings")
        out = []
        for t, s in zip(texts, places, strict=True):
            ws = words(t)
            if s is None or not len(s):
                out.append((None, len(ws), 0))
            else:
                off = removed(len(ws), s, length)
                out.append((b" ".join([w for w, o in zip(ws, off.tolist(), strict=True) if not o]).decode("utf-8", "surrogatepass"), len(ws), int(off.sum())))
        return pd.DataFrame(out, columns=["kept_text", "n_words", "n_removed"])

    made = F.pandas_udf(run, "kept_text string, n_words long, n_removed long")
    return rows.withColumn(cut, made(F.col(text).cast("string"), F.col(at))), cut


def dedup(docs: DataFrame, length: int = 50, levels: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with `kept_text` (what is left, words joined by one space; null if nothing of the text goes), `n_words`, `n_removed`;
    columns of these names are replaced."""
    rows, cut = _with_cut(docs, length, levels, key, text)
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("kept_text", "n_words", "n_removed")], f"{cut}.*")


def kept_documents(docs: DataFrame, length: int = 50, levels: int = 1) -> DataFrame:
    """Same rows and columns as `docs`; texts that lose words hold what is left, and n_chars its length."""
    rows, cut = _with_cut(docs, length, levels, "doc_id", "text")
    left = F.coalesce(F.col(f"{cut}.kept_text"), F.col("text"))
    size = F.when(F.col(f"{cut}.n_removed") > 0, F.length(left).cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    new = {"text": left, "n_chars": size}
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def digests(docs: DataFrame) -> DataFrame:
    """The contract's row per document."""
    cut = dedup(docs.select("doc_id", "text"))
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept_text", plain), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 49, 0) + 1)) AS i, w FROM d),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS first FROM k GROUP BY h HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT k.doc_id, unnest(range(k.i, k.i + 50)) AS p FROM k JOIN f ON k.h = f.h AND f.first < k.doc_id),
g AS (SELECT doc_id, list(p) AS gone FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN gone IS NOT NULL AND list_contains(gone, i) THEN NULL ELSE w[i] END), lambda x: x IS NOT NULL), ' ')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
