"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found with a block-max inverted index.

Fit, on a bounded sample of labelled texts (`per_class` texts of each class, equal texts counted once, taken in hash order of the text):
features are lower-cased words and their first letters; those that mark toxic texts by the likelihood ratio of their rates make the
vocabulary. A feature counts once for each pair of words around it, so that copied passages do not count as evidence over and over.
Document frequencies are counted over all documents. The examples' unit vectors form the index: blocks of `BLOCK` examples, in each
block the postings of its terms, and for each term and block the largest weight. A text's bound for a block is the product
of its weights with these; blocks are read by falling bound until none can beat the k-th neighbour found.
Neighbours vote with weight 1 / (distance + a constant); isotonic regression on the examples, each without its own vote and
weighted to the true class shares, turns the votes into probabilities.

A text that shares no feature with the examples, an empty or a null one has the score of no votes. Equal texts have equal scores. With no
labelled rows, or labels of one class, the score is the share of that class (0 without any).
"""
from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Memo, caches, fresh, own_memory

WORD = re.compile(r"[^\W\d_]+")
BLOCK = 64
PREFIXES = (4, 5, 6)


def features(word: str) -> list[str]:
    return [word] + ["^" + word[:n] for n in PREFIXES if len(word) > n]


def _words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _ratio(a, b, ta, tb):
    """Likelihood ratio statistic of counts a of ta and b of tb, and the log of the ratio of the rates."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    p = (a + b) / (ta + tb)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(a > 0, a * np.log(a / (ta * p)), 0) + np.where(b > 0, b * np.log(b / (tb * p)), 0))
    return g, np.log((a + 0.5) / ta) - np.log((b + 0.5) / tb)


@dataclass
class BlockMaxIndex:
    """Unit vectors of examples, terms x examples, in blocks; exact top k by cosine."""

    vectors: np.ndarray  # examples x terms, rows of length 1
    terms: list[np.ndarray] = field(default_factory=list)
    tiles: list[np.ndarray] = field(default_factory=list)
    most: np.ndarray | None = None

    def __post_init__(self):
        n, v = self.vectors.shape
        bounds = []
        for at in range(0, n, BLOCK):
            part = self.vectors[at : at + BLOCK]
            have = np.flatnonzero(part.any(0))
            self.terms.append(have)
            self.tiles.append(np.ascontiguousarray(part[:, have].T))
            bounds.append(part.max(0))
        self.most = np.array(bounds).T if bounds else np.zeros((v, 0))
        self.vectors = None

    def top(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Cosines (0 where there are fewer than k with a common term) and example numbers (-1) of the k nearest of each unit row."""
        n = len(queries)
        best, which = np.zeros((n, k)), np.full((n, k), -1, np.int64)
        bound = queries @ self.most
        order = np.argsort(-bound, axis=1, kind="stable")
        for r in range(order.shape[1]):
            blocks = order[:, r]
            open_ = np.flatnonzero(bound[np.arange(n), blocks] > np.maximum(best[:, -1] - 1e-12, 0))
            if not len(open_):
                break
            for b in np.unique(blocks[open_]):
                rows = open_[blocks[open_] == b]
                sims = queries[np.ix_(rows, self.terms[b])] @ self.tiles[b]
                all_s = np.hstack([best[rows], np.round(sims, 12)])
                all_w = np.hstack([which[rows], np.broadcast_to(b * BLOCK + np.arange(sims.shape[1]), sims.shape)])
                all_w = np.where(all_s > 0, all_w, -1)
                pick = np.lexsort((all_w, -all_s), axis=1)[:, :k]
                best[rows], which[rows] = np.take_along_axis(all_s, pick, 1), np.take_along_axis(all_w, pick, 1)
        return best, which


@dataclass
class Model:
    vocabulary: dict[str, int]
    idf: np.ndarray
    index: BlockMaxIndex
    labels: np.ndarray
    names: np.ndarray  # document number of each example, for evidence
    base: float
    k: int
    steps: tuple = ()  # isotonic: votes and probabilities

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_found"}

    def _memo(self) -> Memo:
        if not hasattr(self, "_found"):
            self._found = Memo(lambda w: tuple(self.vocabulary[f] for f in features(w) if f in self.vocabulary), 60_000)
            caches.append(lambda: self.__dict__.pop("_found", None))
        return self._found

    def counts(self, text: str | None) -> Counter:
        memo = self._memo()
        return Counter(i for hit in map(memo.__getitem__, _words(text)) if hit for i in hit)

    def vectors(self, counts: list[Counter]) -> np.ndarray:
        out = np.zeros((len(counts), len(self.vocabulary)))
        for r, c in enumerate(counts):
            for i, n in c.items():
                out[r, i] = (1 + np.log(n)) * self.idf[i]
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1)

    def votes(self, sims: np.ndarray, which: np.ndarray) -> np.ndarray:
        weight = np.where(which >= 0, 1 / (1.05 - np.minimum(sims, 1)), 0)
        label = np.where(which >= 0, self.labels[np.maximum(which, 0)], 0) if len(self.labels) else np.zeros(which.shape)
        return ((weight * label).sum(1) + self.base) / (weight.sum(1) + 1)

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        return np.interp(votes, *self.steps) if self.steps else np.full(len(votes), self.base)

    def score(self, texts) -> tuple[np.ndarray, np.ndarray]:
        counts = [self.counts(t) for t in texts]
        some = np.array([k for k, c in enumerate(counts) if c], np.int64)
        votes, which = np.full(len(counts), self.base), np.full((len(counts), self.k), -1, np.int64)
        if len(some) and len(self.labels):
            sims, which[some] = self.index.top(self.vectors([counts[k] for k in some]), self.k)
            votes[some] = self.votes(sims, which[some])
        return np.round(self.calibrated(votes), 6), which


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising step means of y over x by pooling neighbours that fall; ends of each step, for interpolation."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], w[order], strict=True):
        pools.append([b * c, c, a, a])
        while len(pools) > 1 and (pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1] or pools[-2][3] == pools[-1][2]):
            s, t, _, hi = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + t, pools[-1][2], hi]
    return np.array([e for p in pools for e in (p[2], p[3])]), np.array([p[0] / p[1] for p in pools for _ in range(2)])


def _feature_counts(sample: DataFrame, candidates: frozenset | None) -> DataFrame:
    """feature, a, b: toxic and clean documents with it; with candidates, places with different neighbour words instead."""
    def run(batches):
        own_memory("toxicity")
        for batch in (b.iloc[at : at + 128] for b in batches for at in range(0, len(b), 128)):
            out: dict = {} if candidates is None else set()
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                ws = _words(text)
                if candidates is None:
                    for f in {f for w in set(ws) for f in features(w)}:
                        out[f, toxic] = out.get((f, toxic), 0) + 1
                else:
                    around = ["", *ws, ""]
                    out |= {(f, toxic, xxhash.xxh3_64_intdigest(f"{around[i]} {around[i + 2]}") >> 1) for i, w in enumerate(ws) for f in features(w) if f in candidates}
            rows = [(f, y, n) for (f, y), n in out.items()] if candidates is None else list(out)
            yield pd.DataFrame(rows, columns=["feature", "toxic", "n"])

    rows = sample.select("text", "toxic").mapInPandas(run, "feature string, toxic int, n long")
    total = F.sum("n") if candidates is None else F.count(F.lit(1))
    if candidates is not None:
        rows = rows.distinct()
    return rows.groupBy("feature", "toxic").agg(total.alias("n")).groupBy("feature").agg(
        F.coalesce(F.sum(F.expr("CASE WHEN toxic = 1 THEN n END")), F.lit(0)).alias("a"), F.coalesce(F.sum(F.expr("CASE WHEN toxic = 0 THEN n END")), F.lit(0)).alias("b"))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """text, toxic, doc_id of at most `per_class` different texts of each class, in hash order; a text with both labels has the larger
    one. Only ids and hashes are shuffled; the chosen ids, at most twice `per_class`, are broadcast."""
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    hashed = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"))
    texts = hashed.join(marks, "doc_id").groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    chosen = texts.where("toxic = 1").orderBy("h").limit(per_class).union(texts.where("toxic = 0").orderBy("h").limit(per_class))
    rows = docs.sparkSession.createDataFrame([tuple(r) for r in chosen.select("doc_id", "toxic").collect()], "doc_id long, toxic int")
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(rows), "doc_id").dropDuplicates(["doc_id"])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, vocabulary: int = 1024, k: int = 16, least_ratio: float = 20.0, least_log: float = 2.0) -> Model:
    """`docs`: doc_id, text (all documents; document frequencies come from them). `labels`: doc_id, toxic (rows to learn from)."""
    share = labels.agg(F.coalesce(F.avg(F.col("toxic").cast("double")), F.lit(0.0))).first()[0]
    sample = labelled_sample(docs, labels, per_class).persist()
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    empty = Model({}, np.zeros(0), BlockMaxIndex(np.zeros((0, 0))), np.zeros(0), np.zeros(0, np.int64), float(share), k)
    if len(sizes) < 2:
        sample.unpersist()
        return empty
    counted = _feature_counts(sample, None)
    total = counted.agg(F.sum("a"), F.sum("b")).first()
    likely = counted.where(F.col("a") >= 3).where(F.log((F.col("a") + 0.5) / total[0]) - F.log((F.col("b") + 0.5) / total[1]) > least_log / 2)
    rows = likely.orderBy(F.desc("a"), "feature").limit(20 * vocabulary).collect()
    counted = _feature_counts(sample, frozenset(r["feature"] for r in rows)).collect()
    a, b = np.array([r["a"] for r in counted], float), np.array([r["b"] for r in counted], float)
    g, lead = _ratio(a, b, total[0], total[1])
    good = [k_ for k_ in np.lexsort(([r["feature"] for r in counted], -g)) if g[k_] >= least_ratio and lead[k_] >= least_log and a[k_] >= 4][:vocabulary]
    if not good:
        sample.unpersist()
        return empty
    model = Model({counted[i]["feature"]: n for n, i in enumerate(good)}, np.ones(len(good)), empty.index, empty.labels, empty.names, float(share), k)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def frequencies(batches):
        own_memory("toxicity")
        for batch in batches:
            total = np.zeros(len(good), np.int64)
            for t in batch["text"]:
                total[list(shared.value.counts(t))] += 1
            yield pd.DataFrame({"term": [-1, *range(len(good))], "n": [len(batch), *total]})

    df = {r["term"]: r["n"] for r in docs.select(F.col("text").cast("string").alias("text")).mapInPandas(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    model.idf = np.log((1 + df[-1]) / (1 + np.array([df[n] for n in range(len(good))]))) + 1
    examples = sorted(sample.collect(), key=lambda r: r["doc_id"])  # at most twice `per_class`
    sample.unpersist()
    vectors = model.vectors([model.counts(r["text"]) for r in examples])
    some = np.flatnonzero(vectors.any(1))
    some = some[np.lexsort((some, vectors[some].argmax(1)))]  # like with like: tight bounds
    model.labels = np.array([examples[i]["toxic"] for i in some], float)
    model.names = np.array([examples[i]["doc_id"] for i in some], np.int64)
    model.index = BlockMaxIndex(vectors[some])
    all_y = np.array([r["toxic"] for r in examples], float)
    weight = np.where(all_y == 1, share / max(1, sizes[1]), (1 - share) / max(1, sizes[0]))
    votes = np.full(len(examples), model.base)
    sims, which = model.index.top(vectors[some], k + 1)
    own = which == np.arange(len(some))[:, None]  # without its own vote
    own[~own.any(1), -1] = True
    votes[some] = model.votes(sims[~own].reshape(len(some), k), which[~own].reshape(len(some), k))
    model.steps = isotonic(votes, all_y, weight)
    return model


def scorer(spark, model: Model):
    """A column function of the text: struct of score and of the example documents that voted."""
    shared = spark.sparkContext.broadcast(model)  # at most twice `per_class` rows of `vocabulary` terms

    @F.pandas_udf("score double, evidence array<long>")
    def score(texts: pd.Series) -> pd.DataFrame:
        own_memory("toxicity")
        m, scores, evidence = shared.value, [], []
        for at in range(0, len(texts), 512):
            s, which = m.score(texts.iloc[at : at + 512])
            scores += s.tolist()
            evidence += [[int(m.names[i]) for i in w[:4] if i >= 0] for w in which]
        return pd.DataFrame({"score": pd.Series(scores, dtype=float), "evidence": pd.Series(evidence, dtype=object)})

    return score


HELD_OUT = "crc32(CAST(doc_id AS STRING)) % 3 = 1"


def learnable(labels: DataFrame) -> DataFrame:
    """The labels of rows that are not held out."""
    return labels.select("doc_id", "toxic").where(f"NOT ({HELD_OUT})")


def keep(docs: DataFrame, labels: DataFrame, below: float = 0.7) -> DataFrame:
    """The documents that score below `below`. Same columns as `docs`."""
    score = scorer(docs.sparkSession, fit(docs, learnable(labels)))
    (made,) = fresh(docs, "scored")
    return docs.withColumn(made, score(F.col("text").cast("string"))).where(F.col(f"{made}.score") < below).drop(made)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's row per document."""
    score = scorer(docs.sparkSession, fit(docs, learnable(labels)))
    rows = docs.select("doc_id", F.expr(f"coalesce({HELD_OUT}, false)").alias("held_out"), score(F.col("text").cast("string")).alias("s"))
    return rows.select("doc_id", "held_out", F.col("s.score").alias("score"), (F.col("s.score") >= 0.7).cast("int").alias("predicted"), F.col("s.evidence").alias("evidence"))
