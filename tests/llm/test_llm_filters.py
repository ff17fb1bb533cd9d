"""Toxicity and quality: brute force of their parts, held-out accuracy, defined edge cases."""
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.llm import op1_toxicity, op7_quality_votes

SF = "/root/testdata/sf0.1"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_index_is_exact():
    rng = np.random.default_rng(4)
    x = rng.random((500, 60)) * (rng.random((500, 60)) < 0.08)
    x = x[x.any(1)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[::3] + 0.3 * rng.random(x[::3].shape) * (rng.random(x[::3].shape) < 0.05)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    sims, which = op1_toxicity.BlockMaxIndex(x.copy()).top(q, 10)
    full = np.round(q @ x.T, 12)
    for r in range(len(q)):
        order = np.lexsort((np.arange(len(x)), -full[r]))[:10]
        want = [(i if full[r][i] > 0 else -1) for i in order]
        assert which[r].tolist() == want
        assert np.allclose(sims[r], np.maximum(full[r][order], 0))
    empty = op1_toxicity.BlockMaxIndex(np.zeros((0, 3)))
    assert empty.top(np.ones((2, 3)), 4)[1].tolist() == [[-1] * 4] * 2


def test_isotonic_rises_and_keeps_the_mean():
    rng = np.random.default_rng(7)
    x, w = rng.random(400).round(2), rng.random(400) + 0.1
    y = (rng.random(400) < x).astype(float)
    at, to = op1_toxicity.isotonic(x, y, w)
    fit = np.interp(x, at, to)
    assert (np.diff(to) >= 0).all() and (np.diff(at) >= 0).all()
    assert abs((fit * w).sum() - (y * w).sum()) < 1e-6 * w.sum() + 0.02 * w.sum()


def toy(spark):
    rng = random.Random(3)
    clean = [a + b for a in "bcdfgjklm" for b in "aeiouwyzr"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        w = [rng.choice(clean) for _ in range(30)]
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(30), rng.choice(["vileone", "viletwo", "grim"]))
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, int(toxic)))
    rows += [(900, None, "en", "s"), (901, "", "en", "s"), (902, "VileOne!", "en", "s"), (903, "VileOne!", None, None), (None, "grim grim", "en", "s"), (0, rows[0][1], "en", "s")]
    docs = spark.createDataFrame([(*r, 0, "e", "v") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, scored string, evidence string")
    return docs, spark.createDataFrame(labels + [(None, 1), (3, None), (77_777, 1), (5, 1), (5, 1)], "doc_id long, toxic int")


def test_toxicity_on_a_toy_corpus(spark):
    docs, labels = toy(spark)
    rows = op1_toxicity.scores(docs, labels).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(by[i].predicted == int(i % 5 == 0) for i in range(400))
    assert by[902].score == by[903].score >= 0.7 and by[900].score == by[901].score < 0.1
    assert by[None].predicted == 1 and by[None].held_out is False
    assert by[902].evidence and all(i % 5 == 0 for i in by[902].evidence)
    kept = op1_toxicity.keep(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.predicted == 0}


def test_toxicity_without_labels_or_documents(spark):
    docs, labels = toy(spark)
    for none in (labels.limit(0), labels.where("toxic = 0")):
        assert {r.score for r in op1_toxicity.scores(docs, none).collect()} == {0.0}
    assert {r.predicted for r in op1_toxicity.scores(docs, labels.where("toxic = 1")).collect()} == {1}
    assert op1_toxicity.scores(docs.limit(0), labels).count() == 0


def test_toxicity_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = op1_toxicity.scores(docs, labels).where("held_out").join(labels, "doc_id")
    n = {(r.toxic, r.predicted): r["count"] for r in scored.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.7 and n.get((0, 1), 0) / n[0, 0] < 0.01


def brute_stats(text):
    text = text or ""
    w = WORDS.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    often = Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_text_statistics_equal_brute_force():
    rng = random.Random(9)
    parts = ["a", "b", "é", "Ü!", "#x", "a|b", " ", "  ", "\n", "\t", "\x0b", " ", " ", "\x1c", "\x85", "$$$", "日本"]
    for n in (0, 1, 3, 10, 60, 300):
        for _ in range(40):
            text = "".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(n))
            assert op7_quality_votes.text_stats(text)[:5] == brute_stats(text), repr(text)
    assert op7_quality_votes.text_stats(None)[:5] == (0, 0, 0, 0, 0)
    assert op7_quality_votes.text_stats("x y\nx y\nx y")[3] == 2


def test_voting_model_recovers_accuracies():
    rng = np.random.default_rng(11)
    n = 20_000
    good = rng.random(n) < 0.8
    votes = np.ones((n, len(op7_quality_votes.RULES)), np.int64)
    right = np.linspace(0.7, 0.95, votes.shape[1])
    for k, p in enumerate(right):
        cast = rng.random(n) < 0.6
        correct = rng.random(n) < p
        votes[cast, k] = np.where(good[cast] == correct[cast], 2, 0)
    codes, counts = np.unique((votes * 3 ** np.arange(votes.shape[1])).sum(1), return_counts=True)
    model = op7_quality_votes.fit(codes, counts.astype(float))
    assert abs(model.prior - 0.8) < 0.03
    cast_right = model.table[1, :, 2] / (model.table[1, :, 2] + model.table[1, :, 0])
    assert np.abs(cast_right - right).max() < 0.05
    assert ((model.posterior(votes) >= 0.5) == good).mean() > 0.95
    assert (op7_quality_votes.digits(codes) * 3 ** np.arange(votes.shape[1])).sum(1).tolist() == codes.tolist()
    assert op7_quality_votes.fit(np.empty(0, np.int64), np.empty(0)).table.shape == (2, votes.shape[1], 3)


def test_patterns_follow_the_rules(spark):
    texts = ["$$$ a$$$ b$$$ c$$$", "plain words of a common kind that go on for some length so that there are many of them in all here now ok yes", None, "A!! B!! C!! D!!"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    names = [n for n, _, _ in op7_quality_votes.RULES]
    got = {r.doc_id: dict(zip(names, op7_quality_votes.digits(np.array([r.p]))[0])) for r in df.withColumn("s", op7_quality_votes.stats(F.col("text"))).select("doc_id", op7_quality_votes.pattern("s").alias("p")).collect()}
    assert got[0]["symbols"] == 0 and got[0]["size"] == 0 and got[1]["prose"] == 2 and got[1]["symbols"] == 1 and got[3]["capitals"] == 0 and got[3]["bangs"] == 0 and got[2]["size"] == 0


def test_quality_verdicts_and_filter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("stats", F.lit("x")).withColumn("pattern", F.lit(1)).withColumn("posterior", F.lit("p"))
    docs = docs.unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long")))
    rows = op7_quality_votes.verdicts(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed)
    kept = op7_quality_votes.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    known = [(labels[r.doc_id], r.kept) for r in rows if r.doc_id in labels and not r.base_failed]
    assert np.mean([k for y, k in known if y == 1]) > 0.99 and np.mean([not k for y, k in known if y == 0]) > 0.9
    assert op7_quality_votes.verdicts(docs.limit(0)).count() == 0 and op7_quality_votes.keep(docs.limit(0)).count() == 0


@pytest.mark.parametrize("condition,want", [("n_words < 10", "`s`.`n_words` < 10"), ("n_distinct >= 0.35 * n_words OR n_words >= 4000", "`s`.`n_distinct` >= 0.35 * `s`.`n_words` OR `s`.`n_words` >= 4000")])
def test_rule_conditions_name_the_struct(spark, condition, want):
    names = dict.fromkeys(f.split(" ")[0] for f in op7_quality_votes.STATS.split(", "))
    assert op7_quality_votes._sql(condition, names, "s")._jc.toString() == F.expr(want)._jc.toString()


def test_long_junk_of_few_words_is_voted_bad(spark):
    rng, short = random.Random(4), [f"w{k}" for k in range(30)]
    texts = [" ".join(rng.choice(short) for _ in range(n)) for n in (3999, 4000, 50_000)] + [" ".join(f"v{rng.randrange(9000)}" for _ in range(50_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("s", op7_quality_votes.stats(F.col("text")))
    at = [r[0] for r in op7_quality_votes.RULES].index("variety")
    votes = {r.doc_id: int(op7_quality_votes.digits(np.array([r.p]))[0][at]) for r in df.select("doc_id", op7_quality_votes.pattern("s").alias("p")).collect()}
    assert votes == {0: 0, 1: 0, 2: 0, 3: 1}
