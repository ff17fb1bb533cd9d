"""Line dedup by levelled runs against brute force."""
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lamella.llm import op11_line_runs as op

WHITE = " \t\n\v\f\r"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def key(line):
    return line.strip(WHITE).translate(LOWER)


def brute(rows, least, chars):
    have = defaultdict(set)
    for k, text in rows:
        for line in (text or "").split("\n"):
            have[key(line)].add(k)
    gone = {line for line, keys in have.items() if len(line) >= chars and len(keys) >= least}
    out = []
    for k, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if key(x) not in gone]
        out.append((k, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return Counter(out)


@pytest.mark.parametrize(("least", "chars", "batches", "fanout"), [(3, 1, 4, 2), (2, 3, 5, 3), (1, 1, 1, 2), (4, 0, 3, 2)])
def test_lines_equal_brute_force(spark, least, chars, batches, fanout):
    rng = random.Random(least)
    stock = ["", " ", "Menu", " menu\t", "MENU", "Ünder", "ünder", " x", "é ", "a b", "A B ", "very long line " * 3, "\r", "ok", "ÀB", "àb"]
    rows = [(rng.choice([None, *range(40)]) if rng.random() < 0.4 else 100 + i, rng.choice([None, "", "\n\n", "\n".join(rng.choice(stock) if rng.random() < 0.7 else f"own {i} {j}" for j in range(rng.randint(1, 9)))])) for i in range(120)]
    rows += rows[:5]
    docs = spark.createDataFrame([(k, t, "c", 1) for k, t in rows], "doc_id long, text string, kept string, row int").repartition(3)
    out = op.drop_lines(docs, least=least, chars=chars, batches=batches, fanout=fanout)
    assert out.columns == ["doc_id", "text", "kept", "row", "n_lines", "n_dropped", "kept_"]
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_) for r in out.collect()) == brute(rows, least, chars)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op.digests(docs).count() == 0 and op.digests(docs).columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]


def test_a_very_long_text_and_a_line_that_all_documents_have(spark):
    rows = [(i, "Common\n" + "\n".join(f"{i} {j}" for j in range(20_000 if i == 3 else 2))) for i in range(60)]
    got = {r.doc_id: r for r in op.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].n_dropped == 1 and got[i].kept == t[7:] for i, t in rows) and got[3].n_lines == 20_001


def test_runs_are_levelled_and_close(spark):
    runs = op.LineRuns(spark, 1)
    part = lambda *hashes: spark.createDataFrame([(h, -h, 1) for h in hashes], "hi long, lo long, n long")
    seen = set()
    for k, batch in enumerate([(1, 2, 2), (2, 3), (3, 4), (1, 5), (6,)], 1):
        new = {r.hi for r in runs.add(part(*batch)).collect()}
        assert new == set(batch) - seen
        seen |= set(batch)
        assert [len(level) for level in runs.levels] == [int(b) for b in reversed(f"{k:b}")]
    assert {r.hi for r in runs.closed().collect()} == seen
    tables = [t.name for t in spark.catalog.listTables() if t.name.startswith(runs.prefix)]
    runs.drop()
    assert tables and not [t for t in spark.catalog.listTables() if t.name in tables]


def test_counts_close_at_the_limit_and_merges_need_no_shuffle(spark):
    runs = op.LineRuns(spark, 3)
    rows = lambda *pairs: spark.createDataFrame([(h, 0, n) for h, n in pairs], "hi long, lo long, n long")
    assert {r.hi: r.n for r in runs.add(rows((1, 2), (2, 3))).collect()} == {1: 2, 2: 3}
    assert {r.hi: r.n for r in runs.add(rows((1, 1), (2, 1), (3, 1), (3, 1))).collect()} == {1: 1, 3: 2}
    assert {r.hi for r in runs.closed().collect()} == {1, 2}
    merged = runs._merged([spark.table(f"{runs.prefix}_0"), spark.table(f"{runs.prefix}_1")])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in merged.where(F.col("n") >= 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    runs.drop()
