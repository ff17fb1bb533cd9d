"""Spelling variants against brute force."""
import random
import re
import zlib
from collections import Counter

from lamella.llm import op12_spelling_grams as op

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def edits(word, letters):
    for i in range(len(word) + 1):
        if i < len(word):
            yield word[:i] + word[i + 1 :]
        for c in letters:
            yield word[:i] + c + word[i:]
            if i < len(word):
                yield word[:i] + c + word[i + 1 :]


def brute(counts, factor=5):
    letters = {c for w in counts for c in w}
    near = {w: {x for x in edits(w, letters) if x in counts and x != w} for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (counts[w], len(near[w]), form[w], form[w] and counts[form[w]], root)
    return out


def got(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def words_of(seed, size=1500):
    """Few letters and many near words; chains of forms; accents."""
    rng, out = random.Random(seed), {}
    while len(out) < size:
        w = "".join(rng.choice("abné÷") for _ in range(rng.randint(4, 9))) if not out or rng.random() < 0.4 else rng.choice(list(edits(rng.choice(list(out)), "abz")))
        if w:
            out[w] = rng.choice([5, 6, 25, 30, 125, 150, 700, 4000])
    return out


def test_variants_equal_brute_force(spark):
    for seed in (1, 2):
        counts = words_of(seed)
        words = spark.createDataFrame([(w, n, 1) for w, n in counts.items()], "word string, n long, form int").repartition(5)
        assert got(op.variants(words)) == brute(counts)


def test_near_pairs_with_longer_grams(spark):
    counts = words_of(3, 600)
    words = spark.createDataFrame([(w,) for w in counts], "word string")
    pairs = {(r.a, r.b) for r in op.near_pairs(words, 2, 5, 40).collect()}
    assert pairs == {(w, x) for w in counts for x in edits(w, set("abznéÀ÷")) if x in counts and w < x}


def test_a_change_leaves_the_safe_grams(spark):
    counts = words_of(4, 800)
    words = spark.createDataFrame([(w,) for w in counts], "word string")
    index = op.Grams(op.dictionary(words))
    assert index.grams and all(len(g) == 3 for g in index.grams)
    gram_set = lambda w: Counter(w[a:b] for a, b in index.spans(w))
    for w in list(counts)[:150]:
        if len(w) >= 2 * op.QMAX:
            assert all(left or right for _, left, right in index.safe(w)), w
        for x in edits(w, "abz"):
            if x != w and len(x) > 1:
                common = sum((gram_set(w) & gram_set(x)).values())
                assert common >= max(len(index.spans(v)) - index.affected(v) for v in (w, x))
                assert index.lists(w) & index.lists(x)


def test_dictionary_extends_frequent_grams_only(spark):
    words = spark.createDataFrame([("aaaaaaaa",)] * 1 + [(f"{a}{b}xyzw",) for a in "bcdefg" for b in "hijklm"], "word string")
    assert op.dictionary(words, 2, 3, 5) == {"xyz", "yzw"}
    assert "xyzw" in op.dictionary(words, 2, 4, 5)


def test_vocabulary_equals_brute_force(spark):
    rng = random.Random(5)
    stock = ["Ordinary", "ordinary", "ORDINARY", "Ünders", "ünders", "short", "naïveté", "dot.within", "x1letter", "multi×plied", "ab", "seventy"]
    rows = [(rng.choice([None, i]), rng.choice([None, ""]) if i % 17 == 0 else " ".join(rng.choice(stock) for _ in range(rng.randint(1, 60)))) for i in range(400)]
    rows += [(7, "ordinary " * 3000), (7, "ordinary " * 3000)]
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            assert run == op.damaged(key, run) or h % 199 == 0
            counts[run] += 1
    expected = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    docs = spark.createDataFrame([(k, t, "w", 1) for k, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    assert {r.word: r.n for r in op.vocabulary(docs, modulus=199).collect()} == expected
    assert got(op.groups(docs)) == brute(expected)


def test_empty_table_and_no_words(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op.groups(docs).columns == ["word", "n", "n_near", "form", "form_n", "root"] and op.groups(docs).count() == 0
    assert op.groups(spark.createDataFrame([(1, None), (2, "few")], "doc_id long, text string")).count() == 0


def test_query_equals_brute_force_on_the_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = Counter()
    for r in docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            counts[op.damaged(r.doc_id, run.translate(LOWER))] += 1
    assert got(op.groups(docs)) == brute({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
