"""Substring dedup, near duplicates and fingerprints against brute force."""
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from lamella.llm import op2_fingerprint, op3_substring_dedup, op8_odd_sketch

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, extra=True):
    """Columns with the names that the operators use inside."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    more = "doc string, mark string, starts string, cut string, made string, component string, n_words string, kept_text string, band string, n_chars long"
    return spark.createDataFrame([(*r, *"abcdefghi", len(r[1]) if r[1] else 0) for r in rows], f"doc_id long, text string, {more}")


def brute_removed(rows, length):
    big = 1 << 63
    split = [WORDS.findall(t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, split):
        for k in range(len(w) - length + 1):
            g = tuple(w[k : k + length])
            first[g] = min(first.get(g, big), big - 1 if i is None else i)
    out = []
    for (i, _), w in zip(rows, split):
        gone = set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < (big - 1 if i is None else i):
                gone |= set(range(k, k + length))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("length,levels", [(6, 1), (6, 2), (9, 3), (50, 1), (50, 3)])
def test_substring_dedup_equals_brute_force(spark, length, levels):
    rng = random.Random(length * 10 + levels)
    vocabulary = [f"w{k}" for k in range(3 if length < 10 else 400)] + ["é x"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(length - 2, 3 * length))] for _ in range(5)]
    rows = []
    for i in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 2 * length))]
        for _ in range(rng.randint(0, 2)):
            p, at = rng.choice(passages), rng.randint(0, len(w))
            w[at:at] = p[rng.randint(0, 3) :]
        rows.append((i * 7 % 61, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(100, None), (101, ""), (102, " \n"), (None, " ".join(passages[0])), (None, " ".join(passages[0])), (5, " ".join(passages[1])), (5, " ".join(passages[1]) + " tail"), (500, " ".join(passages[2]))]
    got = op3_substring_dedup.dedup(frame(spark, rows).repartition(3), length, levels).select("doc_id", "text", "n_words", "n_removed", "kept_text").collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_text if r.kept_text is not None else " ".join(WORDS.findall(r.text or ""))) for r in got)
    assert got == sorted((i is None, i or 0, *rest) for i, *rest in brute_removed(rows, length))


def test_substring_dedup_keeps_columns(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long), (2, "x  y " + long), (3, "a  b")]
    df = frame(spark, rows)
    out = op3_substring_dedup.kept_documents(df)
    assert out.columns == df.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: (long, len(long)), 2: ("x y", 3), 3: ("a  b", 4)}
    assert op3_substring_dedup.dedup(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        op3_substring_dedup.dedup(df, 4, 3)


def brute_set(text, width):
    w = [re.sub("[A-Z]+", lambda m: m[0].lower(), x) for x in WORDS.findall(text or "")]
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def brute_components(rows, width, percent):
    sets = [(i, brute_set(t, width)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in sets}


def near_rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"t{k}" for k in range(300)]
    rows, i = [], 0
    for size in (1, 1, 2, 3, 12, 40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(8, 120))]
        for k in range(size):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12)) if k else 0):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((i * 37 % 211, " ".join(w) if rng.random() < 0.8 else " ".join(w).upper()))
            i += 1
    chain = [rng.choice(vocabulary) for _ in range(100)]  # each like the one before, the ends unlike each other
    for k in range(12):
        chain[k * 8] = f"new{k}"
        rows.append((300 - k, " ".join(chain)))
    return rows + [(400, None), (401, ""), (402, " \t"), (403, "one"), (404, "ONE"), (405, "one  \n"), (None, "one"), (406, "Éa b"), (407, "éa b"), (408, rows[0][1]), (408, rows[0][1])]


@pytest.mark.parametrize("width,seed", [(2, 1), (2, 2), (5, 3)])
def test_near_duplicates_equal_brute_force(spark, width, seed):
    rows = near_rows(seed)
    got = op8_odd_sketch.linked(frame(spark, rows).repartition(3), width).collect()
    want = brute_components(rows, width, 80)
    assert len(got) == len(rows)
    for r in got:
        assert r.component == (None if r.doc is None else want[r.doc]), r
    sizes = {i: len(brute_set(t, width)) for i, t in rows}
    assert all(r.n_shingles == sizes[r.doc] for r in got)


def test_near_duplicates_keep_one_of_each_group(spark):
    rows = near_rows(4)
    df = frame(spark, rows)
    out = op8_odd_sketch.keep(df, 5)
    want = brute_components(rows, 5, 80)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == sorted(i for i, _ in rows if i is not None and want[i] == i)
    assert out.where("doc_id IS NULL").count() == 1
    assert op8_odd_sketch.linked(frame(spark, [])).count() == 0


def test_odd_sketch_estimates_high_similarities():
    rng = np.random.default_rng(3)
    for j in (1.0, 0.95, 0.9, 0.8):
        errors = []
        for _ in range(20):
            n = 600
            shared = int(round(2 * n * j / (1 + j)))
            pool = rng.integers(0, 1 << 63, 3 * n, dtype=np.uint64)
            a, b = pool[:n], np.concatenate([pool[:shared], pool[n : 2 * n - shared]])
            sk = op8_odd_sketch.odd_sketch(np.array([op8_odd_sketch.signature(a), op8_odd_sketch.signature(b)]))
            errors.append(op8_odd_sketch.estimate(sk[:1], sk[1:])[0] - j)
        assert abs(np.mean(errors)) < 0.04 and np.max(np.abs(errors)) < 0.2
    assert op8_odd_sketch.estimate(np.full((1, 64), 255, np.uint8), np.zeros((1, 64), np.uint8))[0] == -np.inf


def test_fingerprints_of_edits_and_neighbours(spark, monkeypatch):
    rows = near_rows(6)
    rows = [r for k, r in enumerate(rows) if r[0] not in {x[0] for x in rows[:k]}]
    order = sorted(rows, key=lambda r: -(1 << 63) if r[0] is None else r[0], reverse=True)
    want = {}
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        want[i] = (len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest(), t, t[: len(t) - half] + n[:half], n)

    def shingles(t):
        w = WORDS.findall(t)
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}

    for size in (4000, 7):
        monkeypatch.setattr(op2_fingerprint, "RANGE_ROWS", size)
        got = op2_fingerprint.digests(frame(spark, rows).repartition(4)).collect()
        assert len(got) == len(rows)
        for r in got:
            n, sha, t, e, nxt = want[r.doc_id]
            assert (r.n_chars, r.edited_sha256) == (n, sha)
            for estimate, other in ((r.near_edited, e), (r.near_next, nxt)):
                x, y = shingles(t), shingles(other)
                assert 0 <= estimate <= 1 and abs(estimate - len(x & y) / len(x | y)) < 0.2
                assert estimate == 1 or x != y
    by_text = {}
    for r in got:
        assert by_text.setdefault(want[r.doc_id][2], r.fingerprint) == r.fingerprint
    assert op2_fingerprint.digests(frame(spark, [])).count() == 0


def test_fingerprint_neighbours_verified(spark):
    rows = [(i, t) for i, t in near_rows(8) if i not in (None, 406, 407)]  # this operator does not fold case
    rows = [r for k, r in enumerate(rows) if r[0] not in {x[0] for x in rows[:k]}]
    got = op2_fingerprint.near(frame(spark, [(i, t.lower() if t else t) for i, t in rows])).collect()
    want = brute_components(rows, 5, 80)
    assert {r.doc: r.component for r in got} == {i: want[i] for i, t in rows if WORDS.findall(t or "")}


@pytest.mark.parametrize("n", [50, 20_000, 300_000])
def test_fingerprints_of_disjoint_texts_of_any_length_differ(n):
    texts = [" ".join(f"{side}{k}" for k in range(n)) for side in "ab"]
    rows = op2_fingerprint.signatures([op2_fingerprint._set(t) for t in texts])
    assert op2_fingerprint.likeness(rows[:1], rows[1:])[0] < 0.03
    shared = " ".join([texts[0], *texts[1].split()[: n // 2]])
    other = op2_fingerprint.signatures([op2_fingerprint._set(shared)])
    assert abs(op2_fingerprint.likeness(rows[:1], other)[0] - 2 / 3) < 0.2


def test_fine_sketches_of_sets_just_below_the_sample_size_rule_out_no_pair_at_the_limit():
    from lamella.llm.sketch import SMALL, allowed, fine_sketch

    rng, n, lost = np.random.default_rng(12), SMALL - 3, 0
    shared = -(-8 * n // 9)  # similarity just above 0.8
    for _ in range(3000):
        pool = rng.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64)
        one, other = (np.frombuffer(fine_sketch(s), np.uint8) for s in (pool[:n], np.concatenate([pool[:shared], pool[n:]])))
        lost += not allowed(one, other[None], n, np.array([n]), 0.8)[0]
    assert lost == 0
