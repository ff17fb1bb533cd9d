"""Tokenizing operators against the tokenizers library: automaton, packing, token store."""
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lamella.llm import op4_packing, op9_bpe_automaton, op10_token_store
from lamella.llm.op9_bpe_automaton import _automaton as automaton
from lamella.llm.tokens import _encoder as encoder

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["", " ", "   a  b   ", "a\n\n  b \n c", "<|endoftext|> x<|endoftext|>y", "aaaaaaaaaaaa  \t\t x", "日本語 テスト 😀😀", "don't it's I'll 123 4567.89  x \x1c y", "\x00\x01 é",
       "http://a.b/c?d=e&f --- ===== //////////////", "a" * 3000, " " * 300 + "b", "İstanbul ÀÉ SS ß ŉ ﬁ", "x" * 100 + "! " + "y" * 70, "word, word. word! word", " x   y"]
alphabet = st.sampled_from(list("aAbeé ß'.,!1 \n\t_") + [" ", " the", "ing", "<|endoftext|>", "́", "日"])


@pytest.fixture(scope="module")
def byte_lib():
    return Tokenizer.from_file(BYTE)


@given(st.lists(alphabet, max_size=40).map("".join))
@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
def test_automaton_and_encoders_equal_the_library(text):
    lib = Tokenizer.from_file(BYTE) if not hasattr(test_automaton_and_encoders_equal_the_library, "lib") else test_automaton_and_encoders_equal_the_library.lib
    test_automaton_and_encoders_equal_the_library.lib = lib
    want = lib.encode(text, add_special_tokens=False).ids
    auto = automaton(BYTE)
    got = np.frombuffer(auto.encode(text), "<i4").tolist()
    assert got == want
    assert auto.decode(got) == lib.decode(want, skip_special_tokens=False)
    assert np.frombuffer(encoder(BYTE, "byte").encode([text])[0], "<u4").tolist() == want
    word = encoder(WORD, "word")
    assert np.frombuffer(word.encode([text])[0], "<u4").tolist() == word.tokenizer.encode(text, add_special_tokens=False).ids


def test_odd_texts(byte_lib):
    auto, word = automaton(BYTE), encoder(WORD, "word")
    for text in ODD:
        want = byte_lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(auto.encode(text), "<i4").tolist() == want, text
        assert auto.decode(want) == text
        assert np.frombuffer(word.encode([text])[0], "<u4").tolist() == word.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_every_vocabulary_word_walks_to_the_library_ids(byte_lib):
    auto = automaton(BYTE)
    for t in range(0, 50256, 7):
        text = byte_lib.decode([t])
        if "�" not in text:
            assert np.frombuffer(auto.encode(text), "<i4").tolist() == byte_lib.encode(text, add_special_tokens=False).ids


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, ids string")


def test_encode_decode_frames(spark, byte_lib):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50, None), (None, "a b"), (7, "again"), (7, "again")]
    enc = op9_bpe_automaton.encode(docs_of(spark, rows), BYTE)
    dec = op9_bpe_automaton.decode(enc, BYTE, keep=("doc_id", "ids"))
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.decoded, list(r.ids)) for r in dec.collect()))
    want = sorted(((i is None, i or 0, t or "", byte_lib.encode(t or "", add_special_tokens=False).ids) for i, t in rows))
    assert got == want
    assert op9_bpe_automaton.encode(docs_of(spark, []), BYTE).count() == 0


def test_differencing_covers_all_and_levels():
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (3, 5), (40, 4), (200, 16)):
        sizes = rng.integers(1, 100, n).tolist()
        split = op4_packing.differencing(sizes, m)
        assert sorted(k for w in split for k in w) == list(range(n)) and len(split) <= m
        if n >= 10 * m:
            loads = [sum(sizes[k] for k in w) for w in split]
            assert max(loads) - min(loads) <= 12
    assert op4_packing.differencing([], 3) == []
    split = op4_packing.fit([600] * 5, 1000)  # total fits three windows, the pieces do not: the count rises
    assert len(split) == 5


def test_packing_is_exact_and_tight(spark, byte_lib):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma,", "x1"], int(n)))) for i, n in enumerate(rng.integers(0, 900, 300))] + [(900, None), (901, ""), (902, "long " * 9000)]
    got = op4_packing.digests(docs_of(spark, rows).coalesce(1), BYTE).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    total = 0
    for i, t in rows:
        ids, at = byte_lib.encode(t or "", add_special_tokens=False).ids + [0], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
        total += at
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert 1024 * len(by_seq) <= total * 1.01 + 2048
    assert op4_packing.digests(docs_of(spark, []), BYTE).count() == 0
    with pytest.raises(ValueError):
        op4_packing.pack(docs_of(spark, []), BYTE, grain=2000)


def test_perfect_hash_is_minimal_and_tells_strangers():
    rng = np.random.default_rng(2)
    for n in (1, 2, 63, 1000, 20_000):
        keys = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        mph = op10_token_store.PerfectHash.build(keys)
        assert sorted(mph.numbers(keys).tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError):
        op10_token_store.PerfectHash.build(np.array([5, 5], np.uint64))


def test_token_store_round_trip(spark, scratch):
    word = Tokenizer.from_file(WORD)
    rows = [(i * 3 - 30, t) for i, t in enumerate(ODD)] + [(1000, None), (None, "no key"), (None, None), (None, "no key"), (5, "b twice"), (5, "a twice")]
    docs = docs_of(spark, rows).repartition(3)
    manifest = op10_token_store.write(docs, WORD, 2, scratch + "/store", shard_bytes=64)
    read = [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in op10_token_store.walk(spark, manifest).collect()]
    got = sorted(r for r in read if r[0] is not None)
    want, at = [], 0
    for i, t in sorted([(i, t or "") for i, t in rows if i is not None]):
        ids = word.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want
    loose = sorted(r[1:] for r in read if r[0] is None)  # behind all others, without gaps
    assert loose[0][0] == at and all(a[0] + a[1] == b[0] for a, b in zip(loose, loose[1:]))
    assert sorted(r[2] for r in loose) == sorted(np.array(word.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes() for t in ("no key", "no key", ""))
    assert manifest.count() > 3
    asked = spark.createDataFrame([(1000,), (-30,), (5,), (777,), (-999,)], "doc_id long")
    found = {r.doc_id: r.ids for r in op10_token_store.lookup(asked, manifest).collect()}
    assert found == {1000: [2], -30: [2], 5: word.encode("a twice").ids[1:-1] + [2] if word.encode("a").ids[0] == 49406 else word.encode("a twice", add_special_tokens=False).ids + [2], 777: None, -999: None}
    empty = op10_token_store.write(docs_of(spark, []), WORD, 2, scratch + "/none")
    assert op10_token_store.walk(spark, empty).count() == 0
    assert op10_token_store.lookup(asked, empty).where("ids IS NOT NULL").count() == 0


def test_a_run_of_thousands_of_special_tokens_is_cut():
    auto = automaton(BYTE)
    (number, content), = [(i, c.decode()) for i, c in auto.added.items() if c == b"<|endoftext|>"]
    text = "a" + content * 5000 + "b" + content
    ids = np.frombuffer(auto.encode(text), np.int32).tolist()
    assert ids.count(number) == 5001 and len(ids) == 5003 and auto.decode(ids) == text


def test_rows_are_placed_by_the_number_that_the_hash_gives():
    class Known:
        keys = np.array([4, 4, 9], np.int64)

        def find(self, keys):
            return np.array([{4: 0, 9: 2}[int(k)] for k in keys])

    class Wrong(Known):
        def find(self, keys):
            return np.array([{4: 1, 9: 0}[int(k)] for k in keys])

    assert op10_token_store.numbered(Known(), "x").tolist() == [0, 1, 2]
    with pytest.raises(ValueError):
        op10_token_store.numbered(Wrong(), "x")
