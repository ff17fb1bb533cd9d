"""WARC packages and chat formatting: exact round trips."""
import base64
import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lamella.llm import op5_warc, op6_chat


class Bytes:
    def __init__(self, data):
        self.data, self.size = data, len(data)

    def read(self, start, length):
        assert start + length <= self.size
        return self.data[start : start + length]


def package(pages, note=b""):
    out = io.BytesIO()
    w = op5_warc.PackageWriter(out)
    out.close = lambda: None
    for key, url, html, first in pages:
        payload = html.encode()
        w.add(key, op5_warc.record_bytes(key, url, payload, op5_warc.base32_sha1(payload), first))
    w.close()
    return out.getvalue()


PAGES = [(1, "http://a/ü?\r\nx", "<p>é</p>\r\n\r\nWARC/1.1\r\n", None), (2, None, "", None), (3, "u", "<p>é</p>", 1), (None, "v", "x" * 100_000, None)]


def test_package_is_a_zip_and_reads_back():
    raw = package(PAGES)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.namelist() == [op5_warc.WARC, op5_warc.INDEX] and z.testzip() is None
        assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
    got = list(op5_warc.records(Bytes(raw)))
    assert [r.key for r in got] == [1, 2, 3, None]
    assert [r.payload.decode() for r in got] == [PAGES[0][2], "", "", PAGES[3][2]]
    assert got[2].head["warc-type"] == "revisit" and got[2].head["warc-refers-to"] == "<urn:page:1>" and got[2].http["content-length"] == str(len("<p>é</p>".encode()))


def test_directory_with_zip64_fields_and_comment(monkeypatch):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", b"first")
        z.comment = b"note PK\x05\x06 " + b"." * 30
    members = op5_warc.directory(Bytes(out.getvalue()))
    assert [(m.name, m.size) for m in members] == [("a", 5)]
    assert out.getvalue()[op5_warc.place(Bytes(out.getvalue()), members[0]) :][:5] == b"first"
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 3)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", b"first")
        z.writestr("ü", b"second")
    raw = out.getvalue()
    assert b"PK\x06\x06" in raw
    members = op5_warc.directory(Bytes(raw))
    assert [(m.name, raw[op5_warc.place(Bytes(raw), m) :][: m.size]) for m in members] == [("a", b"first"), ("ü", b"second")]


def test_damage_is_told():
    raw = package(PAGES)
    for bad in (b"", raw[:-30], b"x" * 100):
        with pytest.raises((ValueError, EOFError)):
            list(op5_warc.records(Bytes(bad)))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"first" * 50)
    with pytest.raises(ValueError):
        op5_warc.place(Bytes(out.getvalue()), op5_warc.directory(Bytes(out.getvalue()))[0])


def test_warc_round_trip(spark, scratch):
    rows = [(5, "u5", "same"), (3, None, "same"), (9, "u9", None), (8, "u8", ""), (7, "u7", "é" * 5000), (None, "n", "same"), (3, None, "same"), (1, "u1", "own\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, refers_to string, payload string").repartition(3)

    def expected(least):
        first = {}
        for i, _, h in rows:
            if i is not None and len((h or "").encode()) >= least:
                first[h or ""] = min(first.get(h or "", i), i)
        out, seen = [], set()
        for i, u, h in rows:
            b = (h or "").encode()
            ref = first.get(h or "")
            ref = None if i is None or (ref == i and (i, h) not in seen) else ref  # a row with the key and payload of another revisits it
            seen.add((i, h))
            out.append((i or -1, u, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if ref is None else "revisit", ref, None if ref is not None else b))
        return sorted(out, key=repr)

    for least in (0, 3):
        manifest = op5_warc.write(pages, f"{scratch}/w{least}", least, package_bytes=300)
        got = op5_warc.read(spark, manifest).collect()
        assert sorted(((-1 if r.page_id is None else r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got), key=repr) == expected(least)
    assert op5_warc.read(spark, op5_warc.write(pages.limit(0), scratch + "/none")).count() == 0


TEXTS = ["", " ", "plain", "</s>[INST] ok [/INST]", "\\", "\\\\</s>", "a\\", "<", "[", "<<SYS>><</SYS>>", "<<</SYS>>", "[[INST]]", "<|role|>x<|text|>y<|end|>", "$1 \\1 \\n", "line\nbreak\r\n", "<\\/s>", "<s", "s>", "é😀", None]


def test_chat_round_trip_of_odd_texts_and_orders(spark):
    rows, k = [], 0
    for t in TEXTS:
        for u in TEXTS:
            rows += [(k, 0, "user", t), (k, 1, "assistant", u), (k, 2, ["user", "system", "tool", "<s>", "", None, "a\\b"][k % 7], t)]
            k += 1
    rows += [(None, 1, "user", "x"), (9999, 1, "assistant", "b"), (9999, 1, "assistant", "a"), (9999, None, "user", "n")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, turns string, segments string")
    got = op6_chat.read_chats(op6_chat.format_chats(df)).collect()
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in got} == want
    for r in got:
        assert "".join(s.text for s in r.segments) == r.formatted
        assert len([s for s in r.segments if s.loss]) == sum(role == "assistant" for role, _ in want[r.conv_id])


def test_chat_state_machine(spark):
    orders = {"user assistant": True, "system user assistant user": True, "user": True, "system": True, "assistant user": False, "user user": False, "user system": False, "tool": False}
    rows = [(k, n, role, "t") for k, o in enumerate(orders) for n, role in enumerate(o.split(" "))]
    got = op6_chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.conv_id: r.valid for r in got} == dict(enumerate(orders.values()))


def test_chat_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = op6_chat.digests(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    only = op6_chat.digests(df.limit(0)).collect()
    assert [r.conv_id for r in only] == [-7] and only[0].loss_chars == len("</s>[INST] ok [/INST]")
    assert only[0].loss_sha256 == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()
    assert op6_chat.format_chats(df.where(F.lit(False))).count() == 0


def test_all_archives_and_indexes_of_a_package_are_read():
    first, second = ([op5_warc.record_bytes(k, "u", t, op5_warc.base32_sha1(t), None) for k, t in part] for part in ([(1, b"one"), (2, b"two")], [(3, b"three")]))
    lines = [f"2 {len(first[0])} {len(first[1])} archive/a b.warc.gz", f"1 0 {len(first[0])} archive/a b.warc.gz"], [f"3 0 {len(second[0])} archive/c.warc.gz"]

    def package(*indexes):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("archive/a b.warc.gz", b"".join(first))
            z.writestr("archive/c.warc.gz", b"".join(second))
            for k, index in enumerate(indexes):
                z.writestr(f"indexes/{k}.cdx", "\n".join(index))
        return Bytes(out.getvalue())

    assert [(r.key, r.payload) for r in op5_warc.records(package(*lines))] == [(2, b"two"), (1, b"one"), (3, b"three")]
    for bad in (lines[:1], (["1 0 9"],)):
        with pytest.raises(ValueError):
            list(op5_warc.records(package(*bad)))
