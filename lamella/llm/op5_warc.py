"""WARC records in ZIP packages: a writer, and a reader that works by ranges and extracts nothing.

A package holds `archive/data.warc.gz` (records, each its own gzip member) and `indexes/index.cdx` (one line per record: key, place, length, member), both
stored, not compressed, so that a record is a byte range of the package. The reader finds the end record at the package's tail, goes on to
the ZIP64 end record where a field is full, parses the central directory with its ZIP64 fields, takes each member's place from its local
header, reads the index ranges and then each record's range, in blocks. It takes any number of archives and indexes: all members below
`archive/` and `indexes/`. A line without a member is one of the only archive; an archive that no index names is an error.

Payloads are equal if their SHA-1 are. Of equal ones with at least `least` bytes the smallest key is a response, the others revisit it. How often
a payload occurs is counted with partial aggregates and only payloads that occur twice return to the rows, by a join whose large
partitions may be split. Packages are written by tasks under names of their attempt; the stored manifest names the finished ones.

A null html is an empty payload, a null url an absent target. A row without a key is a response of its own (its key reads back null). Rows that
share key and payload are one response and revisits of that key. An empty table gives an empty result.
"""
from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import RangeFile, created, shared_folder, stored

WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
#: Bytes of records that one read fetches.
READ_BYTES = 1 << 20


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int


def directory(f) -> list[Member]:
    """Members of a ZIP file, read from its end; `f` has size and read(start, length)."""
    tail_at = max(0, f.size - 22 - FULL16)
    tail = f.read(tail_at, f.size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):  # a comment may hold the signature
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("not a ZIP file: no end record")
    count, size, start = struct.unpack_from("<HII", tail, at + 10)
    if count == FULL16 or size == FULL32 or start == FULL32:
        end64 = f.read(tail_at + at - 20, 20)
        if end64[:4] != b"PK\x06\x07":
            raise ValueError("ZIP64 locator is missing")
        record = f.read(struct.unpack_from("<Q", end64, 8)[0], 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("ZIP64 end record is missing")
        count, size, start = struct.unpack_from("<QQQ", record, 32)
    raw, at, out = f.read(start, size), 0, []
    for _ in range(count):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("central directory is damaged")
        flags, method = struct.unpack_from("<HH", raw, at + 8)
        packed, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", raw, at + 20)
        (header,) = struct.unpack_from("<I", raw, at + 42)
        name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        values = _zip64(raw[at + 46 + n_name : at + 46 + n_name + n_extra], [full, packed, header])
        out.append(Member(name, method, values[1], values[2]))
        at += 46 + n_name + n_extra + n_note
    return out


def _zip64(extra: bytes, values: list[int]) -> list[int]:
    """The values, full ones taken in order from the ZIP64 extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            return [next(wide) if v == FULL32 else v for v in values]
        at += 4 + n
    return values


def place(f, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed; its records cannot be read by range")
    head = f.read(member.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"{member.name}: local header is damaged")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member with a response record, or a revisit that keeps the payload's HTTP head and not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if key is None else key}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    block = http if refers_to is not None else http + payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    raw = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(raw.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + pack.flush()


@dataclass(frozen=True)
class Record:
    head: dict[str, str]
    http: dict[str, str]
    payload: bytes

    @property
    def key(self) -> int | None:
        return _key(self.head["warc-record-id"])


def _key(urn: str) -> int | None:
    tail = urn.strip("<>").rpartition(":")[2]
    return int(tail) if tail else None


def _fields(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def parse_record(member: bytes) -> Record:
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return Record(fields, _fields(http), payload)


class PackageWriter:
    """Writes one package; records go straight to the stream, the index is held (a line per record)."""

    def __init__(self, stream):
        self.stream, self.at, self.lines = stream, 0, []
        self.zip = zipfile.ZipFile(_Forward(stream), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(WARC), "w", force_zip64=True)

    def add(self, key: int | None, member: bytes) -> None:
        self.member.write(member)
        self.lines.append(f"{'' if key is None else key} {self.at} {len(member)} {WARC}\n")
        self.at += len(member)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(self.lines))
        self.zip.close()
        self.stream.close()


class _Forward(io.RawIOBase):
    """A stream that only goes forward, for zipfile, which then writes sizes after the data."""

    def __init__(self, stream):
        self.stream = stream

    def writable(self):
        return True

    def seekable(self):
        return False

    def write(self, data):
        self.stream.write(bytes(data))
        return len(data)


def records(f) -> Iterator[Record]:
    """All records of a package in index order; neighbouring ranges are fetched together."""
    members = [m for m in directory(f) if not m.name.endswith("/")]
    archives = {m.name: m for m in members if m.name.startswith("archive/")}
    starts, group, last = {}, [], None
    for index in (m for m in members if m.name.startswith("indexes/")):
        for line in f.read(place(f, index), index.size).decode().split("\n"):
            if not line:
                continue
            _, at, n, *named = line.split(" ", 3)
            at, n, name = int(at), int(n), named[0] if named else next(iter(archives), None)
            if name not in archives or not named and len(archives) > 1:
                raise ValueError(f"{index.name}: a line does not lead to an archive: {line}")
            if name not in starts:
                starts[name] = place(f, archives[name])
            if group and (name != last or at < sum(group[-1]) or at + n - group[0][0] > READ_BYTES):
                yield from _group(f, starts[last], group)
                group = []
            group.append((at, n))
            last = name
    if group:
        yield from _group(f, starts[last], group)
    for m in archives.values():
        if m.size and m.name not in starts:
            raise ValueError(f"{m.name}: no index names its records")


def _group(f, start: int, group: list[tuple[int, int]]) -> Iterator[Record]:
    first = group[0][0]
    data = f.read(start + first, group[-1][0] + group[-1][1] - first)
    for at, n in group:
        yield parse_record(data[at - first : at - first + n])


def planned(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html and refers_to: the smallest page with an equal payload of at least `least` bytes, null for that page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("_sha", F.sha1("html"))
    large = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).where((F.octet_length("html") >= least) & F.col("page_id").isNotNull())
    twice = large.groupBy(F.sha1("html").alias("_sha")).agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_sha", "_first")
    out = _numbered(rows).join(twice, "_sha", "left")
    other = (F.col("page_id") != F.col("_first")) | (F.col("_copy") > 1)
    return out.select("page_id", "url", "html", F.when(other, F.col("_first")).alias("refers_to"))


def _numbered(rows: DataFrame) -> DataFrame:
    """`_copy`: 1 for the first row of each key and payload (smallest url, nulls first), larger for the others. Only keys that several rows have are
    touched: equal rows become one with their number, are numbered through and come apart again, dealt by key and number."""
    again = stored(rows.where("page_id IS NOT NULL").groupBy("page_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("page_id"))
    if again.isEmpty():
        return rows.withColumn("_copy", F.lit(1).cast("long"))
    alike = rows.join(again, "page_id", "left_semi").groupBy("page_id", "url", "_sha").agg(F.first("html").alias("html"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("page_id", "_sha").orderBy(F.col("url").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    apart = alike.withColumn("_b", before).withColumn("_copy", F.explode(F.sequence(F.col("_b") + 1, F.col("_b") + F.col("_n")))).repartition("page_id", "_copy")
    return rows.join(again, "page_id", "left_anti").withColumn("_copy", F.lit(1).cast("long")).unionByName(apart.drop("_n", "_b"))


def write(pages: DataFrame, folder: str, least: int = 0, package_bytes: int = 1 << 26) -> DataFrame:
    """Write all pages below `folder`; returns the stored manifest: package, n_records."""
    def run(batches):
        task = TaskContext.get()
        base = f"{folder}/packages/{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        out, count, n = None, 0, 0
        for batch in batches:
            for key, url, html, first in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"], strict=True):
                if out is None:
                    out, n = PackageWriter(created(f"{base}-{count}.wacz")), 0
                payload, key = html.encode("utf-8", "surrogatepass"), None if pd.isna(key) else int(key)
                out.add(key, record_bytes(key, None if pd.isna(url) else url, payload, base32_sha1(payload), None if pd.isna(first) else int(first)))
                n += 1
                if out.at >= package_bytes:
                    out.close()
                    yield pd.DataFrame({"package": [f"{base}-{count}.wacz"], "n_records": [n]})
                    out, count = None, count + 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"package": [f"{base}-{count}.wacz"], "n_records": [n]})

    planned(pages, least).mapInPandas(run, "package string, n_records long").write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to of every record."""
    def run(batches):
        for batch in batches:
            for package in batch["package"]:
                with RangeFile(package) as f:
                    rows = []
                    for r in records(f):
                        kind, digest = r.head["warc-type"], r.head["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and base32_sha1(r.payload) != digest:
                            raise ValueError(f"{package}: a payload does not have its digest")
                        rows.append((r.key, r.head.get("warc-target-uri"), r.payload if kind == "response" else None, int(r.http["content-length"]), digest, kind, _key(r.head["warc-refers-to"]) if kind == "revisit" else None))
                        if len(rows) == 256:
                            yield _frame(rows)
                            rows = []
                    yield _frame(rows)

    parts = max(1, manifest.count())
    return manifest.select("package").repartition(parts).mapInPandas(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _frame(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def digests(pages: DataFrame) -> DataFrame:
    """The contract's row per page, read back from the packages."""
    spark = pages.sparkSession
    return read(spark, write(pages, shared_folder(spark, "warc"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


__all__ = ["Member", "PackageWriter", "Record", "digests", "directory", "parse_record", "place", "planned", "read", "records", "write"]

ORACLE = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(d.h, CAST(1 + (i * 5) // 4 AS INT), 2) || '0' AS BIGINT) >> CAST(12 - 5 - (i * 5) % 4 AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN f ON d.h = f.h
"""
