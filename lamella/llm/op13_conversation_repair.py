"""Repairing the turn structure of conversations: the cheapest edits, found by bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows consumed, state of the turn automaton); the automaton takes the role initials `(s?(ua)+)?`. Edits are its edges:
Keep (0), Rerole to user or assistant (2), Delete (3, the only one for blank and duplicate rows), Insert an empty user or assistant turn (2);
a truncated row that is not deleted adds 1. cheapest() runs one heap from the start and one from the ends, always the one
that stands lower. Once both stand together above the best meeting cost, every cheapest path has an edge from a node that is
settled forwards to one settled backwards; all these crossings are taken, from them the tight edges are followed to both ends,
and a walk over what they form, letter by letter, gives the least audit (D < I < K < R) of all cheapest ones. That an edit
string may belong to several paths is no matter: the walk holds all nodes that the string so far can reach.

audits() sees no texts: a row is its turn, role initial, faults and a 128-bit digest of role and text. Rows of a conversation come sorted
and are taken one by one; held are two bytes a row and the digests seen. Equal conversations of codes are solved once per task.
repaired() and digests() read the texts in the same order behind the audit of their conversation, and hold one batch. So
a conversation of very many rows costs one task time, as its hash does anyhow, and little memory.

A null conv_id is a conversation; null roles and texts are one space (the text is blank then, the role fits nowhere). Roles fit by
their first character, an empty role by none. Rows of one turn are taken by role, then digest; null turns first. Repeated rows
are duplicates. An empty table gives an empty result. Other columns are not read.
"""
from __future__ import annotations

import hashlib
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\u000b\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: State: role that an inserted or reroled turn takes there.
FREE = {START: "u", SYSTEM: "u", ASSISTANT: "u", USER: "a"}
GOALS = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}
NAMES = {"u": "user", "a": "assistant"}


def _row_edits(code: str, q: int):
    """(edit, cost, state) of a row in state q. Codes: D must go; s, u, a, x are role initials, upper-case where the row is truncated."""
    yield "D", 3, q
    if code != "D":
        more = int(code.isupper())
        if (q, code.lower()) in NEXT:
            yield "K", more, NEXT[q, code.lower()]
        yield "R", 2 + more, NEXT[q, FREE[q]]


def _onward(codes: str, node: tuple[int, int]):
    """(edit, cost, node) of the edges that leave a node."""
    i, q = node
    yield "I", 2, (i, NEXT[q, FREE[q]])
    if i < len(codes):
        for edit, cost, to in _row_edits(codes[i], q):
            yield edit, cost, (i + 1, to)


def _backward(codes: str, node: tuple[int, int]):
    """(edit, cost, node) of the edges that reach a node."""
    i, q = node
    for p in range(4):
        if NEXT[p, FREE[p]] == q:
            yield "I", 2, (i, p)
        if i:
            for edit, cost, to in _row_edits(codes[i - 1], p):
                if to == q:
                    yield edit, cost, (i - 1, p)


@lru_cache(maxsize=20_000)
def cheapest(codes: str) -> tuple[int, str]:
    """Least cost, and the least of the audits that have it."""
    n = len(codes)
    edges = (_onward, _backward)
    reached = ({(0, START): 0}, {(n, q): 0 for q in GOALS})
    heaps: tuple[list, list] = ([(0, (0, START))], [(0, (n, q)) for q in GOALS])
    settled: tuple[dict, dict] = ({}, {})
    best = min((d + reached[1][v] for v, d in reached[0].items() if v in reached[1]), default=float("inf"))
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = int(heaps[1][0][0] < heaps[0][0][0])
        d, node = heappop(heaps[side])
        if node in settled[side]:
            continue
        settled[side][node] = d
        for _, cost, to in edges[side](codes, node):
            if d + cost < reached[side].get(to, float("inf")):
                reached[side][to] = d + cost
                heappush(heaps[side], (d + cost, to))
                if to in reached[1 - side]:
                    best = min(best, d + cost + reached[1 - side][to])
    ahead, behind = settled
    behind.update({(n, q): 0 for q in GOALS})
    ahead[0, START] = 0
    tight: dict[tuple, set] = {}  # node: (edit, node) on a cheapest path
    back, on = [], []
    for u, d in ahead.items():
        for edit, cost, v in _onward(codes, u):
            if v in behind and d + cost + behind[v] == best:
                tight.setdefault(u, set()).add((edit, v))
                back.append(u)
                on.append(v)
    seen = set()
    while back:
        v = back.pop()
        if v in seen:
            continue
        seen.add(v)
        for edit, cost, u in _backward(codes, v):
            if u in ahead and ahead[u] + cost == ahead[v]:
                tight.setdefault(u, set()).add((edit, v))
                back.append(u)
    seen = set()
    while on:
        u = on.pop()
        if u in seen:
            continue
        seen.add(u)
        for edit, cost, v in _onward(codes, u):
            if v in behind and cost + behind[v] == behind[u]:
                tight.setdefault(u, set()).add((edit, v))
                on.append(v)
    audit, here = [], {(0, START)}
    while not any(i == n and q in GOALS for i, q in here):
        edit = min(e for u in here for e, _ in tight.get(u, ()))
        here = {v for u in here for e, v in tight.get(u, ()) if e == edit}
        audit.append(edit)
    return int(best), "".join(audit)


def prepared(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present (rows that are not present only name their conversation), initial, fault (b blank, t truncated), digest."""
    if "present" not in rows.columns:
        rows = rows.withColumn("present", F.lit(True))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], "present")
    end = F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    return rows.select(
        "*", F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x")).alias("initial"),
        F.when(end == "", "b").when(F.right(end, F.lit(1)).isin(".", "!", "?"), "-").otherwise("t").alias("fault"),
        F.substring(F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)), 1, 16).alias("digest"))


STATISTICS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_FIRST = object()


class _Conversation:
    """What is held of a conversation while its rows come."""

    def __init__(self):
        self.codes, self.seen = [], set()
        self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before = ""

    def take(self, turn, initial: str, fault: str, digest: bytes) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        if self.before:
            self.illegal += self.before + initial not in LEGAL
        self.before = initial
        again = digest in self.seen
        self.seen.add(digest)
        self.blank += fault == "b"
        self.duplicate += again and fault != "b"
        self.truncated += not again and fault == "t"
        self.codes.append("D" if again or fault == "b" else initial.upper() if fault == "t" else initial)

    def result(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        cost, audit = cheapest("".join(self.codes))
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _audited(batches):
    """Sorted rows (conv_id, turn, initial, fault, digest, present) -> a row for each conversation."""
    key, now, kind, names = _FIRST, None, None, ["conv_id", *STATISTICS, "audit"]

    def made(done):
        cols = list(zip(*[c for _, c in done], strict=True))
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], kind), *[pa.array(c, pa.int64()) for c in cols[:-1]], pa.array(cols[-1], pa.string())], names=names)

    for batch in batches:
        kind, done = batch.schema.field(0).type, []
        for conv, turn, initial, fault, digest, present in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key is _FIRST or conv != key:
                if key is not _FIRST:
                    done.append((key, now.result()))
                key, now = conv, _Conversation()
            if present:
                now.take(turn, initial, fault, digest)
        if done:
            yield made(done)
    if key is not _FIRST:
        yield made([(key, now.result())])


ORDER = ("conv_id", "turn", "role", "digest")


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation of `rows` (conv_id, turn, role, text and, if wanted, present)."""
    rows = prepared(rows)
    slim = rows.select(*ORDER, "initial", "fault", "present").repartition("conv_id").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ORDER])
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in STATISTICS)}, audit string"
    return slim.select("conv_id", "turn", "initial", "fault", "digest", "present").mapInArrow(_audited, schema)


class _Repair:
    """Turns of a conversation as its audit says, row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _free(self) -> str:
        role = FREE[self.state]
        self.state = NEXT[self.state, role]
        return NAMES[role]

    def inserted(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield None, "I", self._free(), ""

    def take(self, turn, role: str, text: str):
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = NEXT[self.state, role[0]]
            yield turn, edit, role, text
        elif edit == "R":
            yield turn, edit, self._free(), text


def _in_order(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The audit of each conversation (columns of `found` besides conv_id in `found`), then its rows."""
    rows = prepared(rows).where("present").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text", F.lit(None).cast("string").alias("audit"))
    heads = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("digest"), F.lit("").alias("text"), "audit")
    order = ("conv_id", "kind", *ORDER[1:])
    both = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    return both.select("conv_id", "audit", "turn", "role", "text")


def _turns(batches):
    """(conversation's key, None) at its start, then (key, repaired turn); (None, None) behind each batch."""
    key, repair = None, None
    for batch in batches:
        for conv, audit, turn, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if audit is not None:
                if repair is not None:
                    yield from ((key, t) for t in repair.inserted())
                key, repair = conv, _Repair(audit)
                yield key, None
            else:
                yield from ((key, t) for t in repair.take(turn, role, text))
        yield batch, None
    if repair is not None:
        yield from ((key, t) for t in repair.inserted())


def _repaired(batches, names):
    out, place, kind = [], 0, None

    def made():
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = [kind, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    for key, turn in _turns(batches):
        if isinstance(key, pa.RecordBatch):
            kind = key.schema.field(0).type
            yield made()
            out.clear()
        elif turn is None:
            place = 0
        else:
            out.append((key, place, *turn))
            place += 1
    if out:
        yield made()


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place, turn (null where inserted), edit, role, text of the repaired conversations. `found`: audits() of the same rows."""
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, place long, turn long, edit string, role string, text string"
    names = ["conv_id", "place", "turn", "edit", "role", "text"]
    return _in_order(rows, found).mapInArrow(lambda batches: _repaired(batches, names), schema)


def _hashed(batches):
    """SHA-256 of `role:text`, joined by newlines, of each repaired conversation, taken turn by turn."""
    done, key, sha, kind, lead = [], _FIRST, None, None, b""

    def made():
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], kind), pa.array([h for _, h in done], pa.string())], names=["conv_id", "repaired_sha256"])

    for conv, turn in _turns(batches):
        if isinstance(conv, pa.RecordBatch):
            kind = conv.schema.field(0).type
            if done:
                yield made()
                done.clear()
        elif turn is None:
            if key is not _FIRST:
                done.append((key, sha.hexdigest()))
            key, sha, lead = conv, hashlib.sha256(), b""
        else:
            sha.update(lead + f"{turn[2]}:{turn[3]}".encode("utf-8", "surrogatepass"))
            lead = b"\n"
    if key is not _FIRST:
        done.append((key, sha.hexdigest()))
        yield made()


def damaged(rows: DataFrame) -> DataFrame:
    """Planted faults by the checksum of `conv_id:turn`, modulo 20: 0 the row is not present, 1 its text is empty, 2 its text has no `[.!?]`,
    3 it comes twice, 4 its role is user. Nulls are one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), fault.alias("f"))
    role = F.when(F.col("f") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("f") == 1, "").when(F.col("f") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("f") != 0).alias("present"), F.when(F.col("f") == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of the damaged `conversations`."""
    from .storage import stored

    rows = damaged(conversations)
    found = stored(audits(rows))
    kind = rows.schema["conv_id"].dataType.simpleString()
    hashes = _in_order(rows, found).mapInArrow(_hashed, f"conv_id {kind}, repaired_sha256 string").withColumnRenamed("conv_id", "conv")
    return found.join(hashes, found["conv_id"].eqNullSafe(F.col("conv"))).drop("conv")
