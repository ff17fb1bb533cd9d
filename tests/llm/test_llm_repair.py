"""Conversation repair against brute force."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from heapq import heappop, heappush
from itertools import product

import pytest

from lamella.llm import op13_conversation_repair as op

RIGHT = re.compile(r"(s?(ua)+)?")
WHITE = " \t\n\v\f\r"


def every_way(codes):
    """Cheapest edits by trying all of them, cheapest and least first; the result is checked by the pattern alone."""
    heap = [(0, "", 0, "")]
    while heap:
        cost, audit, i, initials = heappop(heap)
        if i == len(codes) and RIGHT.fullmatch(initials):
            return cost, audit
        if not RIGHT.fullmatch(initials + "a") and not RIGHT.fullmatch(initials + "ua") and not RIGHT.fullmatch(initials):
            continue
        for r in "ua":
            heappush(heap, (cost + 2, audit + "I", i, initials + r))
        if i < len(codes):
            heappush(heap, (cost + 3, audit + "D", i + 1, initials))
            if codes[i] != "D":
                late = int(codes[i].isupper())
                heappush(heap, (cost + late, audit + "K", i + 1, initials + codes[i].lower()))
                for r in "ua":
                    heappush(heap, (cost + 2 + late, audit + "R", i + 1, initials + r))


def by_suffixes(codes):
    """Cheapest and least edits from the end backwards: the least string from a state is an edit and the least string from the next one."""
    nexts = {("0", "s"): "S", ("0", "u"): "U", ("S", "u"): "U", ("A", "u"): "U", ("U", "a"): "A"}
    end = {"0": (0, ""), "A": (0, ""), "U": (2, "I"), "S": (4, "II")}
    for code in reversed(codes):
        now = {}
        for q in "0SUA":
            ways = [(3 + end[q][0], "D" + end[q][1])]
            if code != "D":
                late = int(code.isupper())
                if (q, code.lower()) in nexts:
                    c, a = end[nexts[q, code.lower()]]
                    ways.append((c + late, "K" + a))
                ways += [(end[to][0] + 2 + late, "R" + end[to][1]) for (p, r), to in nexts.items() if p == q and r in "ua"]
            now[q] = min(ways)
        for _ in range(4):
            for q in "0SUA":
                for (p, r), to in nexts.items():
                    if p == q and r in "ua":
                        now[q] = min(now[q], (now[to][0] + 2, "I" + now[to][1]))
        end = now
    return end["0"]


def test_cheapest_equals_every_way():
    for n in range(4):
        for codes in product("DsuaxUAX", repeat=n):
            assert op.cheapest("".join(codes)) == every_way(codes) == by_suffixes(codes), codes


def test_cheapest_of_longer_conversations():
    rng = random.Random(1)
    for _ in range(600):
        codes = "".join(rng.choice(rng.choice(["ua", "DsuaxSUAX", "D", "aA", "uU"])) for _ in range(rng.randint(4, 60)))
        assert op.cheapest(codes) == by_suffixes(codes), codes
    long = "uaua" * 3000 + "u" + "Daxu" * 500
    assert op.cheapest(long) == by_suffixes(long)


def spaced(v):
    return " " if v is None else str(v)


def brute(rows, damage=True):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv]
        role, text = spaced(role), spaced(text)
        h = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20 if damage else 19
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        role = "user" if h == 4 else role
        convs[conv] += [(turn, role, text)] * (2 if h == 3 else 1)
    out = {}
    for conv, turns in convs.items():
        digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()[:16]
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], digest(t[1], t[2])))
        known, seen, codes, faults = [t for t, _, _ in turns if t is not None], set(), [], Counter()
        for _, role, text in turns:
            bare = text.strip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes.append("D" if fault in ("blank", "duplicate") else initial.upper() if fault else initial)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit = by_suffixes(codes)
        lines, i, last = [], 0, ""
        for edit in audit:
            free = "assistant" if last == "u" else "user"
            if edit == "I":
                lines.append(f"{free}:")
                last = free[0]
                continue
            _, role, text = turns[i]
            i += 1
            if edit != "D":
                lines.append(f"{free if edit == 'R' else role}:{text}")
                last = lines[-1][0]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = [*op.STATISTICS, "audit", "repaired_sha256"]


@pytest.mark.parametrize("seed", [1, 2])
def test_digests_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = ["Well.", "Well.", "no end", "", " \n", None, "é!", "Really? ", "a.b", "long " * 5000 + "."]
    rows = []
    for conv in [None, *range(150)]:
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, None if rng.random() < 0.1 else turn + rng.choice([0, 0, 0, 5]), rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "User"]), rng.choice(texts) if rng.random() < 0.5 else f"say {rng.random()}."))
    rows += rows[:7] + [(999, t, "user" if t % 2 == 0 else "assistant", f"t {t}.") for t in range(6000)]
    df = spark.createDataFrame([(*r, "x", True) for r in rows], "conv_id long, turn long, role string, text string, audit string, digest boolean").repartition(4)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in op.digests(df.drop("x")).collect()}
    assert got == brute(rows)


def test_repaired_turns_are_right_and_keep_texts(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "A?"), (1, 2, "user", "A?"), (1, 3, "user", "B?"), (2, 0, "system", "S."), (3, 4, "user", "x."), (3, 5, "assistant", "y.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = op.audits(df)
    assert {r.conv_id: (r.cost, r.audit) for r in found.collect()} == {c: op.cheapest(s) for c, s in {1: "auDu", 2: "s", 3: "ua"}.items()}
    turns = defaultdict(list)
    for r in sorted(op.repaired(df, found).collect(), key=lambda r: (r.conv_id, r.place)):
        turns[r.conv_id].append((r.turn, r.edit, r.role, r.text))
    assert turns[3] == [(4, "K", "user", "x."), (5, "K", "assistant", "y.")]
    for conv in turns.values():
        assert RIGHT.fullmatch("".join(t[2][0] for t in conv))


def test_conversation_without_rows_left_and_empty_table(spark):
    gone = next(i for i in range(1000) if all(zlib.crc32(f"{i}:{t}".encode()) % 20 == 0 for t in range(1)))
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r[c] for c in COLUMNS) for r in op.digests(df).collect()] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert op.digests(df.where("conv_id < 0")).collect() == []
    assert op.digests(df).columns == ["conv_id", *COLUMNS]


def test_query_equals_brute_force_on_a_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in op.digests(table).collect()} == brute(rows)
