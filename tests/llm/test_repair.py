"""Conversation repair against plain enumeration of all edits of short conversations, and a plain search over long ones."""

import hashlib
import heapq
import random
import re
import time
import zlib
from collections import defaultdict

import pytest

pytest.importorskip("ledgerloom.llm")

from ledgerloom.llm import queries, repair  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string, copies int, fault int, same string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def search(rows, faults):
    """All ways of editing, cheapest and then first in ASCII first: no bound, no table, but that a rest seen at no more cost isn't entered again."""
    rank = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, seen = [(0, "", 0, "", "")], set()
    while heap:
        cost, audit, i, last, text = heapq.heappop(heap)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, text
        turn = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
        name, more = {"u": "user", "a": "assistant"}[turn], "\n" if text else ""
        heapq.heappush(heap, (cost + 2, audit + "I", i, turn, f"{text}{more}{name}:"))
        if i < len(rows):
            role, body = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, text))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, turn, f"{text}{more}{name}:{body}"))
                if role[:1] and role[:1] in rank[last]:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[:1], f"{text}{more}{role}:{body}"))


def enumerate_all(rows, faults):
    """Every sequence of edits of up to three costs a row and two, taken by its form alone."""
    best = None

    def walk(i, cost, audit, initials):
        nonlocal best
        if cost > 3 * len(rows):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            best = (cost, audit) if best is None else min(best, (cost, audit))
        for x in "ua":
            walk(i, cost + 2, audit + "I", initials + x)
        if i < len(rows):
            walk(i + 1, cost + 3, audit + "D", initials)
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                for x in "ua":
                    walk(i + 1, cost + 2 + extra, audit + "R", initials + x)
                walk(i + 1, cost + extra, audit + "K", initials + rows[i][0][:1])

    walk(0, 0, "", "")
    return best


def brute(rows):
    by_conv, out = defaultdict(list), {}
    for conv, turn, role, text in damaged(rows):
        by_conv[conv].append((turn is not None, turn or 0, role, text))
    for conv in {r[0] for r in rows}:
        own = sorted(by_conv[conv], key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        seen, faults = set(), []
        for _, _, role, text in own:
            visible = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for there, t, _, _ in own if there}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, text = search([r[2:] for r in own], faults)
        out[conv] = (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, 9, 9, "x") for r in rows], SCHEMA).repartition(3)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.damaged_and_repaired(df).collect()}
    assert got == brute(rows)


def conversation(r, conv, n):
    texts = ["Yes.", "No", "", " \t\n", "Why?", "Well!  ", "one. two", None, "é。", "stop.\x0b", "A\nB."]
    roles = ["user"] * 6 + ["assistant"] * 6 + ["system", "system", "tool", "", None, "ueber", "User"]
    turns = sorted(r.choice([None, *range(2 * n)]) or 0 if r.random() < 0.3 else k for k in range(n))
    return [(conv, None if r.random() < 0.05 else t, r.choice(roles), r.choice(texts)) for t in turns]


def test_repair_equals_brute_force(spark):
    r = random.Random(1)
    rows = [x for conv in range(250) for x in conversation(r, conv, r.randint(1, 9))]
    rows += [(None, 1, "user", "Hello."), (None, None, None, None), (None, 2, "assistant", "Bye.")]
    rows += [(900, 1, "user", "twice."), (900, 1, "user", "twice."), (900, 1, "assistant", "twice."), (900, None, "system", "nulls first.")]
    rows += [(2**53 + 1, k, "user", "x" * 5000 + ".") for k in range(3)]
    check(spark, rows)


def test_repair_of_long_conversations(spark, monkeypatch):
    """Parts of a conversation are searched one after another: the same as all at once."""
    r = random.Random(2)
    rows = [x for conv in range(3) for x in conversation(r, conv, 900)] + [(50, k, "user", "again.") for k in range(1000)] + [(51, k, "ua"[k % 2] + "x", f"{k}.") for k in range(1000)]
    check(spark, rows)


def test_search_equals_enumeration():
    r = random.Random(3)
    for _ in range(300):
        n = r.randint(0, 4)
        rows = [(r.choice(["user", "assistant", "system", "tool"]), "x") for _ in range(n)]
        faults = [r.choice(["", "", "", "blank", "duplicate", "truncated"]) for _ in range(n)]
        want = enumerate_all(rows, faults)
        assert search(rows, faults)[:2] == want
        found = repair.cheapest([(role[:1], f in ("blank", "duplicate"), f == "truncated") for role, f in zip(rows and [x[0] for x in rows], faults)], {repair.NOTHING: (0, "")}, repair.ENDS)
        assert list(found.values()) == [want]


def test_search_is_quick():
    r = random.Random(4)
    rows = [(r.choice("uuaas"), r.random() < 0.2, r.random() < 0.2) for _ in range(repair.PART)]
    start = time.time()
    repair.cheapest(rows, {repair.NOTHING: (0, "")}, repair.ENDS)
    repair.cheapest(rows, {repair.NOTHING: (0, "")}, None)
    assert time.time() - start < 2


def test_repair_empty(spark):
    assert repair.damaged_and_repaired(spark.createDataFrame([], SCHEMA)).collect() == []
    assert repair.repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_on_the_given_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r["conv_id"]: tuple(r)[1:] for r in queries.op12_repair(spark, data).collect()} == brute(rows)
