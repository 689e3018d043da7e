"""Conversation repair against a search over all edit strings, cheapest first."""

from __future__ import annotations

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pytest

from lanewright.llm import conversation_repair as R
from lanewright.llm.common import read_table
from lanewright.llm.queries import op11_conversation_repair

DIR = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        out[conv]
        said = [" " if x is None else str(x) for x in (conv, turn)]
        kind = zlib.crc32(":".join(said).encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for rows in out.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(SPACES)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """Cost, least edit string and turns by Dijkstra over (cost, letters), with the roles so far written out."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, letters, at, tail = heapq.heappop(heap)
        if (at, tail) in done:
            continue
        done.add((at, tail))
        if at == len(rows) and tail in ("", "a"):
            return cost, letters

        def go(extra, letter, to, role):
            if role is None or role == "s" and tail == "" or role == "u" and tail in ("", "s", "a") or role == "a" and tail == "u":
                heapq.heappush(heap, (cost + extra, letters + letter, to, tail if role is None else role))  # noqa: B023

        go(3, "I", at, "u"), go(3, "I", at, "a")
        if at < len(rows):
            go(4, "D", at + 1, None)
            if marks[at] not in ("blank", "duplicate"):
                extra = 3 if marks[at] else 0
                if rows[at][1][:1]:
                    go(extra, "K", at + 1, rows[at][1][0])
                go(3 + extra, "R", at + 1, "u"), go(3 + extra, "R", at + 1, "a")


def replay(rows, letters):
    turns, i = [], 0
    for letter in letters:
        role, text = ("", "") if letter == "I" else rows[i][1:]
        i += letter != "I"
        if letter in "IR":
            role = "assistant" if turns and turns[-1][0][0] == "u" else "user"
        if letter != "D":
            turns.append((role, text))
    assert i == len(rows)
    return turns


def brute(rows):
    out = []
    for conv, kept in damaged(rows).items():
        marks = faults(kept)
        turns = [t for t, *_ in kept if t is not None]
        cost, letters = cheapest(kept, marks)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        text = "\n".join(f"{r}:{t}" for r, t in replay(kept, letters))
        gaps = min(max(turns) - min(turns) + 1 - len(set(turns)), (1 << 63) - 1) if turns else 0
        out.append((conv, gaps, *(marks.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def got(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def odd_rows():
    rng = random.Random(3)
    words = ["Yes.", "no", "Why?", "", " \t", " x\x0b", "Fine! ", "ok", None, ".", "a\x1c", "é."]
    roles = ["user", "assistant", "system", "user", "assistant", "unknown", "User", "", None, "sys"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(9)):
            rows.append((conv, rng.choice([turn, turn, turn, rng.randrange(6), None]), rng.choice(roles), rng.choice(words)))
    rows += [(None, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(6)]
    rows += [(1 << 62, -(1 << 63), "user", "a."), (1 << 62, (1 << 63) - 1, "assistant", "b.")]
    rows += [(-7, 0, "user", "same.")] * 12
    rows += [(-8, t, rng.choice(["user", "assistant"]), rng.choice(words[:4])) for t in range(300)]
    rows += [(-9, 0, "user", "q" * 2_000_000), (-9, 1, "assistant", "z " * 500_000 + ".")]
    gone = next(c for c in range(1000, 9000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return rows + [(gone, 0, "user", "x")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = odd_rows()
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, segment string, at int")


@pytest.mark.parametrize("part_rows", [50_000, 40])
def test_odd_rows(odd, part_rows):
    rows, df = odd
    assert got(R.damage_and_repair(df, part_rows)) == brute(rows)


@pytest.mark.parametrize("part_rows", [50_000, 15])
def test_table(spark, part_rows):
    df = read_table(spark, DIR, "conversations")
    assert got(R.damage_and_repair(df, part_rows)) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_query_and_turns(spark):
    df = read_table(spark, DIR, "conversations")
    reports = {r.conv_id: r.repaired_sha256 for r in op11_conversation_repair(spark, DIR).collect()}
    _, turns = R.repair_conversations(R.damage(df), 30)
    texts = defaultdict(list)
    for r in sorted(turns.collect(), key=lambda r: (r.segment or 0, r.place)):
        texts[r.conv_id].append((r.role, r.text))
    assert {c: R.turns_hash(t) for c, t in texts.items()} == {c: h for c, h in reports.items() if c in texts}
    assert all(h == hashlib.sha256(b"").hexdigest() for c, h in reports.items() if c not in texts)


def test_text_ids_and_empty(spark):
    df = spark.createDataFrame([("b", 1, "assistant", "x."), ("b", 0, "user", "y."), ("a", 0, "user", "y.")], "conv_id string, turn int, role string, text string")
    assert sorted((r.conv_id, r.audit, r.cost) for r in R.repair_conversations(df)[0].collect()) == [("a", "KI", 3), ("b", "KK", 0)]
    assert R.damage_and_repair(df.limit(0)).count() == 0


def test_segments_give_what_the_whole_gives():
    rng = random.Random(11)
    for _ in range(60):
        rows = [(t, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", "c!", "", "d?"])) for t in range(rng.randrange(1, 40))]
        counts, letters, _ = R.repair_whole(rows)
        assert (counts["cost"], letters) == cheapest(rows, faults(rows))
