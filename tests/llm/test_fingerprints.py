from __future__ import annotations

import math
import random
from collections import Counter
from hashlib import sha256
from itertools import combinations

import pytest
import xxhash

from lanewright.llm import fingerprints as fp
from lanewright.llm.common import read_table


def plain_simhash(text):
    """The fingerprint's definition in plain integers, term by term."""
    full = (1 << 64) - 1

    def scramble(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & full
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & full
        return x ^ (x >> 31)

    gold = 0x9E3779B97F4A7C15
    w = [xxhash.xxh3_64_intdigest(x) for x in text.encode().lower().split()]
    width = min(3, len(w))
    terms = []
    for i in range(len(w) - width + 1 if w else 0):
        h = w[i]
        for k in range(1, width):
            h = scramble((h * gold + w[i + k]) & full)
        terms.append(scramble((h + width) & full))
    votes = [0] * 128
    for term, n in Counter(terms).items():
        raw = term.to_bytes(8, "little") + scramble((term + gold) & full).to_bytes(8, "little")
        for i in range(128):
            votes[i] += round(64 * (1 + math.log(n))) * (1 if raw[i // 8] >> (7 - i % 8) & 1 else -1)
    return bytes(sum((votes[8 * b + i] > 0) << (7 - i) for i in range(8)) for b in range(16))


def classes(prints, radius):
    """Each fingerprint's smallest one in steps of at most radius bits."""
    prints = sorted(set(prints))
    of = {p: p for p in prints}
    for _ in prints:
        before = dict(of)
        for a in prints:
            for b in prints:
                if (int(a, 16) ^ int(b, 16)).bit_count() <= radius:
                    of[a] = min(of[a], of[b])
        if of == before:
            return of
    return of


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0], r[1] or ""), reverse=True)
    out = []
    for i, (d, t) in enumerate(rows):
        t, n = t or "", rows[(i + 1) % len(rows)][1] or ""
        e = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        a, b, c = plain_simhash(t), plain_simhash(e), plain_simhash(n)
        out.append((d, len(t), sha256(e.encode()).hexdigest(), a.hex(), b.hex(), fp.likeness(a, b), fp.likeness(a, c)))
    of = classes([r[3] for r in out], fp.RADIUS)
    return sorted((*r, of[r[3]]) for r in out)


ROWS = [(5, "one two three four five six"), (3, None), (9, "é" * 10), (7, ""), (1, "x " * 9000), (2, "one two three four five six"), (2, "again")]


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], ROWS[:2], []])
def test_edges(spark, rows):
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, part string")
    assert sorted(map(tuple, fp.fingerprint_documents(docs).collect())) == (expected(rows) if rows else [])


def test_table(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    got = sorted(map(tuple, fp.fingerprint_documents(docs).collect()))
    assert got == expected([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r[5] for r in got) / len(got) > 0.65


@pytest.mark.parametrize(("radius", "hot"), [(3, 256), (3, 8), (2, 4)])
def test_hamming_search_finds_all(spark, radius, hot):
    rng = random.Random(2)
    base = [rng.getrandbits(128) for _ in range(60)]
    vectors = list({*base, *(b ^ sum(1 << i for i in rng.sample(range(128), rng.randint(0, 12))) for b in base for _ in range(4)), *(base[0] ^ sum(1 << i for i in rng.sample(range(128), 2)) for _ in range(60))})
    prints = spark.createDataFrame([(i, f"{v:032x}") for i, v in enumerate(vectors)], "doc_id long, fingerprint string")
    got = {(r.a, r.b, r.distance) for r in fp.near_fingerprints(prints, radius=radius, hot=hot).collect()}
    want = {(*sorted((f"{a:032x}", f"{b:032x}")), d) for i, a in enumerate(vectors) for b in vectors[:i] if (d := (a ^ b).bit_count()) <= radius}
    assert got == want and (want or not radius)


@pytest.mark.parametrize(("n", "hot"), [(700, 256), (700, 20), (6000, 256)])
def test_crowds_on_one_head(spark, n, hot):
    """Random tails of 32 bits on one head of 96: pairs within the radius, without comparing all."""
    rng = random.Random(n)
    tails = list({rng.getrandbits(32) for _ in range(n)} | {5, 6, 7, 1 << 31})
    head = rng.getrandbits(96) << 32
    prints = spark.createDataFrame([(i, f"{head | t:032x}") for i, t in enumerate(tails)], "doc_id long, fingerprint string")
    found = fp.near_fingerprints(prints, hot=hot)
    got = {(int(r.a, 16) ^ head, int(r.b, 16) ^ head, r.distance) for r in found.collect()}
    near = [sum(1 << i for i in c) for k in (1, 2, 3) for c in combinations(range(32), k)]
    known = set(tails)
    assert got == {(t, t ^ x, x.bit_count()) for t in tails for x in near if t ^ x in known and t < t ^ x}


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c"), (4, "d e f g"), (None, None)], "doc_id long, text string")
    got = fp.fingerprint_documents(docs).collect()
    assert sorted((r.doc_id or -1, r.n_chars) for r in got) == [(-1, 0), (-1, 5), (4, 7)]
