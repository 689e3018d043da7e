"""The filter audit against applying every order, one document at a time."""

from __future__ import annotations

import itertools
import random
import re
from collections import defaultdict

import pytest

from lanewright.llm import filter_audit as A
from lanewright.llm.common import read_table

DIR = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(220))
ROWS = [
    (1, LONG, "a", "x"),
    (2, LONG, "b", "x"),
    (2, LONG, "b", "x"),
    (None, LONG, "a", "x"),
    (0, LONG + " #", "a", "x"),
    (3, LONG + " #", None, "x"),
    (4, None, "a", "x"),
    (5, "", "", "x"),
    (6, "ABC " * 300, "a", "x"),
    (7, "ABC " * 300, "b", "x"),
    (8, "é" * 49 + "A", "b", "x"),
    (9, "word " * 150 + " ".join(f"v{i}" for i in range(150)), "b", "x"),
    (10, "a\x0bb\x1cc d e " * 90_000, "b", "x"),
    (1 << 62, LONG, "b", "x"),
    ((1 << 63) - 1, LONG, "b", "x"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, 1, 1), (9, 1, 0), (10, None, 1), (None, 1, 1), (77, 1, 1), (7, 1, 0)]


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    smallest = {}
    for i, t, *_ in docs:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    parts = defaultdict(list)
    for i, t, source, *_ in docs:
        text = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and i > smallest[text],
        }
        parts[source or ""].append(({k for k, v in fails.items() if v}, i in good, i in toxic))
    out, sums = [], defaultdict(int)
    for part, rows in parts.items():
        for order in itertools.permutations("ABCDE"):
            left, gone = rows, []
            for step, f in enumerate(order, 1):
                now = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                sums[part, f] += len(now)
                out.append((part, "".join(order), step, len(left), len(now), sum(f in r[0] for r in gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in now), sum(r[2] for r in now)))
                gone = gone + now
    return sorted((*r, sums[r[0], r[1][r[2] - 1]]) for r in out)


def frames(spark, docs=ROWS, labels=LABELS):
    return spark.createDataFrame(docs, "doc_id long, text string, source string, part string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_odd_rows(spark):
    got = A.audit_filters(*frames(spark)).collect()
    assert sorted(map(tuple, got)) == brute(ROWS, LABELS)


def test_table(spark):
    docs, labels = read_table(spark, DIR, "documents"), read_table(spark, DIR, "labels")
    want = brute([tuple(r) for r in docs.select("doc_id", "text", "source").collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert sorted(map(tuple, A.audit_filters(docs, labels).collect())) == want


def test_empty(spark):
    docs, labels = frames(spark)
    assert A.audit_filters(docs.limit(0), labels).count() == 0
    assert A.audit_filters(docs, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_missing_column(spark):
    docs, labels = frames(spark)
    with pytest.raises(ValueError, match="source"):
        A.audit_filters(docs.drop("source"), labels)


def test_polynomial():
    rng = random.Random(5)
    for _ in range(20):
        counts = [rng.randrange(9) for _ in range(A.FULL)]
        p = A.removal_polynomial(counts)
        for applied in range(A.FULL):
            assert A.at_corner(p, applied) == sum(c for m, c in enumerate(counts) if m & applied)
        for i in range(5):
            assert A.shapley(p, i) * 120 == sum(c * 120 // m.bit_count() for m, c in enumerate(counts) if m >> i & 1)


def test_words_are_not_cut_by_pieces(monkeypatch):
    text = "alpha beta\tgamma " * 500 + "x" * 300 + " alpha"
    want = A.text_mask(text)
    monkeypatch.setattr(A, "PIECE", 7)
    assert A.text_mask(text) == want
    assert [w for p in A._pieces(text.encode()) for w in p.split()] == text.encode().split()
