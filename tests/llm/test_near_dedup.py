from __future__ import annotations

import random
import re

import numpy as np
import pytest

from lanewright.llm import near_dedup as nd
from lanewright.llm.common import read_table

UPPER = {c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, percent=85):
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(UPPER.get(c, c) for c in t or ""))
        sets.append((d, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_cases(spark):
    rows = [(0, "A b c d e f g"), (1, "a B c d e f g"), (2, None), (3, ""), (4, " \n "), (5, "two words"), (6, "TWO  words"), (7, "é b c d e f g"), (8, "É b c d e f g"), (9, "z " * 5000), (10, "z " * 70)]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, key string, set int")
    assert rows_of(nd.near_components(docs)) == brute(rows)
    assert nd.near_components(docs.limit(0)).count() == 0
    assert nd.keep_one(docs).columns == docs.columns


def test_table_and_the_join_of_many_ids(spark, monkeypatch):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert rows_of(nd.near_components(docs)) == want
    monkeypatch.setattr(nd, "BROADCAST_IDS", 0)
    monkeypatch.setattr(nd, "BROADCAST_SETS", -1)
    assert rows_of(nd.near_components(docs)) == want


def test_group_around_one_original(spark):
    """300 copies near the original, mostly not near each other, and a chain."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(1000, " ".join(base))]
    for i in range(300):
        w = list(base)
        for at in rng.sample(range(0, 300, 10), 4):
            w[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(2000 + i, " ".join(f"c{j}" for j in range(i * 6, i * 6 + 100))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, want = rows_of(nd.near_components(docs)), brute(rows)
    assert got == want
    assert {r[2] for r in got if r[0] <= 1000} == {0}


def test_estimate_is_close():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    y = np.concatenate([x[:1838], rng.integers(0, 1 << 63, 162).astype(np.uint64)])
    est = [(nd.signature(x ^ k) == nd.signature(y ^ k)).mean() for k in rng.integers(0, 1 << 63, 40).astype(np.uint64)]
    assert abs(np.mean(est) - 0.85) < 0.02 and min(est) > 0.85 - nd.SLACK


def test_pieces_of_a_huge_region_stay_linked():
    path = np.zeros((500, nd.PATH), np.uint32)
    sig = np.zeros((500, nd.HASHES), np.uint8)
    i, j = nd.region_pairs(path, sig)
    assert {(a, a + 1) for a in range(499)} <= set(zip(i.tolist(), j.tolist(), strict=True))


@pytest.mark.parametrize("n", [0, 1, 2])
def test_small_regions(n):
    i, _ = nd.region_pairs(np.zeros((n, nd.PATH), np.uint32), np.zeros((n, nd.HASHES), np.uint8))
    assert len(i) == (n == 2)


def family(n, pairs, seed=9):
    """n texts of one template, mutually at about 0.77, and copies of some at 0.87 to 0.90."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        w = list(base)
        for at in rng.sample(range(10, 300, 10), 4):
            w[at] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    for k in range(pairs):
        w = rows[k * (n // pairs)][1].split()
        for at in (95, 195, 245, 285)[: 3 + k % 2]:
            w[at] = f"y{rng.randrange(10**9)}"
        rows.append((n + k, " ".join(w)))
    return rows


def all_links(sets, percent=85):
    """Links (numbers a < b) by brute force: frequent shingles by one matrix, the others by their lists."""
    places = {}
    for i, s in enumerate(sets):
        for x in s.tolist():
            places.setdefault(x, []).append(i)
    often = [p for p in places.values() if len(p) >= 50]
    matrix = np.zeros((len(sets), len(often)), np.float32)
    for k, p in enumerate(often):
        matrix[p, k] = 1
    both = (matrix @ matrix.T).astype(np.int64)
    for p in places.values():
        if 1 < len(p) < 50:
            both[np.ix_(p, p)] += 1
    n = np.array([len(s) for s in sets])
    a, b = np.nonzero(100 * both >= percent * (n[:, None] + n - both))
    return [(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if x < y]


def test_exact_pairs_of_groups(spark):
    rows = family(150, 10) + [(1000, "a b c"), (1001, "a b c"), (1001, "d"), (1002, None)]
    sets = [(d, nd.shingle_set(t)) for d, t in rows]
    table = spark.createDataFrame([(d, bytes(s.tobytes())) for d, s in sets], "doc_id long, set binary")
    for percent in (85, 80, 70):
        group = {d: d if d % 3 else 0 for d, _ in rows}
        groups = spark.createDataFrame(list(group.items()), "doc_id long, group long")
        got = {tuple(r) for r in nd._confirmed(nd.exact_pairs(table, groups, percent), table, percent).collect()}
        want = {(min(a, b), max(a, b)) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if a != b and group[a] != group[b] and len(x) and len(y) and nd._linked(x, y, percent)}
        assert got == want and want


def test_few_pairs_in_a_family_of_thousands(spark):
    rows = family(2000, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in nd.near_components(docs).collect()}
    want = list(range(len(rows)))
    links = all_links([nd.shingle_set(t) for _, t in rows])
    assert 40 <= len(links) < 400
    for _ in range(20):
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert [got[d] for d, _ in rows] == want


def test_small_regions_are_not_cut(spark):
    """Many parts for few rows: an order cut by range would have each row in its own part."""
    w = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(i, " ".join([f"x{i}", *w])) for i in range(3)], "doc_id long, text string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "150")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        small = spark.range(3, numPartitions=3).selectExpr("7L AS key", "id AS doc_id", "unhex('00') AS path").cache()
        assert nd._whole(small).selectExpr("spark_partition_id() AS p").distinct().count() == 1
        assert nd._in_order(small).selectExpr("spark_partition_id() AS p").distinct().count() == 3
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.component_id for r in nd.near_components(docs).collect()} == {0}


def test_original_meets_copies_in_all_pieces(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, nd.HASHES).astype(np.uint8)
    rows = [(0, base)]
    for i in range(1, 600):
        sig = base.copy()
        at = rng.choice(nd.HASHES, 16, replace=False)
        sig[at] = rng.integers(0, 256, 16)
        rows.append((i, sig))
    table = spark.createDataFrame([(5, d, bytes(rng.bytes(40)), s.tobytes()) for d, s in rows], "key long, doc_id long, path binary, signature binary")
    got = {tuple(r) for r in nd.hub_pairs(table, 0.7, piece=50).collect()}
    assert {(0, i) for i in range(1, 600)} <= got


def test_null_ids(spark):
    w = [f"w{i}" for i in range(50)]
    rows = [(7, " ".join(w)), (None, " ".join(["x", *w])), (None, "alone in the world of words"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_components(docs).collect()), key=str)
    assert got == sorted([(7, 46, 7, True), (None, 47, 7, False), (None, 2, None, True), (None, 0, None, True)], key=str)


@pytest.mark.parametrize("parts", ["4", "48", "211"])
def test_partitions_do_not_matter(spark, parts):
    """A region over many pieces and parts: one original, copies linked with it and not with each other."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(1000, " ".join(base))]
    for i in range(200):
        w = list(base)
        for at in rng.sample(range(0, 300, 10), 4):
            w[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {"spark.sql.shuffle.partitions": parts, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        assert {r.component_id for r in nd.near_components(docs).collect()} == {0}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
