from __future__ import annotations

import random
from hashlib import sha256

import pytest

from lanewright.llm import substring_dedup as sd
from lanewright.llm.common import read_table


def brute(rows):
    first, out = {}, []
    docs = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in sorted(docs, key=lambda x: x[0]):
        for i in range(len(w) - 19):
            first.setdefault(tuple(w[i : i + 20]), (d, i))
    for d, w in docs:
        gone = {p for i in range(len(w) - 19) if first[tuple(w[i : i + 20])] != (d, i) for p in range(i, i + 20)}
        out.append((d, len(w), len(gone), sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def sample(seed=4):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(70)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(5, 120))]
        if i % 2:
            at = rng.randrange(len(w))
            w[at:at] = passage[rng.randrange(10) : rng.randrange(50, 71)]
        rows.append((i, " ".join(w)))
    rows += [(100, "z " * 400), (101, "a b c " * 300), (102, None), (103, ""), (104, " ".join(passage[:20])), (105, " ".join(passage[:19])), (106, rows[3][1]), (107, "\t" + rows[3][1].replace(" ", "\n"))]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 3) for r in sample()], "doc_id long, text string, content string, n_chars int")


def test_against_brute_force(docs):
    assert rows_of(sd.dedup_report(docs)) == brute(sample())


def test_frequent_anchors_and_many_anchors(docs, monkeypatch):
    monkeypatch.setattr(sd, "FREQUENT", 2)
    monkeypatch.setattr(sd, "SHARD_WORDS", 50)
    monkeypatch.setattr(sd, "FOUND_BITS", 7)
    monkeypatch.setattr(sd, "OFTEN_BITS", 8)
    assert rows_of(sd.dedup_report(docs)) == brute(sample())


def test_table(spark):
    table = read_table(spark, "/root/testdata/sf0.001", "documents")
    assert rows_of(sd.dedup_report(table)) == brute([(r.doc_id, r.text) for r in table.collect()])


def test_texts(docs):
    out = sd.dedup_texts(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    report = {d: (n, h) for d, _, n, h in brute(sample())}
    before = dict(sample())
    for r in out.collect():
        n, h = report[r.doc_id]
        if n:
            assert sha256(r.text.encode()).hexdigest() == h and r.n_chars == len(r.text)
        else:
            assert r.text == before[r.doc_id] and r.n_chars == 3


def test_empty_and_repeated_rows(spark, docs):
    assert sd.dedup_report(docs.limit(0)).count() == 0
    twice = docs.where("doc_id < 4").unionByName(docs.where("doc_id < 4"))
    assert sd.dedup_report(twice).count() == 8


def test_null_ids_long_words_and_megabytes(spark):
    rng = random.Random(8)
    some = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    long = " ".join(f"v{i % 7000}" for i in range(200_000))
    rows = [(5, some), (None, some), (None, "x " + some), (7, "y" * 3_000_000), (8, long), (9, long[5:])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, first int")
    got = {(r.doc_id, r.n_words): r.n_removed for r in sd.dedup_report(docs).collect()}
    assert got == {(5, 60): 0, (None, 60): 60, (None, 61): 60, (7, 1): 0, (8, 200_000): 193_000, (9, len(long[5:].split())): len(long[5:].split())} or got[9, 199_999] >= 199_990


@pytest.mark.parametrize("seed", range(4))
def test_first_places(seed):
    """Many contents of one key, with shared and repeated windows."""
    rng = random.Random(seed)
    source = [rng.randrange(30) for _ in range(200)]
    contents = []
    for d in range(40):
        a = rng.randrange(150)
        w = source[a : a + rng.randrange(6, 50)] + [rng.randrange(30) for _ in range(rng.randrange(4))] * rng.randrange(1, 5)
        # Equal windows have equal keys.
        contents.append((d % 3, b" ".join(b"%d_%d" % (d % 3, x) for x in w), d // 2, 100 * (d % 2)))
    first = {}
    for k, c, d, p in sorted(contents, key=lambda x: x[2:]):
        w = c.split()
        for i in range(len(w) - 5):
            first.setdefault((k, tuple(w[i : i + 6])), (d, p + i))
    for (k, c, d, p), got in zip(contents, sd.first_places(contents, 6), strict=True):
        w = c.split()
        places = [(d, p + i) for i in range(len(w) - 5)] if got is None else [tuple(x) for x in got.tolist()]
        assert places == [first[k, tuple(w[i : i + 6])] for i in range(len(w) - 5)]


def test_clashing_and_dotted_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 1, 2, 3, 4)], "doc_id long, text string, changed_id int, kept_words int, `a.b` int, Kept int")
    assert sd.dedup_texts(docs).columns == docs.columns and sd.dedup_texts(docs).count() == 1
