"""Token counts, binary records and packing against the tokenizers library, one document at a time."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from lanewright.llm import packing, records, token_counts
from lanewright.llm.common import read_table, scratch_path
from lanewright.llm.tokens import ChunkEncoder, tokenizer_path

DIR = "/root/testdata/sf0.001"
ODD = [
    (0, "Hello  world \n\n  it's  fine", "x"),
    (1, None, None),
    (2, "", "x"),
    (3, "a <|endoftext|>b  <|endoftext|> c", "x"),
    (4, "word " * 3000 + "end", "y"),
    (5, "word " * 3000 + "end", "y"),
    (6, " \t\x0b　 x  y ٣٤ ²³ \x1c z", "y"),
    (7, "twin", "y"),
    (7, "twin", "y"),
    (7, "other twin of the same id", "y"),
    (8, "a \0b c", "y"),
    (9, "x \x001 1", "y"),
    (10, "\0b \0b\0 \0", "y"),
    (11, "q" * 40_000, "y"),
    (12, "ab cd " * 30_000, "y"),
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, n_tokens string")


@pytest.fixture(params=["odd", "table"])
def docs(request, spark, odd):
    return odd if request.param == "odd" else read_table(spark, DIR, "documents")


def test_chunks_equal_the_library_on_every_code_point(library):
    enc = ChunkEncoder(tokenizer_path())
    texts = [f"a{c} b {c}b{c}1 {c}  {c}" for c in map(chr, range(0x3100)) if c != "\ud800"]
    got = enc.encode_many(texts)
    assert all(np.frombuffer(g, "<u4").tolist() == library(t) for g, t in zip(got, texts, strict=True))


def test_token_counts(docs, library):
    got = sorted(map(tuple, token_counts.count_tokens(docs, tokenizer_path()).collect()))
    want = sorted((r.doc_id, len((r.text or "").encode()), n := len(library(r.text)), n > 512) for r in docs.select("doc_id", "text").collect())
    assert got == want


def test_token_counts_on_every_code_point(library, spark):
    texts = [f"a{c} b {c}b{c}1 {c}  {c}" for c in map(chr, range(0x3100))] + [f"{c}b {c} {c}" for c in map(chr, range(0x3100))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, tokenizer_path()).collect()}
    assert got == {i: len(library(t)) for i, t in enumerate(texts)}


def test_token_counts_without_hot_pre_tokens(docs, library, monkeypatch):
    monkeypatch.setattr(token_counts, "HOT", 3)
    got = {(r.doc_id, r.n_tokens) for r in token_counts.count_tokens(docs, tokenizer_path()).collect()}
    assert got == {(r.doc_id, len(library(r.text))) for r in docs.select("doc_id", "text").collect()}


def test_records_round_trip(docs, library, spark):
    rows = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    want, start = [], 0
    for i, t in rows:
        ids = [*library(t), 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, records.encode_and_read_back(docs, tokenizer_path()).collect())) == sorted(want)


def test_shuffled_read_and_corruption(odd, library, spark):
    path = scratch_path(spark, "r")
    records.write_records(odd, path, tokenizer_path())
    got = sorted((r.doc_id, r.ids) for r in records.read_records(spark, path, shuffle_seed=3).collect())
    assert got == sorted((i, [*library(t), 2]) for i, t, _ in ODD)
    whole = records.frame(b"payload")
    assert records.unframe(memoryview(whole)) == b"payload"
    for at in range(len(whole)):
        with pytest.raises(ValueError):
            records.unframe(memoryview(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :]))


def test_packing(docs, library):
    got = packing.pack_documents(docs, tokenizer_path()).collect()
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = [*library(r.text), 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(min(first, len(ids)), len(ids) + 1, 2048)]
        want += [(r.doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    check_places(got)


def check_places(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by)


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(1)
    lengths = np.concatenate([rng.integers(1, 2049, 3000), rng.integers(300, 900, 20000), np.full(5000, 683)])
    histogram = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True))}
    plan = packing.make_plan(histogram, 2048)
    assert dict(plan.rank) == histogram
    bound = -(-int(lengths.sum()) // 2048)
    assert plan.sequences <= 1.03 * bound + 2


def test_empty(odd):
    none = odd.limit(0)
    for out in (token_counts.count_tokens(none, tokenizer_path()), records.encode_and_read_back(none, tokenizer_path()), packing.pack_documents(none, tokenizer_path())):
        assert out.count() == 0
