"""Chunk-wise encoding and decoding against the tokenizers library, one text at a time."""

from __future__ import annotations

import hashlib
import random

import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

from lanewright.llm import chunk_encoding as C
from lanewright.llm.common import read_table
from lanewright.llm.queries import op13_bpe_round_trip
from lanewright.llm.tokens import tokenizer_path

DIR = "/root/testdata/sf0.001"
PATH = tokenizer_path("word_bpe_49k.json")
PASSAGE = " ".join(f"shared{i} passage," for i in range(400))
ODD = [
    (0, "Hello  WORLD \n\n  it's  fine it'S 2nd", "x"),
    (1, None, None),
    (2, "", "x"),
    (3, "a <|endoftext|>b  <|endoftext|> c<|startoftext|>", "x"),
    (4, PASSAGE + " end", "y"),
    (5, "start " + PASSAGE, "y"),
    (6, " \t\x0b　 x  y ٣٤ ²³ \x1c z\x85 é ́ ΑΣ İ", "y"),
    (7, PASSAGE, "y"),
    (7, PASSAGE, "y"),
    (7, "other text of the same id", "y"),
    (None, PASSAGE, "y"),
    (None, None, "y"),
    (11, "q" * 40_000, "y"),
    (12, "ab cd " * 30_000, "y"),
    (13, "漢字かな交じり文" * 2_000, "y"),
    (14, "x" * 5_000 + " " + "é" * 9_000 + " ", "y"),
    (15, " " * 9_000, "y"),
    (16, "<|endoftext|>" * 900, "y"),
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    return lambda t: (ids := tok.encode(t or "", add_special_tokens=False).ids, tok.decode(ids, skip_special_tokens=False))


def encoded(texts, shared=None):
    """Ids by the function that runs on executors."""
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("ids", pa.binary()), ("first", pa.int32()), ("last", pa.int32())]))
    plain = pa.record_batch([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "uid", "text"])
    (packed,) = C._pack([plain])
    batch = pa.record_batch([packed.column(0), packed.column(2), pa.array(shared or [None] * len(texts), kind)], ["doc_id", "packed", "shared"])
    return [r for out in C._encode_documents([batch], PATH) for r in out.column(1).to_pylist()]


def test_every_code_point(library):
    texts = [f"a{c} b {c}b{c}1 {c}  {c}" for c in map(chr, range(0x3100))]
    assert encoded(texts) == [library(t)[0] for t in texts]


@pytest.mark.parametrize(("short", "mean"), [(1, 2), (1, 9), (3, 17), (40, 60)])
def test_cuts_anywhere_with_and_without_shared_chunks(library, monkeypatch, short, mean):
    monkeypatch.setattr(C, "SHORT", short), monkeypatch.setattr(C, "MEAN", mean), monkeypatch.setattr(C, "LONG", 64)
    rng, enc = random.Random(short * mean), C.encoder(PATH)
    texts = ["".join(rng.choice(["a", "THE", " ", "é", "\n", "'s", "<|endoftext|>", "漢", "́", " of ", "9", "!", "ß"]) for _ in range(rng.randrange(120))) for _ in range(150)]
    assert encoded(texts) == [library(t)[0] for t in texts]
    shared = []
    for t in texts:
        rows = []
        for k, c in enumerate(C.chunks(t.encode())):
            if rng.random() < 0.5:
                words = C.whole_words(c)[1]
                enc.learn(set(words))
                rows.append(dict(zip(("pos", "ids", "first", "last"), (k, *C.inner_ids(words, enc)), strict=True)))
        shared.append(rows)
    assert encoded(texts, shared) == [library(t)[0] for t in texts]


def test_chunks_keep_the_text_and_meet_again():
    raw = PASSAGE.encode() * 3
    cut = C.chunks(raw)
    assert b"".join(cut) == raw and max(map(len, cut)) <= C.LONG
    other = C.chunks(b"something before: " + raw)
    assert len(set(cut) & set(other)) >= len(set(cut)) - 2
    wide = ("é" * 9_000).encode()
    assert b"".join(C.chunks(wide)) == wide and all(c.decode() for c in C.chunks(wide))


def test_disagreement_is_an_error():
    d, enc = C.Assembly(), C.encoder(PATH)
    enc.learn({b"left"})
    d.add(b"left ri", None, [b"left"], b"ri", (b"\0\0\0\0", 4, 4))
    d.add(b"ght", b"ght", [], None, (b"", 0, 0))
    d.join()
    with pytest.raises(ValueError, match="differ"):
        C.repair([d], enc)


@pytest.mark.parametrize("rows", ["odd", "table", "empty"])
def test_documents(spark, library, rows):
    odd = spark.createDataFrame(ODD, "doc_id long, text string, ids string")
    docs = {"odd": odd, "table": read_table(spark, DIR, "documents"), "empty": odd.limit(0)}[rows]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    out = C.decode_documents(C.encode_documents(docs, PATH), PATH).collect()
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in out), key=key) == sorted(((r.doc_id, *library(r.text)) for r in docs.select("doc_id", "text").collect()), key=key)


def test_query(spark, library):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in read_table(spark, DIR, "documents").collect():
        ids, text = library(r.text)
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(text)))
    assert sorted(map(tuple, op13_bpe_round_trip(spark, DIR).collect())) == sorted(want)


def test_texts_move_once(spark):
    docs = read_table(spark, DIR, "documents")
    out = C.encode_documents(docs, PATH)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") >= 2
