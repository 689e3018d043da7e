"""BPE ids by content-defined chunks: what documents share is encoded once, joins are repaired.

A rolling hash over the bytes cuts each text into chunks, so that equal passages give equal chunks
wherever they stand.  One aggregate over the digests finds the chunks that occur more than once and an
owner for each; the owner's document encodes the chunk, and a join brings its ids to all documents that
hold it.  Chunks of one document only are encoded where they stand.  A cut may run through a word: the
ids of a chunk are those of its whole words, and the word at each join is encoded again together with
its neighbours, outwards until the neighbours come out exactly as their chunks have them.

Texts move once, compressed, by the digest of a row; the exchange serves owners and result alike.  A chunk's digest
travels in sixteen bytes.  A frequent chunk is one key of a join that adaptive execution can split, with
one row on its other side; nothing is gathered but one document's own chunks.

Cases: null counts as empty text; an empty text has no ids and decodes to an empty text; special strings
inside texts are one token each, as the library has it; rows that repeat a doc_id each keep their own
result, null ids too; no documents give no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from functools import partial
from hashlib import blake2b
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import require_columns, small_batches

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks have at least SHORT bytes, about SHORT + MEAN on average, and at most LONG.
SHORT, MEAN, LONG = 256, 768, 4096
#: Words remembered in each of two generations, and the longest of them.
ENTRIES, LONGEST = 250_000, 48
_SPACES = frozenset(b" \t\n\v\f\r")
_GEAR = np.array([int.from_bytes(blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], np.uint32)
_LOADED: dict[str, WordEncoder] = {}


def cut_points(raw: bytes) -> list[int]:
    """Ends of the chunks of a text in bytes; each stands before a first byte of a character."""
    b = np.frombuffer(raw, np.uint8)
    if len(b) <= SHORT:
        return [len(b)] if len(b) else []
    h = _GEAR[b]
    for shift in (1, 2, 4, 8):  # a hash of the last 2, 4, 8, 16 bytes
        h[shift:] += h[:-shift] << np.uint32(shift)
    starts = (b & 0xC0) != 0x80
    found = np.flatnonzero((h[:-1] >> np.uint32(8)) % np.uint32(MEAN) == 0) + 1
    ends, at = [], 0
    for end in [*found[starts[found]].tolist(), len(b)]:
        while end - at > LONG:
            cut = at + LONG
            while not starts[cut]:
                cut -= 1
            ends.append(cut)
            at = cut
        if end - at >= SHORT or end == len(b) and end > at:
            ends.append(end)
            at = end
    return ends


def chunks(raw: bytes) -> list[bytes]:
    ends = cut_points(raw)
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def digest(chunk: bytes) -> bytes:
    return blake2b(chunk, digest_size=16).digest()


class WordEncoder:
    """Ids of words, by a bounded table in front of the tokenizers library.

    For vocabularies whose normalizer and pre-tokenizer never look across ASCII white space and drop it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        if self.library(["a b\n\nc"])[0] != b"".join(self.library(["a", "b", "c"])):
            raise ValueError("words of this vocabulary depend on the white space between them")
        self.names = [self.tok.id_to_token(i) for i in range(self.tok.get_vocab_size(with_added_tokens=True))]
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def library(self, texts: list[str]) -> list[bytes]:
        ids, ends = [], [0]
        for e in self.tok.encode_batch_fast(texts, add_special_tokens=False):
            ids += e.ids
            ends.append(4 * len(ids))
        raw = np.array(ids, "<u4").tobytes()
        return [raw[a:b] for a, b in pairwise(ends)]

    def learn(self, words: set[bytes]) -> None:
        """Afterwards `known` has all these words."""
        if len(self.known) > ENTRIES:
            self.old, self.known = self.known, {}
        new = []
        for w in words - self.known.keys():
            if (ids := self.old.get(w)) is None:
                new.append(w)
            else:
                self.known[w] = ids
        self.known.update(zip(new, self.library([w.decode() for w in new]), strict=True))

    def forget_long(self, words: set[bytes]) -> None:
        for w in words:
            if len(w) > LONGEST:
                self.known.pop(w, None)


def encoder(path: str) -> WordEncoder:
    """One for each Python worker and vocabulary."""
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def whole_words(chunk: bytes) -> tuple[bytes | None, list[bytes], bytes | None]:
    """A chunk as the end of a word, whole words, and the start of a word.

    The first is None if white space comes first, the last if it comes last; a chunk without white space is all in the first.
    """
    words = chunk.split()
    head = words.pop(0) if chunk[0] not in _SPACES else None
    tail = words.pop() if words and chunk[-1] not in _SPACES else None
    return head, words, tail


def inner_ids(words: list[bytes], enc: WordEncoder) -> tuple[bytes, int, int]:
    """Ids of whole words, and how many bytes the first and the last word have in them."""
    parts = [enc.known[w] for w in words]
    return b"".join(parts), len(parts[0]) if parts else 0, len(parts[-1]) if parts else 0


class Assembly:
    """Ids of one document from its chunks; what the joins need is encoded afterwards, for many documents at once."""

    def __init__(self):
        self.parts: list[bytes | None] = []
        #: Place in parts, left word and its ids, word at the join, right word and its ids.
        self.seams: list[tuple[int, bytes, bytes, bytes, bytes, bytes]] = []
        self.left, self.left_ids, self.open = b"", b"", b""

    def join(self, right: bytes = b"", right_ids: bytes = b"") -> None:
        """The open word ends here."""
        if self.open:
            self.seams.append((len(self.parts), self.left, self.left_ids, self.open, right, right_ids))
            self.parts.append(None)
        self.open = b""

    def add(self, chunk: bytes, head: bytes | None, words: list[bytes], tail: bytes | None, piece: tuple[bytes, int, int]) -> None:
        """A chunk as whole_words gives it, with the ids of its whole words."""
        ids, first, last = piece
        self.open += head or b""
        if not words and tail is None and chunk[-1] not in _SPACES:
            return  # no white space in it: the word goes on
        self.join(words[0] if words else b"", ids[:first])
        self.left, self.left_ids = (words[-1], ids[len(ids) - last :]) if words else (b"", b"")
        self.parts.append(ids)
        self.open = tail or b""


def repair(documents: list[Assembly], enc: WordEncoder) -> list[bytes]:
    """Ids of each document, after the words at all joins were encoded again between their neighbours."""
    seams = [(d, *s) for d in documents for s in d.seams]
    found = enc.library([b" ".join(w for w in (left, word, right) if w).decode() for _, _, left, _, word, right, _ in seams])
    for (d, at, _, left_ids, _, _, right_ids), ids in zip(seams, found, strict=True):
        end = len(ids) - len(right_ids)
        if ids[: len(left_ids)] != left_ids or ids[end:] != right_ids:
            raise ValueError("ids of whole words differ from their chunk's: the vocabulary looks across white space")
        d.parts[at] = ids[len(left_ids) : end]
    return [b"".join(d.parts) for d in documents]


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, texts, compressed behind their length."""
    codec = pa.Codec("zstd", 1)
    for b in batches:
        raws = [t.encode() for t in b.column(2).to_pylist()]
        packed = [len(raw).to_bytes(8, "little") + codec.compress(raw, asbytes=True) for raw in raws]
        yield pa.record_batch([b.column(0), b.column(1), pa.array(packed, pa.binary())], ["doc_id", "uid", "packed"])


def _unpacked(column: pa.Array) -> Iterator[bytes]:
    codec = pa.Codec("zstd")
    for p in column.to_pylist():
        yield codec.decompress(p[8:], int.from_bytes(p[:8], "little"), asbytes=True)


def _list_chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """uid, text -> uid, digests of its chunks."""
    for b in batches:
        out = [[digest(c) for c in chunks(t.encode())] for t in b.column(1).to_pylist()]
        yield pa.record_batch([b.column(0), pa.array(out, pa.list_(pa.binary()))], ["uid", "digests"])


def _encode_owned(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """doc_id, packed text, places of the chunks that the document owns -> digest, ids of whole words, bytes of the first and the last word."""
    enc = encoder(path)
    for b in batches:
        mine = []
        for raw, places in zip(_unpacked(b.column(1)), b.column(2).to_pylist(), strict=True):
            all_chunks = chunks(raw)
            mine += [all_chunks[p] for p in set(places)]
        words = [whole_words(c)[1] for c in mine]
        seen = {w for some in words for w in some}
        enc.learn(seen)
        found = [inner_ids(some, enc) for some in words]
        enc.forget_long(seen)
        yield pa.record_batch([pa.array([digest(c) for c in mine], pa.binary()), pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int32())], ["digest", "ids", "first", "last"])


def _encode_documents(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """doc_id, packed text, shared chunks by place -> doc_id, ids."""
    enc = encoder(path)
    for b in batches:
        plan, seen = [], set()
        for raw, shared in zip(_unpacked(b.column(1)), b.column(2).to_pylist(), strict=True):
            have = {s["pos"]: (s["ids"], s["first"], s["last"]) for s in shared or []}
            rows = [(c, *whole_words(c), have.get(k)) for k, c in enumerate(chunks(raw))]
            for _, _, words, _, piece in rows:
                if piece is None:
                    seen.update(words)
            plan.append(rows)
        enc.learn(seen)
        documents = []
        for rows in plan:
            d = Assembly()
            for chunk, head, words, tail, piece in rows:
                d.add(chunk, head, words, tail, piece or inner_ids(words, enc))
            d.join()
            documents.append(d)
        enc.forget_long(seen)
        ids = repair(documents, enc)
        offsets = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
        yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))], ["doc_id", "ids"])


def _names(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """doc_id, ids -> with the text that the ids stand for."""
    names = encoder(path).names
    for b in batches:
        lists = b.column(1)
        ids, ends = lists.flatten().to_numpy().tolist(), np.cumsum([0, *(n or 0 for n in pc.list_value_length(lists).to_pylist())]).tolist()
        texts = [" ".join([names[i] for i in ids[x:y]]) for x, y in pairwise(ends)]
        yield pa.record_batch([*b.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])


def row_key() -> Column:
    """Sixteen bytes that tell rows apart by doc_id and text."""
    own = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-null")), F.lit("\0"), F.col("text"))
    return F.coalesce(F.substring(F.unhex(F.sha2(own.cast("binary"), 256)), 1, 16), F.lit(b""))  # never null, as the plan sees too


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """documents -> doc_id, ids (array of int) of each whole text, without added special tokens."""
    require_columns(docs, ["doc_id", "text"])
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", row_key().alias("uid"), "text")
    packed = plain.mapInArrow(_pack, f"doc_id {kind}, uid binary not null, packed binary")
    listed = plain.select("uid", "text").mapInArrow(_list_chunks, "uid binary not null, digests array<binary>")
    listed = listed.groupBy("uid").agg(F.first("digests").alias("digests"))  # repeated rows once
    places = listed.select("uid", F.posexplode("digests").alias("pos", "digest"))
    owners = places.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("uid", "pos")).alias("own")).where("n > 1")
    owned = owners.groupBy(F.col("own.uid").alias("uid")).agg(F.collect_list("own.pos").alias("places"))
    mine = packed.join(owned.hint("shuffle_hash"), "uid").select("doc_id", "packed", "places")  # the columns of the exchange below, so that it is made once
    pieces = mine.mapInArrow(partial(_encode_owned, path=path), "digest binary, ids binary, first int, last int").dropDuplicates(["digest"])
    shared = places.join(pieces, "digest").groupBy("uid").agg(F.collect_list(F.struct("pos", "ids", "first", "last")).alias("shared"))
    whole = packed.join(shared.hint("shuffle_hash"), "uid", "left").select("doc_id", "packed", "shared")
    return whole.mapInArrow(partial(_encode_documents, path=path), f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids -> doc_id, ids, decoded: what the library's decode gives, special tokens kept.

    For vocabularies without a decoder, whose tokens stand with a space between them.
    """
    if _decoder(path) is not None:
        raise ValueError("only vocabularies without a decoder")
    return encoded.select("doc_id", "ids").mapInArrow(partial(_names, path=path), f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def _decoder(path: str) -> dict | None:
    with open(path, encoding="utf-8") as f:
        return json.load(f).get("decoder")


def digests_of_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """documents -> doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256."""
    out = decode_documents(encode_documents(docs, path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
