"""Token counts from distinct pre-tokens.

One pass finds the distinct pre-tokens of all texts with their frequencies; each is counted once
by the tokenizer.  A second pass reads each document's pre-token frequencies and sums them: those of
the at most ``HOT`` most frequent pre-tokens against a broadcast table of that bounded size, all
others by a join on the pre-token, which by then occurs seldom, so that no key is hot.  Ids are
never materialised.

Cases: null counts as empty text (0 bytes, 0 tokens); special strings inside texts count as one
token each, as the library's default has it; rows that repeat a doc_id each keep their own counts;
no documents give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, require_columns, small_batches
from .tokens import _BREAK, _ODD, PATTERN, encoder

HOT, FLUSH = 300_000, 300_000


class PreTokens:
    """Pre-tokens of texts, by chunks that are split once."""

    def __init__(self, path: str):
        import regex

        self.find = regex.compile(PATTERN).findall
        special = encoder(path).special
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def chunks(self, text: str) -> tuple[Counter, list[str], int]:
        """How often each chunk behind a space occurs, the chunks without one, and the number of special strings."""
        texts = self.special.split(text) if self.special else [text]
        out: Counter = Counter()
        heads = []
        for t in texts:
            parts = _BREAK.split(t) if _ODD.search(t) else t.split(" ")
            if parts[0]:
                heads.append(parts[0])
            parts[0] = None
            out.update(parts)
            del out[None]
        return out, heads, len(texts) - 1

    def of(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk behind a space."""
        return self.find(" " + chunk)


def _vocabulary(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    pre, total, heads = PreTokens(path), Counter(), Counter()

    def flush() -> pa.RecordBatch:
        pieces: Counter = Counter()
        for chunk, n in total.items():
            for p in pre.of(chunk):
                pieces[p] += n
        for head, n in heads.items():
            for p in pre.find(head):
                pieces[p] += n
        total.clear(), heads.clear()
        return pa.record_batch([pa.array(pieces.keys(), pa.string()), pa.array(pieces.values(), pa.int64())], ["piece", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                chunks, first, _ = pre.chunks(text)
                total.update(chunks), heads.update(first)
                if len(total) + len(heads) > FLUSH:
                    yield flush()
    if total or heads:
        yield flush()


def _count_pieces(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for b in batches:
        n = [len(x) // 4 for x in enc._plain(b.column(0).to_pylist())]
        yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64())], ["piece", "n", "tokens"])


def _documents(batches: Iterable[pa.RecordBatch], path: str, hot) -> Iterator[pa.RecordBatch]:
    """For each document the tokens of its hot pre-tokens, and its other pre-tokens with frequencies."""
    pre, known, cache = PreTokens(path), hot.value, {}
    for batch in batches:
        digests, sizes, sums, colds, freqs = [], [], [], [], []
        for text in batch.column(1).to_pylist():
            raw = (text or "").encode()
            chunks, heads, total = pre.chunks(text) if text else (Counter(), [], 0)
            cold: Counter = Counter()
            for head in heads:
                for p in pre.find(head):
                    if p in known:
                        total += known[p]
                    else:
                        cold[p] += 1
            for chunk, n in chunks.items():
                tokens = cache.get(chunk)
                if tokens is None:
                    pieces = pre.of(chunk)
                    tokens = sum(known.get(p, 0) for p in pieces)
                    rare = [p for p in pieces if p not in known]
                    if rare:
                        for p in rare:
                            cold[p] += n
                    elif len(cache) < FLUSH:
                        cache[chunk] = tokens
                total += tokens * n
            digests.append(blake2b(raw, digest_size=16).digest())
            sizes.append(len(raw))
            sums.append(total)
            colds.append(list(cold.keys()))
            freqs.append(list(cold.values()))
        yield pa.record_batch([batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(colds, pa.list_(pa.string())), pa.array(freqs, pa.list_(pa.int64()))], ["doc_id", "digest", "n_bytes", "tokens", "pieces", "freqs"])


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """documents -> doc_id, n_bytes, n_tokens, over_limit."""
    require_columns(docs, ["doc_id", "text"])
    spark = docs.sparkSession
    small_batches(spark)
    pieces = docs.select("text").mapInArrow(partial(_vocabulary, path=path), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    pieces = materialize(pieces.mapInArrow(partial(_count_pieces, path=path), "piece string, n long, tokens long"), "pieces")
    # The lowest power of two that no more than HOT pre-tokens reach; a row for each power.
    powers = pieces.groupBy(F.floor(F.log2("n")).alias("p")).count().collect()
    least, room = 64, HOT
    for p, n in sorted(((r.p, r["count"]) for r in powers), reverse=True):
        room -= n
        if room < 0:
            break
        least = p
    is_hot = F.floor(F.log2("n")) >= least
    table = pieces.where(is_hot & (F.length("piece") <= 64)).select("piece", "tokens").toArrow()
    hot = spark.sparkContext.broadcast(dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True)))
    # Long frequent pre-tokens, if any, stay out of the broadcast and are joined like the rare ones.
    rare = pieces.where(~(is_hot & (F.length("piece") <= 64))).select("piece", F.col("tokens").alias("each"))
    own = docs.select("doc_id", "text").mapInArrow(partial(_documents, path=path, hot=hot), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest binary, n_bytes long, tokens long, pieces array<string>, freqs array<long>")
    # A document's own row travels under a key that no pre-token has (letters and digits behind a control sign), spread as the documents are.
    head = F.struct(F.concat(F.lit("\0"), F.hex("digest")).alias("piece"), F.col("tokens").alias("n"), F.col("n_bytes"))
    tail = F.zip_with("pieces", "freqs", lambda p, f: F.struct(p.alias("piece"), f.alias("n"), F.lit(None).cast("long").alias("n_bytes")))
    own = own.select("doc_id", "digest", F.explode(F.concat(F.array(head), tail)).alias("x")).select("doc_id", "digest", "x.*")
    base = F.col("n_bytes").isNotNull()
    summed = own.join(rare, "piece", "left").groupBy("doc_id", "digest").agg(F.max("n_bytes").alias("n_bytes"), F.sum(F.when(base, F.col("n")).otherwise(F.col("n") * F.col("each"))).alias("sum"), F.count_if(base).alias("copies"))
    summed = summed.withColumn("n_tokens", F.expr("sum div copies"))
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.explode(F.sequence(F.lit(1), "copies")).alias("_copy")).drop("_copy")
