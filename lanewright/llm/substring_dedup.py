"""Substring deduplication: repeated windows of words, found in compressed FM-indexes of shards.

A window is WINDOW consecutive words of a document; it is a repeat if its words also start earlier
(a smaller doc_id, or an earlier place of the same document).  Words under repeats are removed.

1. Each window has an anchor, its smallest hash of ANCHOR words; equal windows have equal
   anchors.  Runs of windows with one anchor are segments.  Anchors seen in one document text only, and
   once in it, mark unique windows, and those segments go no further.
2. The other segments are cut out of the documents and brought together by anchor.  Where an
   anchor is frequent, its segments are cut into single windows.  A task sends a content once, so a
   place gathers at most PER_TEXT * FREQUENT rows, or of a single window one for each task.
3. Distinct segments come to shards of bounded size, all of an anchor to one.  The earliest
   segment of each anchor goes into the shard's FM-index (BWT in a wavelet matrix; of the suffix
   array only the first place of each run of suffixes that share a window is kept).  All later ones
   are streamed against it: backward search gives each word's matching statistic, the longest match
   that ends there; where it reaches WINDOW, the window is a repeat, and its suffix interval tells its
   first place.  Stretches under the threshold go through again, with twice as many segments of each
   anchor indexed.
4. Every occurrence compares its windows' own places with the first ones, and documents
   keep the words that no repeat covers.

A whole document with the words of an earlier one is one class with it: all its windows are
repeats, so nothing of it is searched.

Which anchors repeat, and which are frequent, travels as two tables of bits: 64 for each anchor, and of
2 ** FOUND_BITS and 2 ** OFTEN_BITS bits (64 and 2 MB) at most, whatever the input.  Anchors that fall on
a set bit by chance only send segments that step 3 finds to be alone, or in single windows; results
stay the same.

Cases: null, empty and short texts (under WINDOW words) lose nothing; rows that repeat a doc_id
with the same words count as one document and get equal rows, with other words each keeps its
row; a null doc_id counts as larger than all others, its rows of one text as one document; no
documents give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from hashlib import sha256
from itertools import chain, compress, groupby
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IdSpace, fresh, materialize, own_columns, require_columns, small_batches, words
from .fingerprints import _M1, mix, word_hashes
from .fm_index import FMIndex

WINDOW, ANCHOR = 20, 4
LONGEST = 256  # windows in a segment
PER_TEXT, FREQUENT = 16, 2000  # counts of an anchor, one for each PER_TEXT segments of a text, from which segments are cut into windows
SHARD_WORDS = 300_000
FOUND_BITS, OFTEN_BITS = 29, 24
SALTS = 16
EMPTY = sha256(b"").hexdigest()
_B1, _B2 = np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5)


class Batch:
    """The words of a batch of texts in a row, and the segments of their windows."""

    def __init__(self, texts: list[str | None]):
        self.words = [(t or "").encode().split() for t in texts]
        self.lengths = np.fromiter(map(len, self.words), np.int64, len(texts))
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1] if len(texts) else np.zeros(0, np.int64)
        self.flat = list(chain.from_iterable(self.words))
        n = len(self.flat)
        self.hashes = h = word_hashes(self.flat)
        self.anchor, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.grams = np.zeros(0, np.uint64)
        if n >= WINDOW:
            self.grams = grams = self._grams(h)
            # The minimum over the grams of a window, by doubling.
            span, width, least = WINDOW - ANCHOR + 1, 1, grams
            while width < span:
                step = min(width, span - width)
                least = np.minimum(least[:-step], least[step:])
                width += step
            # Windows that stay in a text.
            inside = np.zeros(n + 1, np.int64)
            long = self.lengths >= WINDOW
            inside[self.starts[long]] += 1
            inside[self.starts[long] + self.lengths[long] - WINDOW + 1] -= 1
            at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
            if len(at):
                value = least[at]
                cut = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)]))
                count = np.diff(np.concatenate([cut, [len(at)]]))
                if count.max() > LONGEST:
                    cut = np.concatenate([np.arange(a, a + c, LONGEST) for a, c in zip(cut, count, strict=True)])
                    count = np.diff(np.concatenate([cut, [len(at)]]))
                self.anchor, self.first, self.count = value[cut].view(np.int64), at[cut], count
        self.row = np.searchsorted(self.starts, self.first, "right") - 1

    @staticmethod
    def _grams(h: np.ndarray) -> np.ndarray:
        n = len(h) - ANCHOR + 1
        out = h[:n].copy()
        for k in range(1, ANCHOR):
            out = mix(out * _M1 + h[k : k + n])
        return out

    def anchors(self) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """For each text its distinct anchors, those that may mark repeats within it, and how many segments each has.

        An anchor repeats in a text if it has two segments, or two places in one.
        """
        span = WINDOW - ANCHOR + 1
        twice = self.count > span
        rest = np.flatnonzero(~twice)
        first, grams, value = self.first[rest], self.count[rest] + span - 1, self.anchor[rest]
        hits = np.zeros(len(rest), np.int64)
        signed = self.grams.view(np.int64)
        for k in range(2 * span - 1):
            hits += (k < grams) & (signed[np.minimum(first + k, len(signed) - 1)] == value) if len(rest) else 0
        twice[rest[hits > 1]] = True
        order = np.lexsort((self.anchor, self.row))
        row, anchor, again = self.row[order], self.anchor[order], twice[order]
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])]) if len(row) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        many = (np.bincount(group) > 1) | (np.bincount(group, again) > 0) if len(row) else np.zeros(0, bool)
        times = np.bincount(group) if len(row) else np.zeros(0, np.int64)
        row, anchor = row[new], anchor[new]
        cuts = np.searchsorted(row, np.arange(1, len(self.lengths)))
        cuts_many = np.searchsorted(row[many], np.arange(1, len(self.lengths)))
        return np.split(anchor, cuts), np.split(anchor[many], cuts_many), np.split(times, cuts)

    def pieces(self, found: np.ndarray, frequent: np.ndarray) -> dict[str, np.ndarray]:
        """Segments with found anchors, those with frequent ones as single windows: row, key, two digests, place and length."""
        keep = _member(found, self.anchor)
        row, anchor, first, count = self.row[keep], self.anchor[keep], self.first[keep], self.count[keep]
        single = _member(frequent, anchor)
        times = np.where(single, count, 1)
        again = np.repeat(np.arange(len(row)), times)
        step = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
        row, anchor, single = row[again], anchor[again], single[again]
        first, count = first[again] + step, np.where(single, 1, count[again])
        last = first + count + WINDOW - 1
        digests = []
        for base, h in ((_B1, self.hashes), (_B2, mix(self.hashes + _M1))):
            # Sums of hash * base ** place, moved to place 0 by the inverse powers.
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), base, np.uint64)]))
            back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), pow(int(base), -1, 1 << 64), np.uint64)]))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(h * power[:-1])])
            digests.append(mix(((sums[last] - sums[first]) * back[first])).view(np.int64))
        return {"row": row, "key": np.where(single, digests[0], anchor), "d1": digests[0], "d2": digests[1], "first": first, "at": first - self.starts[row], "count": count, "single": single}


def bit_table(anchors: DataFrame, most: int) -> np.ndarray:
    """A table of 64 bits for each anchor, to a power of two, 2 ** most at most; those of the anchors are set."""
    bits = min(most, max(12, (64 * anchors.count()).bit_length()))
    bit = F.col("anchor").bitwiseAND((1 << bits) - 1)
    words = anchors.select(F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, cast(anchor & 63 AS int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(max(1, 1 << (bits - 6)), np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def _member(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = values.view(np.uint64) & np.uint64(64 * len(table) - 1)
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _doc_key(words: list[bytes]) -> int:
    return int.from_bytes(sha256(b" ".join(words)).digest()[:8], "little", signed=True)


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lists = pa.list_(pa.int64())
    for b in batches:
        batch = Batch(b.column(1).to_pylist())
        digests = [sha256(b" ".join(w)) for w in batch.words]
        keys = [int.from_bytes(d.digest()[:8], "little", signed=True) for d in digests]
        anchors, again, times = batch.anchors() if b.num_rows else ([], [], [])
        yield pa.record_batch([b.column(0), pa.array(batch.lengths), pa.array([d.hexdigest() for d in digests], pa.string()), pa.array(keys, pa.int64()), pa.array(anchors, lists), pa.array(again, lists), pa.array(times, lists)], ["doc_id", "n_words", "sha", "doc_key", "anchors", "again", "times"])


def _contents(batches: Iterable[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Contents with their places, a content again only at a smaller place than before in the task."""
    seen: dict[tuple[int, int], tuple[int, int]] = {}
    for b in batches:
        ids = b.column("doc_id").to_pylist()
        batch = Batch(b.column("text").to_pylist())
        p = batch.pieces(*shared.value)
        if len(seen) > 500_000:
            seen.clear()
        rows = []
        for r, key, d1, d2, first, at, count in zip(*(p[c].tolist() for c in ("row", "key", "d1", "d2", "first", "at", "count")), strict=True):
            place, before = (ids[r], at), seen.get((d1, d2))
            if before is None or place < before:
                seen[d1, d2] = place
                rows.append((key, d1, d2, *place, b" ".join(batch.flat[first : first + count + WINDOW - 1])))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["key", "d1", "d2", "doc", "at", "content"])


def _occurrences(batches: Iterable[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for b in batches:
        batch = Batch(b.column("text").to_pylist())
        p = batch.pieces(*shared.value)
        keys = np.array([_doc_key(w) for w in batch.words], np.int64)
        yield pa.record_batch([b.column("doc_id").take(pa.array(p["row"])), pa.array(keys[p["row"]]), pa.array(p["d1"]), pa.array(p["d2"]), pa.array(p["at"], pa.int32()), pa.array(p["count"], pa.int32())], ["doc_id", "doc_key", "d1", "d2", "at", "count"])


def first_places(contents: list[tuple[int, bytes, int, int]], window: int = WINDOW) -> list[np.ndarray | None]:
    """contents (key, words, doc, place of its first word) -> for each the (doc, place) where each of its windows first occurs in contents of its key; None where all do at their own places."""
    ids: dict[bytes, int] = {}
    words = [np.array([ids.setdefault(w, len(ids) + 1) for w in c.split(b" ")], np.int64) for _, c, _, _ in contents]
    key = [c[0] for c in contents]
    doc, at = np.array([c[2] for c in contents], np.int64), np.array([c[3] for c in contents], np.int64)
    out: list[np.ndarray | None] = [None] * len(contents)

    def found(i: int) -> np.ndarray:
        if out[i] is None:
            m = len(words[i]) - window + 1
            out[i] = np.column_stack([np.full(m, doc[i]), at[i] + np.arange(m)])
        return out[i]

    todo = [(i, 0, len(words[i])) for i in sorted(range(len(contents)), key=lambda i: (key[i], doc[i], at[i]))]
    take = 1
    while todo:
        indexed, streamed, rest = [], [], []
        for _, some in groupby(todo, key=lambda f: key[f[0]]):
            some = list(some)
            i, a, b = some[0]
            # A window twice in a text means that at least as many of its words stand there again.
            if len(some) > 1 or b - a - len(set(words[i][a:b].tolist())) >= window:
                indexed += some[:take]
                streamed += some[take:]
        index = FMIndex([words[i][a:b] for i, a, b in indexed], window)
        of, begin = np.array([f[0] for f in indexed], np.int64), np.array([f[1] for f in indexed], np.int64)

        def places(rank: np.ndarray) -> np.ndarray:
            who, where = index.place(rank)  # noqa: B023
            return np.column_stack([doc[of[who]], at[of[who]] + begin[who] + where])  # noqa: B023

        for (i, a, b), own, start in zip(indexed, index.own, index.starts.tolist(), strict=True):
            own = own[: b - a - window + 1]
            if (own != np.arange(start, start + len(own))).any():
                found(i)[a : b - window + 1] = places(own)
        length = np.array([b - a for _, a, b in streamed], np.int64)
        stops = np.cumsum(length)
        room = np.arange(stops[-1] if len(stops) else 0) - np.repeat(stops - length, length) + 1
        # Places before the end of a text's first window can't complete one.
        size, run = index.matching_statistics(np.concatenate([words[i][a:b] for i, a, b in streamed]) if streamed else np.zeros(0, np.int64), np.where(room >= window, room, 0))
        reached = size >= window
        earlier = places(index.first[run[reached]])
        upto = np.concatenate([[0], np.cumsum(reached)]).tolist()
        for (i, a, b), stop in zip(streamed, stops.tolist(), strict=True):
            begin_ = stop - (b - a) + window - 1
            again, low, high = reached[begin_:stop], upto[begin_], upto[stop]
            if low < high:
                found(i)[a : b - window + 1][again] = earlier[low:high]
            if high - low < stop - begin_:
                turns = np.flatnonzero(np.diff(np.concatenate([[True], again, [True]])))
                rest += [(i, a + x, a + y + window - 1) for x, y in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)]
        todo, take = rest, 2 * take
    return out


def _runs(places: np.ndarray) -> bytes:
    """(doc, place) of successive windows as runs: doc, first place, length."""
    cut = np.flatnonzero(np.concatenate([[True], (places[1:, 0] != places[:-1, 0]) | (places[1:, 1] != places[:-1, 1] + 1)]))
    return np.column_stack([places[cut], np.diff(np.concatenate([cut, [len(places)]]))]).astype("<i8").tobytes()


def _search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of rows sorted by key; the rows of a key stay together."""

    def answer(rows: list) -> pa.RecordBatch:
        first: dict[tuple[int, int], tuple] = {}
        for key, d1, d2, doc, at, content in rows:
            if (d1, d2) not in first or (doc, at) < first[d1, d2][2:]:
                first[d1, d2] = (key, content, doc, at)
        contents = list(first.values())
        own = lambda c: pack("<3q", c[2], c[3], c[1].count(b" ") + 2 - WINDOW)
        places = [own(c) if p is None else _runs(p) for c, p in zip(contents, first_places(contents), strict=True)]
        return pa.record_batch([pa.array([d[0] for d in first], pa.int64()), pa.array([d[1] for d in first], pa.int64()), pa.array(places, pa.binary())], ["d1", "d2", "places"])

    rows, size, key = [], 0, None
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("key", "d1", "d2", "doc", "at", "content")), strict=True):
            if size > SHARD_WORDS and row[0] != key:
                yield answer(rows)
                rows, size = [], 0
            key = row[0]
            rows.append(row)
            size += row[5].count(b" ") + 2
    if rows:
        yield answer(rows)


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows of each occurrence, a batch at a time."""
    for b in batches:
        raw = b.column("places").to_pylist()
        runs = np.frombuffer(b"".join(raw), "<i8").reshape(-1, 3)
        number = np.array([len(x) // 24 for x in raw], np.int64)
        at, count = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "count"))
        # Each run of first places against the occurrence's own.
        row = np.repeat(np.arange(len(raw)), number)
        ends = np.cumsum(runs[:, 2]) if len(runs) else np.zeros(0, np.int64)
        offset = ends - runs[:, 2] - np.repeat(np.cumsum(count) - count, number)
        doc = b.column("doc_id").to_numpy(zero_copy_only=False)
        again = (runs[:, 0] != doc[row]) | (runs[:, 1] != at[row] + offset)
        row, start, length = row[again], (at[row] + offset)[again], runs[again, 2]
        take = pa.array(row)
        yield pa.record_batch([b.column("doc_id").take(take), b.column("doc_key").take(take), pa.array(start, pa.int32()), pa.array(length, pa.int32())], ["doc_id", "doc_key", "at", "count"])


def _remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, removed, kept = [], [], []
        for text, runs in zip(b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True):
            words = (text or "").encode().split()
            keys.append(_doc_key(words))
            depth = np.zeros(len(words) + 1, np.int64)
            for r in runs:
                if r["doc_key"] == keys[-1]:
                    depth[r["at"]] += 1
                    depth[r["at"] + r["count"] + WINDOW - 1] -= 1
            gone = np.cumsum(depth)[:-1] > 0
            removed.append(int(gone.sum()))
            kept.append(b" ".join(compress(words, (~gone).tolist())).decode())
        yield pa.record_batch([b.column("doc_id"), pa.array(keys, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "doc_key", "n_removed", "kept"])


def find_repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scans, changed): every document's doc_id, n_words, sha, doc_key and whether a smaller doc_id has
    its words (copy); and doc_id, doc_key, n_removed, kept text of documents that may have lost words."""
    require_columns(docs, ["doc_id", "text"])
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scans = materialize(texts.mapInArrow(_scan, "doc_id long, n_words long, sha string, doc_key long, anchors array<long>, again array<long>, times array<long>"), "scans")
    # An anchor once more in the same text counts as seen in another one; of its segments there, each PER_TEXT count as one.
    seen = F.concat(F.zip_with("anchors", "times", lambda a, n: F.struct(a.alias("anchor"), F.col("doc_key").alias("k"), (F.floor((n - 1) / PER_TEXT) + 1).cast("long").alias("n"))), F.transform("again", lambda a: F.struct(a.alias("anchor"), F.bitwise_not("doc_key").alias("k"), F.lit(0).cast("long").alias("n"))))
    anchors = scans.select(F.explode(seen).alias("s")).groupBy("s.anchor").agg(F.min("s.k").alias("low"), F.max("s.k").alias("high"), F.sum("s.n").alias("n"))
    anchors = materialize(anchors.where("low <> high").select("anchor", (F.col("n") > FREQUENT).alias("often")), "anchors")
    shared = spark.sparkContext.broadcast((bit_table(anchors, FOUND_BITS), bit_table(anchors.where("often"), OFTEN_BITS)))
    shape = "key long, d1 long, d2 long, doc long, at int, content binary"
    contents = texts.mapInArrow(partial(_contents, shared=shared), shape)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    places = contents.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_search, "d1 long, d2 long, places binary")
    own = texts.mapInArrow(partial(_occurrences, shared=shared), "doc_id long, doc_key long, d1 long, d2 long, at int, count int")
    runs = own.join(places, ["d1", "d2"]).select("doc_id", "doc_key", "at", "count", "places").mapInArrow(_compare, "doc_id long, doc_key long, at int, count int")
    by_doc = runs.groupBy("doc_id").agg(F.collect_list(F.struct("doc_key", "at", "count")).alias("runs"))
    changed = texts.join(by_doc, "doc_id").mapInArrow(_remove, "doc_id long, doc_key long, n_removed long, kept string")
    long = scans.where(F.col("n_words") >= WINDOW).groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    # Rows of one text are spread by SALTS, and each class goes to all of its places.
    classes = long.where("first < last").select("sha", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    scans = scans.drop("anchors", "again", "times").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    scans = scans.join(classes, ["sha", "salt"], "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    return scans.drop("salt", "first"), changed.dropDuplicates(["doc_id", "doc_key"])


def dedup_report(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, n_words, n_removed, kept_sha256."""
    ids = IdSpace(docs)
    scans, changed = find_repeats(docs.select(ids.known().alias("doc_id"), "text"))
    changed = changed.select("doc_id", "doc_key", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha"))
    out = scans.join(changed, ["doc_id", "doc_key"], "left")
    return out.select(
        ids.given("doc_id").alias("doc_id"),
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), EMPTY).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    )


def dedup_texts(docs: DataFrame) -> DataFrame:
    """The documents with all their columns; where words were removed, text has the kept ones joined by spaces, and n_chars (if there) its length.

    Each text of a repeated doc_id is judged by itself; a null doc_id counts as larger than all others.
    """
    ids = IdSpace(docs)
    scans, changed = find_repeats(docs.select(ids.known().alias("doc_id"), "text"))
    copies = scans.where("copy").select("doc_id", "doc_key", F.lit("").alias("kept"))
    new = changed.where("n_removed > 0").select("doc_id", "doc_key", "kept").unionByName(copies).groupBy("doc_id", "doc_key").agg(F.min("kept").alias("kept"))
    id_, key_, kept = (fresh(docs, x) for x in ("changed_id", "changed_key", "kept_words"))
    new = new.select(F.col("doc_id").alias(id_), F.col("doc_key").alias(key_), F.col("kept").alias(kept))
    # doc_key is the first eight bytes, little-endian, of the hash of the words joined by spaces, as in _scan.
    sha = F.sha2(F.array_join(words("text"), " ").cast("binary"), 256)
    swapped = F.concat(*(F.substring(sha, i, 2) for i in range(15, 0, -2)))
    key = F.conv(swapped, 16, -10).cast("long")
    out = docs.join(new, (ids.known() == F.col(id_)) & (key == F.col(key_)), "left")
    change = {"text": F.coalesce(kept, "text")} | ({"n_chars": F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length(kept)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.withColumns(change).select(*own_columns(docs))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM rep, range(0, 20) t(j)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
