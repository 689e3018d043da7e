"""SimHash fingerprints and Hamming search by permuted block tables.

The terms of a text are its three-word shingles (with fewer words: all words as one), lower-cased
in A-Z, weighted 1 + log(frequency) to a 64th.  Each term's 128-bit hash votes with its weight on every bit; the
fingerprint has a bit where the votes are positive, 32 lowercase hex digits in all.  Likeness is
1 - Hamming distance / 128.

Fingerprints within a Hamming radius are found by block tables: of radius + 1 blocks two such
fingerprints agree in one at least, so each block in turn leads the key of a table.  Where more than HOT
fingerprints share a key, the rest of them is cut into blocks again, which is the same argument on what
is left, until a key holds at most HOT of them or fewer hex digits than blocks are left (then it holds
16 ** radius different ones at most); only such keys are compared within.  A key whose fingerprints
agree in an earlier block too is left out, as that block's key has them all.  The search runs on distinct
fingerprints, so copies of a text cost nothing.

Cases: null counts as empty text; a text without words has the zero fingerprint; the next
document of the last one is the first, so a lone document is its own next; rows that repeat a
doc_id are ordered by text; a null doc_id comes last; no documents give no rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial, reduce
from hashlib import sha256
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import materialize, require_columns, small_batches
from .components import connected_components

BITS, SHINGLE, RADIUS, HOT, SALTS = 128, 3, 3, 256, 16
PARTS = 4096  # ranges of doc_id at most; each bound is a literal of the plan
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """A 64-bit hash of each run of width words; of all words if they are fewer."""
    h = word_hashes(words)
    width = min(width, len(h))
    if not width:
        return h
    n = len(h) - width + 1
    out = h[:n].copy()
    for k in range(1, width):
        out = mix(out * _M1 + h[k : k + n])
    return mix(out + np.uint64(width))


def simhash(text: str) -> bytes:
    terms = shingle_hashes(text.encode().lower().split(), SHINGLE)
    if not len(terms):
        return bytes(BITS // 8)
    terms, counts = np.unique(terms, return_counts=True)
    # Whole numbers, so that the sums of a chunk are exact in any order and ties are ties.
    weights = np.rint(64 * (1 + np.log(counts))).astype(np.float32)
    votes = np.zeros(BITS, np.float64)
    for at in range(0, len(terms), 4096):
        t, w = terms[at : at + 4096], weights[at : at + 4096]
        both = np.stack([t, mix(t + _M1)], 1)
        bits = np.unpackbits(both.view(np.uint8).reshape(len(t), BITS // 8), axis=1).astype(np.float32)
        votes += 2 * (w @ bits).astype(np.float64) - float(w.sum())
    return np.packbits(votes > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    return 1 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / BITS


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many (or all) of the next text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a part in descending order, then a helper row: the first one of the next part."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held = None  # part, doc_id, text, fingerprint
    for b in batches:
        rows = []
        for part, helper, text, i in zip(b.column("part").to_pylist(), b.column("helper").to_pylist(), b.column("text").to_pylist(), range(b.num_rows), strict=True):
            text = text or ""
            if held is not None and held[0] != part:
                raise RuntimeError("a part without the row behind it")
            if helper and held is None:
                continue
            print_ = simhash(text)
            if held is not None:
                _, doc_id, own, mine = held
                other = edited(own, text)
                changed = simhash(other)
                rows.append((doc_id, len(own), sha256(other.encode()).hexdigest(), mine.hex(), changed.hex(), likeness(mine, changed), likeness(mine, print_)))
            held = None if helper else (part, b.column("doc_id")[i].as_py(), text, print_)
        if rows:
            cols = list(zip(*rows, strict=True))
            yield pa.record_batch([pa.array(cols[0], b.schema.field("doc_id").type), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.string()) for c in cols[2:5]), *(pa.array(c, pa.float64()) for c in cols[5:])], names)


def _part(doc_id: Column, bounds: list) -> Column:
    """Number of bounds under doc_id, in two steps of about sqrt(len(bounds)) comparisons each."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    fine = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda a: F.size(F.filter(a, lambda x: x < doc_id))
    group = F.greatest(below(F.array(*(F.lit(f[0]) for f in fine))) - 1, F.lit(0))
    inside = F.get(F.array(*(F.array(*map(F.lit, f)) for f in fine)), group)
    return F.when(doc_id.isNull(), 0).otherwise(group * step + below(inside)).cast("int")


def fingerprint_documents(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """documents -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_class.

    near_class is the smallest fingerprint linked with the document's own, steps being of at most
    ``radius`` bits.  Texts move once, to parts of doc_id ranges, as many as the input has; the first
    rows of each part are also sent to the part before it in the descending order.
    """
    return fingerprint_classes(materialize(_prints(docs), "prints"), radius)


def _prints(docs: DataFrame) -> DataFrame:
    require_columns(docs, ["doc_id", "text"])
    spark = docs.sparkSession
    small_batches(spark)
    parts = min(PARTS, max(1, docs.select("doc_id", "text").rdd.getNumPartitions()))
    ids = docs.select("doc_id")
    bounds = sorted(set(ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (8 * parts)) or [])) if parts > 1 else []
    bounds = [int(x) for x in bounds]
    # One row for each part: its largest doc_id.
    heads = [(r.part, r.head) for r in ids.groupBy(_part(F.col("doc_id"), bounds).alias("part")).agg(F.max("doc_id").alias("head")).orderBy("part").collect()]
    kind = docs.schema["doc_id"].dataType
    target = [(heads[i][1], heads[(i + 1) % len(heads)][0]) for i in range(len(heads))]
    helpers = spark.createDataFrame(target, "head long, extra int").withColumn("head", F.col("head").cast(kind))
    rows = docs.select("doc_id", "text", _part(F.col("doc_id"), bounds).alias("own")).join(F.broadcast(helpers), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    place = lambda part, helper: F.struct(part.alias("part"), F.lit(helper).alias("helper"))
    rows = rows.select("doc_id", "text", F.explode(F.array_compact(F.array(place(F.col("own"), 0), F.when(F.col("extra").isNotNull(), place(F.col("extra"), 1))))).alias("p")).select("doc_id", "text", "p.part", "p.helper")
    rows = rows.repartitionById(parts, "part").sortWithinPartitions("part", "helper", F.desc("doc_id"), F.desc("text"))
    return rows.mapInArrow(_stream, f"doc_id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def near_fingerprints(prints: DataFrame, column: str = "fingerprint", radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Pairs (a, b, distance) of different fingerprints within the Hamming radius, a < b."""
    length, blocks = BITS // 4, radius + 1
    if not 0 <= radius < length:
        raise ValueError(f"radius must be from 0 to {length - 1}")
    todo = prints.select(F.col(column).alias("f")).where("f IS NOT NULL").distinct().select("f", F.lit("").alias("key"), F.col("f").alias("rest"))
    word = lambda c, i: F.conv(F.substring(c, 8 * i + 1, 8), 16, 10).cast("long")
    distance = sum((F.bit_count(word(F.col("a"), i).bitwiseXOR(word(F.col("b"), i))) for i in range(BITS // 32)), F.lit(0))
    out = todo.select(F.col("f").alias("a"), F.col("f").alias("b"), F.lit(0).alias("distance")).where("false")
    for _ in range(length):
        size = length // blocks
        part = lambda i: F.substring("rest", i * size + 1, size)  # noqa: B023, E731
        cut = lambda i: F.struct(F.lit(i).alias("i"), F.concat("key", F.lit(f"{i}:"), part(i)).alias("key"), F.concat(F.substring("rest", 1, i * size), F.expr(f"substring(rest, {(i + 1) * size + 1})")).alias("rest"), F.array(*map(part, range(i))).cast("array<string>").alias("before"))  # noqa: B023, E731
        rows = materialize(todo.select("f", F.explode(F.array(*map(cut, range(blocks)))).alias("x")).select("f", "x.*"), "blocks")
        # A key whose rows also agree in an earlier block adds nothing: that block's key has all of them.
        same = [F.coalesce(F.min(F.get("before", F.lit(j))) == F.max(F.get("before", F.lit(j))), F.lit(False)) for j in range(blocks - 1)]
        keys = rows.groupBy("key").agg(F.count("*").alias("n"), reduce(or_, same, F.lit(False)).alias("again")).where("n > 1 AND NOT again")
        rows = rows.join(keys.drop("again"), "key")
        length -= size
        # With fewer digits left than blocks, at most 16 ** radius different fingerprints share a key.
        last = length < blocks
        few = rows if last else rows.where(F.col("n") <= hot)
        pairs = few.select(F.col("f").alias("a"), "key").join(few.select(F.col("f").alias("b"), "key"), "key").where("a < b").withColumn("distance", distance)
        out = out.unionByName(pairs.where(F.col("distance") <= radius).select("a", "b", "distance"))
        todo = rows.where(F.col("n") > hot).select("f", "key", "rest")
        if last or todo.isEmpty():
            break
    return out.distinct()


def fingerprint_classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints (with fingerprint) and near_class: the smallest fingerprint linked within the radius."""
    found = connected_components(near_fingerprints(prints, radius=radius)).select(F.col("node").alias("fingerprint"), F.col("component").alias("found"))
    # Rows of one fingerprint are spread by SALTS, and each class goes to all of its places.
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = prints.withColumn("salt", F.pmod(F.xxhash64("edited_sha256" if "edited_sha256" in prints.columns else "doc_id"), F.lit(SALTS)).cast("int"))
    return salted.join(found, ["fingerprint", "salt"], "left").select(*prints.columns, F.coalesce("found", "fingerprint").alias("near_class"))
