"""MinHash near-duplicate detection by an LSH forest, links confirmed on full shingle sets.

A document's set holds the 64-bit hashes of its distinct five-word shingles, A-Z lower-cased.
Equal sets form a class, represented by its smallest doc_id.  Representatives get 128 minhash values;
each of TREES sorted orders reads PATH of them in its own sequence.  Rows whose first FIRST values
are shared in an order are put in that order across the cluster.  A region of equal prefixes of
at most REGION rows gives all its pairs as candidates; a larger one goes on to the next depth, its
rows are compared with their next neighbours in the order (the longest common prefixes) and with
the region's HUBS most central rows, which finds groups around one original.  Candidates with an
estimated similarity of at least the threshold less SLACK (over four standard deviations) are
confirmed on the full sets: first a spanning forest of each region, likeliest first.  Then links
between the groups found so far are looked for in each region that holds more than one: all pairs in
regions of at most REGION rows, and for the rows of larger ones an exact join (exact_pairs): with
shingles in one order, rarest first, two sets that are linked share one of their first few, so no
number of rows, hubs or depth bounds what is found.  What can be missed is a pair that shares no
region in any of the orders, (1 - s ** FIRST) ** TREES at similarity s: 4e-7 at 0.85.  A group of n
near copies costs about n comparisons.

Small regions are dealt whole, by key.  Larger ones are cut by range, so no group lands in one task; the
most central rows of all pieces of a region are its hubs in each of them, so a group around one
original is found whichever piece the original is in.

Cases: null or empty text has the empty set and is linked with nothing; a text of fewer than
five words has one shingle; rows that repeat a doc_id count as one document with a set for each
text; a null doc_id ranks behind all others (rows of one text count as one document), and a component
of null ids alone has a null component_id; no documents give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IdSpace, fresh, materialize, require_columns, small_batches, text_key
from .components import connected_components
from .fingerprints import shingle_hashes

HASHES, TREES, FIRST, PATH, SHINGLE = 128, 20, 4, 10, 5
REGION, NEIGHBOURS, HUBS, SAMPLE = 64, 32, 16, 64
SLACK = 0.15
CHUNK, PIECE, BUCKETS = 256, 20_000, 1 << 20
BROADCAST_IDS, BROADCAST_SETS = 1_000_000, 64 << 20
_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(1, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, HASHES, np.uint32)
_ORDERS = np.stack([_RNG.permutation(HASHES)[:PATH] for _ in range(TREES)])


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes((text or "").encode().lower().split(), SHINGLE))


def signature(shingles: np.ndarray) -> np.ndarray:
    """128 minhash values of 32 bits, by linear maps of the hashes' upper halves."""
    upper = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    best = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(upper), 512):
        np.minimum(best, (upper[at : at + 512] * _A + _B).min(0), out=best)
    return best


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, digests, signatures, keys = [], [], [], []
        for text in b.column(1).to_pylist():
            s = shingle_set(text)
            sizes.append(len(s))
            digests.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sig = signature(s)
            signatures.append(sig.tobytes() if len(s) else None)
            keys.append([int.from_bytes(blake2b(bytes([t]) + sig[o[:FIRST]].tobytes(), digest_size=8).digest(), "little", signed=True) for t, o in enumerate(_ORDERS)] if len(s) else [])
        yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "signature", "keys"])


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingle_set(t) for t in b.column(1).to_pylist()]
        yield pa.record_batch([b.column(0), pa.array([blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()), b.column(2)], ["doc_id", "digest", "key"])


def _estimate(sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for at in range(0, len(i), 8192):
        out[at : at + 8192] = (sig[i[at : at + 8192]] == sig[j[at : at + 8192]]).mean(1)
    return out


def region_pairs(path: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (row numbers) among rows sorted by path that share its first FIRST values."""
    left, right = [], []

    def add(i: np.ndarray, j: np.ndarray) -> None:
        left.append(np.minimum(i, j)), right.append(np.maximum(i, j))

    todo = [(0, len(path), FIRST)]
    while todo:
        a, b, depth = todo.pop()
        n = b - a
        if n < 2:
            continue
        if n <= REGION:
            i, j = np.triu_indices(n, 1)
            add(a + i, a + j)
            continue
        rows = np.arange(a, b)
        for k in range(1, NEIGHBOURS + 1):
            add(rows[:-k], rows[k:])
        some = rows[np.linspace(0, n - 1, SAMPLE).astype(int)]
        central = np.zeros(n)
        for s in some:
            for at in range(a, b, 8192):
                central[at - a : at - a + 8192] += (sig[at : min(b, at + 8192)] == sig[s]).mean(1)
        for hub in a + np.argsort(-central, kind="stable")[:HUBS]:
            others = rows[rows != hub]
            add(np.full(n - 1, hub), others)
        if depth < PATH:
            cuts = np.flatnonzero(path[a + 1 : b, depth] != path[a : b - 1, depth]) + a + 1
            if len(cuts):
                todo += [(x, y, depth + 1) for x, y in zip([a, *cuts], [*cuts, b], strict=True)]
    if not left:
        return np.zeros(0, int), np.zeros(0, int)
    both = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
    return both[:, 0], both[:, 1]


def _spanning(ids: np.ndarray, i: np.ndarray, j: np.ndarray, est: np.ndarray) -> np.ndarray:
    """The candidates of a spanning forest, likeliest first; equally likely ones by their ids, so that the orders choose alike."""
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = np.zeros(len(i), bool)
    a, b = ids[i], ids[j]
    for k in np.lexsort((np.maximum(a, b), np.minimum(a, b), -est)):
        x, y = find(i[k]), find(j[k])
        if x != y:
            parent[x] = y
            keep[k] = True
    return keep


def _forest(batches: Iterable[pa.RecordBatch], least: float, between: bool = False, sets=None, percent: int = 0) -> Iterator[pa.RecordBatch]:
    """Candidates of each region in a sorted part of an order: a spanning forest, or all between the groups found so far."""

    def pairs(rows: list) -> pa.RecordBatch | None:
        if len(rows) < 2:
            return None
        ids = np.array([r[0] for r in rows])
        path = np.stack([np.frombuffer(r[1], ">u4") for r in rows])
        sig = np.stack([np.frombuffer(r[2], np.uint8) for r in rows])
        i, j = region_pairs(path, sig)
        est = _estimate(sig, i, j)
        likely = est >= least
        i, j, est = i[likely], j[likely], est[likely]
        if between:
            group = np.array([r[3] for r in rows])
            keep = group[i] != group[j]
            if sets is not None:
                if not known:
                    for doc, data in sets.value:
                        known.setdefault(doc, []).append(np.frombuffer(data, "<u8"))
                for k in np.flatnonzero(keep):
                    pair = (min(ids[i[k]], ids[j[k]]), max(ids[i[k]], ids[j[k]]))
                    if pair not in judged:
                        if len(judged) > 1_000_000:
                            judged.clear()
                        judged[pair] = any(_linked(x, y, percent) for x in known[pair[0]] for y in known[pair[1]])
                    keep[k] = judged[pair]
        else:
            keep = _spanning(ids, i, j, est)
        a, b = ids[i[keep]], ids[j[keep]]
        return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"]) if keep.any() else None

    key, rows, known, judged = None, [], {}, {}
    for b in batches:
        for k, doc, path, sig, group in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "path", "signature", "group")), strict=True):
            # A very large region is taken in pieces; the neighbours of a piece go on into the next one.
            if k != key or len(rows) >= PIECE:
                if (out := pairs(rows)) is not None:
                    yield out
                rows = rows[-NEIGHBOURS:] if k == key else []
                key = k
            rows.append((doc, path, sig, group))
    if (out := pairs(rows)) is not None:
        yield out


def _hubs(batches: Iterable[pa.RecordBatch], piece: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The HUBS most central rows of each piece of a region in a sorted part."""
    key, rows = None, []

    def central() -> pa.RecordBatch:
        sig = np.stack([np.frombuffer(s, np.uint8) for _, s in rows])
        score = np.zeros(len(rows))
        some = np.unique(np.linspace(0, len(rows) - 1, SAMPLE).astype(int))
        for at in some:
            score += (sig == sig[at]).mean(1)
        best = np.argsort(-score, kind="stable")[:HUBS]
        return pa.record_batch([pa.array([key] * len(best), pa.int64()), pa.array([rows[i][0] for i in best], pa.int64()), pa.array([rows[i][1] for i in best], pa.binary()), pa.array(score[best] / len(some))], ["key", "doc_id", "signature", "score"])

    for b in batches:
        for k, doc, sig in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "signature")), strict=True):
            if rows and (k != key or len(rows) >= piece):
                yield central()
                rows = []
            key = k
            rows.append((doc, sig))
    if rows:
        yield central()


def _nearest_hub(batches: Iterable[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Each row with the hub of its region that is likest to it."""
    for b in batches:
        left, right = [], []
        for doc, sig, hubs in zip(*(b.column(c).to_pylist() for c in ("doc_id", "signature", "hubs")), strict=True):
            if hubs := [h for h in hubs if h["doc_id"] != doc]:
                est = (np.stack([np.frombuffer(h["signature"], np.uint8) for h in hubs]) == np.frombuffer(sig, np.uint8)).mean(1)
                if est.max() >= least:
                    other = hubs[int(est.argmax())]["doc_id"]
                    left.append(min(doc, other)), right.append(max(doc, other))
        yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def _paths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path in an order, and a byte of each minhash value for the estimate."""
    for b in batches:
        path, short = [], []
        for t, s in zip(b.column("tree").to_pylist(), b.column("signature").to_pylist(), strict=True):
            sig = np.frombuffer(s, "<u4")
            path.append(sig[_ORDERS[t]].astype(">u4").tobytes())
            short.append(sig.astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("doc_id"), pa.array(path, pa.binary()), pa.array(short, pa.binary()), b.column("large")], ["key", "doc_id", "path", "signature", "large"])


def _sets(batches: Iterable[pa.RecordBatch], ids=None) -> Iterator[pa.RecordBatch]:
    wanted = None if ids is None else ids.value
    for b in batches:
        if wanted is not None:
            at = b.column(0).to_numpy(zero_copy_only=False)
            place = np.minimum(np.searchsorted(wanted, at), max(0, len(wanted) - 1))
            b = b.filter(pa.array(wanted[place] == at if len(wanted) else np.zeros(len(at), bool)))
        yield pa.record_batch([b.column(0), pa.array([shingle_set(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "set"])


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(x), len(y)))
    if 100 * small < percent * large:  # they share too little whatever they hold
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        linked = [_linked(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), percent) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
        out = pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"])
        yield out.filter(pa.array(linked, pa.bool_()))


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows of large regions put in their orders across the cluster."""
    salt = F.xxhash64("key", "doc_id")
    return rows.repartitionByRange("key", "path", salt).sortWithinPartitions("key", "path", salt)


def _whole(rows: DataFrame) -> DataFrame:
    """Rows of regions of at most REGION rows, each region in one part."""
    return rows.repartition("key").sortWithinPartitions("key", "path", F.xxhash64("key", "doc_id"))


def hub_pairs(rows: DataFrame, least: float, piece: int = PIECE) -> DataFrame:
    """Pairs (a, b) of each row of a region in several pieces with the likest of the region's hubs."""
    hubs = _in_order(rows).mapInArrow(partial(_hubs, piece=piece), "key long, doc_id long, signature binary, score double")
    best = F.slice(F.sort_array(F.collect_list(F.struct("score", "doc_id", "signature")), asc=False), 1, HUBS)
    # A single piece gives HUBS rows at most, and its rows meet its hubs there.
    hubs = hubs.groupBy("key").agg(F.count("*").alias("n"), best.alias("hubs")).where(f"n > {HUBS}").select("key", "hubs")
    return rows.join(hubs, "key").select("doc_id", "signature", "hubs").mapInArrow(partial(_nearest_hub, least=least), "a long, b long")


def _candidates(small: DataFrame, find, *others: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) that find gives for small regions, and those of others."""
    pairs = _whole(small).mapInArrow(find, "a long, b long")
    for other in others:
        pairs = pairs.unionByName(other)
    return materialize(pairs.where("a < b").distinct(), "candidates")


def _set_table(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, set of the given documents."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:  # at most 8 MB; texts need not move
        wanted = np.sort(np.array(ids.toArrow().column(0).to_numpy(), np.int64))
        sets = texts.mapInArrow(partial(_sets, ids=texts.sparkSession.sparkContext.broadcast(wanted)), "doc_id long, set binary")
    else:
        sets = texts.join(ids, "doc_id").mapInArrow(_sets, "doc_id long, set binary")
    return materialize(sets, "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are linked on their full sets."""
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(partial(_confirm, percent=percent), "a long, b long")


def _bucket_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often the shingles of each of BUCKETS buckets occur in a part."""
    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        each = np.frombuffer(b"".join(b.column("set").to_pylist()), "<u8")
        total += np.bincount((each % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])


def _posts(batches: Iterable[pa.RecordBatch], often, percent: int) -> Iterator[pa.RecordBatch]:
    """The first shingles of each set, rarest buckets first; those alone in their bucket only take places."""
    names, table = ["shingle", "doc_id", "group", "n", "at"], often.value
    for b in batches:
        found, sizes, at, rows = [], [], [], []
        for raw in b.column("set").to_pylist():
            s = np.frombuffer(raw, "<u8")
            n = len(s)
            count = table[(s % np.uint64(BUCKETS)).astype(np.int64)]
            first = np.lexsort((s, count))[: n - (n * percent + 99) // 100 + 1 if n else 0]
            place = np.flatnonzero(count[first] > 1)
            found.append(s[first[place]].view(np.int64)), at.append(place), sizes.append(np.full(len(place), n)), rows.append(len(place))
        row = np.repeat(np.arange(b.num_rows), rows)
        cat = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([cat(found), b.column("doc_id").take(pa.array(row)), b.column("group").take(pa.array(row)), cat(sizes), cat(at)], names)


def exact_pairs(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) among which are all links between different groups: sets (doc_id, set), groups (doc_id, group).

    A set of n shingles shares at least percent * n / 100 of them with any set it is linked with, so
    the first shared one stands in the first n - need + 1 of both sets, in any common order.  The
    order is that of a table of shingle counts by BUCKETS hash buckets, rare ones first, whose size
    does not depend on the input.  Only shingles of more than one group are joined, and of each only
    the rows outside its commonest group with all others, so a large group costs its rows once for
    each stranger and not their square.  A frequent shingle is dealt to several tasks by its rows.
    """
    s = materialize(sets.distinct().join(groups, "doc_id").select("doc_id", "group", "set"), "grouped_sets")
    counts = s.select("set").mapInArrow(_bucket_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(BUCKETS, np.int64)
    table[counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    often = sets.sparkSession.sparkContext.broadcast(table)
    posts = materialize(s.mapInArrow(partial(_posts, often=often, percent=percent), "shingle long, doc_id long, group long, n long, at long"), "posts")
    shared = posts.groupBy("shingle", "group").agg(F.count("*").alias("k")).groupBy("shingle").agg(F.sum("k").alias("often"), F.max_by("group", F.struct("k", "group")).alias("main"), F.count("*").alias("groups"))
    shared = shared.where("groups > 1").select("shingle", "main", F.expr(f"(often + {CHUNK - 1}) div {CHUNK}").alias("chunks"))
    mixed = materialize(posts.join(shared, "shingle"), "mixed_posts")
    x = mixed.select("shingle", F.pmod(F.xxhash64("doc_id", "n"), F.col("chunks")).alias("chunk"), "doc_id", "group", "n", "at")
    y = mixed.where("group <> main").select("shingle", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), *(F.col(c).alias(f"{c}_y") for c in ("doc_id", "group", "n", "at")))
    fits = f"100 * least(n, n_y) >= {percent} * greatest(n, n_y) AND {100 + percent} * least(n - at, n_y - at_y) >= {percent} * (n + n_y)"
    both = x.join(y, ["shingle", "chunk"]).where(f"group <> group_y AND doc_id <> doc_id_y AND {fits}")
    return both.select(F.least("doc_id", "doc_id_y").alias("a"), F.greatest("doc_id", "doc_id_y").alias("b")).distinct()


def near_components(docs: DataFrame, percent: int = 85) -> DataFrame:
    """documents -> doc_id, n_shingles, component_id, kept, in links of 100 * intersection >= percent * union."""
    ids = IdSpace(docs)
    out = _components(docs.select(ids.known().alias("doc_id"), "text"), percent)
    return out.select(ids.given("doc_id").alias("doc_id"), "n_shingles", ids.given("component_id").alias("component_id"), "kept")


def _components(docs: DataFrame, percent: int) -> DataFrame:
    """near_components with the digest of each row's set."""
    require_columns(docs, ["doc_id", "text"])
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = texts.mapInArrow(_sketch, "doc_id long, n_shingles long, digest binary, signature binary, keys array<long>")
    sketches = materialize(sketches, "sketches")
    first = sketches.where("digest IS NOT NULL").groupBy("digest").agg(F.min_by(F.struct("doc_id", "keys"), "doc_id").alias("f"))
    first = materialize(first.select("digest", F.col("f.doc_id").alias("rep"), F.col("f.keys").alias("keys")), "classes")
    classes = first.select("digest", "rep")
    places = first.select("digest", F.col("rep").alias("doc_id"), F.posexplode("keys").alias("tree", "key"))
    shared = places.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", (F.col("n") > REGION).alias("large"))
    rows = places.join(shared, "key").join(sketches.select("doc_id", "digest", "signature"), ["doc_id", "digest"]).select("tree", "key", "doc_id", "signature", "large")
    rows = materialize(rows.mapInArrow(_paths, "key long, doc_id long, path binary, signature binary, large boolean"), "rows")
    least = percent / 100 - SLACK
    alone = rows.withColumn("group", F.lit(0).cast("long"))
    large, spanning = alone.where("large"), partial(_forest, least=least)
    first = _candidates(alone.where("NOT large"), spanning, _in_order(large).mapInArrow(spanning, "a long, b long"), hub_pairs(large, least))
    links = _confirmed(first, _set_table(texts, first.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()), percent)
    links = materialize(links, "links")
    # Regions that hold more than one group go through again, for links between groups.
    groups = connected_components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("c"))
    grouped = rows.join(groups, "doc_id", "left").select(*rows.columns, F.coalesce("c", "doc_id").alias("group"))
    mixed = grouped.groupBy("key").agg(F.min("group").alias("x"), F.max("group").alias("y")).where("x <> y").select("key")
    mixed = materialize(grouped.join(mixed, "key", "left_semi"), "mixed")
    small, large = mixed.where("NOT large"), mixed.where("large").select("doc_id", "group").distinct()
    sets = _set_table(texts, small.select("doc_id").distinct())
    if (sets.agg(F.sum(F.octet_length("set"))).head()[0] or 0) <= BROADCAST_SETS:
        # Sets of that bounded size go along, and tasks confirm candidates as they find them.
        table = sets.toArrow()
        known = spark.sparkContext.broadcast(list(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True)))
        more = _candidates(small, partial(_forest, least=least, between=True, sets=known, percent=percent))
    else:
        more = _confirmed(_candidates(small, partial(_forest, least=least, between=True)), sets, percent)
    if not large.isEmpty():
        sets = _set_table(texts, large.select("doc_id"))
        pairs = materialize(exact_pairs(sets, large, percent), "pairs")
        more = more.unionByName(_confirmed(pairs, sets, percent))
    groups = connected_components(links.unionByName(more)).withColumnRenamed("node", "rep")
    named = classes.join(groups, "rep", "left").select("digest", F.coalesce("component", "rep").alias("c"))
    out = sketches.select("doc_id", "n_shingles", "digest").join(named, "digest", "left").withColumn("component_id", F.coalesce("c", "doc_id"))
    return out.select("doc_id", "digest", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The documents, all their columns as they are, that represent their component.

    Each text of a repeated doc_id is judged by its own set; texts of one doc_id in one component stay
    together.  A null doc_id ranks behind all others, and its rows of one text count as one document.
    """
    ids = IdSpace(docs)
    known = docs.select(ids.known().alias("doc_id"), "text", text_key().alias("_key"))
    # Rows that go are few; their sets are told by digest, and texts are matched to them by id and key.
    judged = _components(known, percent).where("NOT kept").select("doc_id", "digest").distinct()
    small_batches(docs.sparkSession)
    maybe = known.join(judged.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_digests, "doc_id long, digest binary, key string")
    id_, key_ = fresh(docs, "gone_id"), fresh(docs, "gone_key")
    gone = maybe.join(judged, ["doc_id", "digest"], "left_semi").select(F.col("doc_id").alias(id_), F.col("key").alias(key_)).distinct()
    return docs.join(gone, (ids.known() == F.col(id_)) & (text_key() == F.col(key_)), "left_anti")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
often AS MATERIALIZED (SELECT doc_id, k FROM s WHERE k IN (SELECT k FROM s GROUP BY k HAVING count(*) > 1)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM often a JOIN often b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT DISTINCT a AS node, a AS other FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT node, min(other) AS component FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component, w.doc_id) AS component_id, coalesce(component, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON node = w.doc_id
"""
