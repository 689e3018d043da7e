"""Packing documents into sequences by the linear grouping scheme.

Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the driver.  There,
large lengths are put in groups of equal cardinality and rounded up to the largest of their group,
few-size configurations are optimised by column generation, actual lengths are substituted in runs,
and the remaining and small pieces go best-fit into the open sequences, runs of equal sequences at
a time.  The plan says for each length which ranks go where; its size depends on the capacity
and the number of groups, not on the documents.  Documents find their place by their rank among
the pieces of their length, counted per block of rows and summed over blocks.

Cases: null or empty text is a piece of the end id alone; a document longer than the capacity is
cut into full pieces behind a first one that may be shorter; rows that repeat a doc_id are packed
each; no documents give no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, require_columns, small_batches
from .tokens import encoder


def knapsack(capacity: int, sizes: list[int], values: list[float]) -> tuple[float, list[int]]:
    """The most valuable configuration: how often each size is taken."""
    best, picks = np.zeros(capacity + 1), []
    for s, v in zip(sizes, values, strict=True):
        new, how = best.copy(), np.zeros(capacity + 1, np.int16)
        if v > 1e-12:
            for m in range(1, capacity // s + 1):
                other = best[: capacity + 1 - m * s] + m * v
                better = other > new[m * s :] + 1e-12
                new[m * s :][better] = other[better]
                how[m * s :][better] = m
        best = new
        picks.append(how)
    at, counts = capacity, [0] * len(sizes)
    for k in range(len(sizes) - 1, -1, -1):
        counts[k] = int(picks[k][at])
        at -= counts[k] * sizes[k]
    return float(best[capacity]), counts


def configurations(capacity: int, sizes: list[int], demand: list[int], rounds: int = 400) -> list[tuple[list[int], int]]:
    """Configurations with whole multiplicities that meet most of the demand: column generation, rounded down."""
    k = len(sizes)
    columns = [[capacity // s if i == j else 0 for i in range(k)] for j, s in enumerate(sizes)]
    basis, d = np.array(columns, float).T, np.array(demand, float)
    columns = [list(c) for c in columns]
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(k))
        value, counts = knapsack(capacity, sizes, prices.tolist())
        if value <= 1 + 1e-6:
            break
        x, direction = np.linalg.solve(basis, d), np.linalg.solve(basis, np.array(counts, float))
        ratio = np.where(direction > 1e-9, np.maximum(x, 0) / np.where(direction > 1e-9, direction, 1), np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        basis[:, leave] = counts
        columns[leave] = counts
    x = np.linalg.solve(basis, d)
    return [(c, int(m + 1e-6)) for c, m in zip(columns, x, strict=True) if m >= 1 - 1e-6]


class Plan:
    """Runs of equal sequences with room, and where the ranks of each length go."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.rank: dict[int, int] = defaultdict(int)
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, first rank, first sequence, pieces in each, offset
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, sequences)
        self.rooms: list[int] = []

    def new(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def leave(self, room: int, first: int, count: int) -> None:
        if room and count:
            if not self.open[room]:
                insort(self.rooms, room)
            self.open[room].append((first, count))

    def put(self, length: int, first: int, count: int, each: int, offset: int) -> None:
        self.rows.append((length, self.rank[length], first, each, offset))
        self.rank[length] += count * each

    def best_fit(self, length: int, count: int) -> None:
        while count:
            i = bisect_left(self.rooms, length)
            if i == len(self.rooms):
                each = self.capacity // length
                whole = count // each or 1
                self.leave(self.capacity, self.new(whole), whole)
                continue
            room = self.rooms[i]
            first, n = self.open[room].pop()
            if not self.open[room]:
                self.rooms.pop(i)
            each = min(room // length, count)
            used = min(n, count // each)
            self.put(length, first, used, each, self.capacity - room)
            self.leave(room - each * length, first, used)
            self.leave(room, first + used, n - used)
            count -= used * each


def make_plan(histogram: dict[int, int], capacity: int, groups: int = 96, small: int = 4, shares: tuple[float, ...] = (1.0, 0.75, 0.5, 0.25)) -> Plan:
    """Place every length of the histogram; lengths over capacity / small are large.

    Rounding up leaves room that only small pieces can fill.  Where they are too few, giving
    the configurations a smaller share of the large pieces, and best-fit the rest, takes fewer
    sequences; so the plan with the fewest sequences over ``shares`` is taken.
    """
    large = [(n, histogram[n]) for n in sorted(histogram, reverse=True) if capacity // small < n < capacity]
    total = sum(c for _, c in large)
    members: list[list[tuple[int, int]]] = [[] for _ in range(groups)]
    seen = 0
    for n, c in large:
        while c:
            g = min(groups - 1, seen * groups // total)
            take = min(c, -(-(g + 1) * total // groups) - seen)
            members[g].append((n, take))
            seen += take
            c -= take
    members = [m for m in members if m]
    found = configurations(capacity, [m[0][0] for m in members], [sum(c for _, c in m) for m in members]) if total >= 4 * groups else []
    bound = -(-sum(n * c for n, c in histogram.items()) // capacity)
    best = None
    for share in shares if found else (0.0,):
        plan = _substitute(histogram, capacity, members, [(c, int(t * share)) for c, t in found])
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences == bound:
            break
    return best


def _substitute(histogram: dict[int, int], capacity: int, groups: list[list[tuple[int, int]]], found: list[tuple[list[int], int]]) -> Plan:
    """Actual lengths into the configurations, all others best-fit in descending order."""
    plan, left, members = Plan(capacity), dict(histogram), [[list(x) for x in m] for m in groups]
    for counts, times in found:
        slots = [k for k, c in enumerate(counts) for _ in range(c)]
        done = 0
        while done < times:
            # As far as all slots keep the length they now have; an exhausted group leaves its slot open.
            heads = [(members[k][0][1], slots.count(k)) for k in dict.fromkeys(slots) if members[k]]
            run = min([times - done, *(max(1, n // c) for n, c in heads)])
            first, offset = plan.new(run), 0
            for k in slots:
                if members[k]:
                    n = members[k][0][0]
                    plan.put(n, first, run, 1, offset)
                    offset += n
                    left[n] -= run
                    members[k][0][1] -= run
                    if not members[k][0][1]:
                        members[k].pop(0)
            plan.leave(capacity - offset, first, run)
            done += run
    for n in sorted(left, reverse=True):
        plan.best_fit(n, left[n])
    return plan


def _pieces(batches: Iterable[pa.RecordBatch], tokenizer: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    enc, part = encoder(tokenizer), TaskContext.get().partitionId()
    end, wide = np.array([end_id], "<u4").tobytes(), 4 * capacity
    for b in batches:
        rows, piece, start, length, crc = [], [], [], [], []
        for r, raw in enumerate(enc.encode_many(b.column(1).to_pylist())):
            raw += end
            cuts = [0, *range(len(raw) % wide or min(wide, len(raw)), len(raw) + 1, wide)]
            for i, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                rows.append(r), piece.append(i), start.append(x // 4), length.append((y - x) // 4), crc.append(zlib.crc32(raw[x:y]))
        ids = b.column(0).take(pa.array(rows, pa.int64()))
        yield pa.record_batch([ids, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([part] * len(rows), pa.int32())], ["doc_id", "piece", "start", "length", "ids_crc32", "block"])


def _place(batches: Iterable[pa.RecordBatch], plan) -> Iterator[pa.RecordBatch]:
    keys, first, each, offset = plan.value
    for b in batches:
        length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
        key = (length.astype(np.int64) << 42) + rank
        at = np.searchsorted(keys, key, "right") - 1
        nth = key - keys[at]
        sequence, place = first[at] + nth // each[at], offset[at] + nth % each[at] * length
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence, pa.int64()), pa.array(place, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, groups: int = 96) -> DataFrame:
    """documents -> doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    require_columns(docs, ["doc_id", "text"])
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = docs.select("doc_id", "text").mapInArrow(partial(_pieces, tokenizer=tokenizer, end_id=end_id, capacity=capacity), f"{shape}, block int")
    pieces = materialize(pieces, "pieces")
    counts = pieces.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    counts = materialize(counts.select("length", "block", "n", F.coalesce(before, F.lit(0)).alias("before")), "counts")
    # At most one row for each length.
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = make_plan(histogram, capacity, groups)
    rows = sorted(((n << 42) + rank, first, each, offset) for n, rank, first, each, offset in plan.rows)
    table = spark.sparkContext.broadcast(tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4)
    inside = F.row_number().over(Window.partitionBy("block", "length").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = pieces.withColumn("nth", inside.cast("long")).join(counts.drop("n"), ["block", "length"]).withColumn("rank", F.col("before") + F.col("nth") - 1)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(partial(_place, plan=table), f"{shape}, sequence_id long, offset long")
