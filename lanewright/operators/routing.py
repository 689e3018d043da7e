"""Shortest paths, assignment and components on directed graphs.

A road graph is bounded (a country's is a few hundred MB), so it is broadcast as arrays behind a
check of its size, and searches run in parallel by origin. Beyond ``MAX_EDGES`` searches run as
relaxations of DataFrames instead.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.session import ensure_checkpoints

from .flows import best_parallel, msa_step

MAX_EDGES = 20_000_000


class Graph:
    """Adjacency in arrays; nodes and edge ids as they are in the table."""

    def __init__(self, edges, cost: str):
        edges = edges.sort_values(["u", "v", cost, "edge_id"], kind="stable")
        self.nodes = np.array(sorted(set(edges["u"]) | set(edges["v"])), dtype=object)
        place = {n: i for i, n in enumerate(self.nodes)}
        self.place = place
        u = edges["u"].map(place).to_numpy(np.int64)
        order = np.argsort(u, kind="stable")
        self.head = np.searchsorted(u[order], np.arange(len(self.nodes) + 1))
        self.to = edges["v"].map(place).to_numpy(np.int64)[order]
        self.cost = edges[cost].to_numpy(float)[order]
        self.edge = edges["edge_id"].to_numpy(object)[order]

    def search(self, origin, targets: Iterable) -> dict:
        """target -> (cost, node ids, edge ids), for targets that can be reached; ties go to the smaller place."""
        start = self.place.get(origin)
        wanted = {self.place[t] for t in targets if t in self.place}
        out: dict = {}
        if start is None:
            return out
        best, via, done, heap = {start: 0.0}, {}, set(), [(0.0, start)]
        while heap and wanted:
            d, x = heapq.heappop(heap)
            if x in done:
                continue
            done.add(x)
            if x in wanted:
                wanted.discard(x)
                nodes, edges, y = [x], [], x
                while y != start:
                    e, y = via[y]
                    edges.append(self.edge[e])
                    nodes.append(y)
                out[self.nodes[x]] = (d, [self.nodes[i] for i in reversed(nodes)], edges[::-1])
            for e in range(self.head[x], self.head[x + 1]):
                y, c = int(self.to[e]), d + self.cost[e]
                if c < best.get(y, np.inf):
                    best[y] = c
                    via[y] = (e, x)
                    heapq.heappush(heap, (c, y))
        return out


def load_graph(edges: DataFrame, cost: str = "cost") -> Graph:
    """The broadcastable graph; the number of edges is checked first."""
    kept = best_parallel(edges.select("u", "v", "edge_id", cost), cost)
    n = kept.count()
    if n > MAX_EDGES:
        raise ValueError(f"{n} edges are too many to broadcast; use relax()")
    return Graph(kept.select("u", "v", "edge_id", cost).toPandas(), cost)


PATH = "origin string, destination string, cost double, node_ids array<string>, edge_ids array<string>"


def shortest_paths(edges: DataFrame, pairs: DataFrame, cost: str = "cost") -> DataFrame:
    """pairs (origin, destination) -> their cheapest paths; pairs without a path are not there.

    One search serves all destinations of an origin; origins are spread over tasks, and a hot origin's
    destinations are split among several searches.
    """
    spark = pairs.sparkSession
    graph = spark.sparkContext.broadcast(load_graph(edges, cost))
    salt = F.pmod(F.xxhash64("destination"), F.lit(4))
    wanted = pairs.select(F.col("origin").cast("string").alias("origin"), F.col("destination").cast("string").alias("destination")).distinct()
    grouped = wanted.groupBy("origin", salt.alias("salt")).agg(F.collect_list("destination").alias("targets"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = graph.value
        for b in batches:
            rows = [(o, t, c, n, e) for o, targets in zip(b.column("origin").to_pylist(), b.column("targets").to_pylist(), strict=True) for t, (c, n, e) in g.search(o, targets).items()]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.list_(pa.string())), pa.array(cols[4], pa.list_(pa.string()))], ["origin", "destination", "cost", "node_ids", "edge_ids"])

    return grouped.mapInArrow(run, PATH)


def relax(edges: DataFrame, sources: DataFrame, cost: str = "cost", rounds: int | None = None) -> DataFrame:
    """(origin, node, cost) of all nodes reached from sources (origin), by rounds of relaxation in DataFrames until nothing changes.

    Cheapest paths have fewer edges than there are nodes, so costs that still change after as many rounds
    (or after ``rounds``, if given) raise an error: a cycle of negative cost, or a bound set too low.
    """
    spark = edges.sparkSession
    ensure_checkpoints(spark)
    e = edges.groupBy("u", "v").agg(F.min(cost).alias("c"))
    dist = sources.select("origin", F.col("origin").alias("node"), F.lit(0.0).alias("cost")).distinct()
    if rounds is None:
        rounds = e.select("u").union(e.select("v")).distinct().count() + 1
    before = None
    for _ in range(rounds + 1):
        step = dist.join(e, dist["node"] == e["u"]).select("origin", F.col("v").alias("node"), (F.col("cost") + F.col("c")).alias("cost"))
        dist = dist.unionByName(step).groupBy("origin", "node").agg(F.min("cost").alias("cost")).checkpoint()
        now = dist.agg(F.count("*"), F.sum(F.round("cost", 9).cast("decimal(38,9)"))).head()
        if now == before:
            return dist
        before = now
    raise RuntimeError(f"costs did not settle in {rounds} rounds")


def assign(edges: DataFrame, demands: DataFrame, iterations: int = 4, base: DataFrame | None = None, reference: DataFrame | None = None) -> tuple[DataFrame, float, float]:
    """Flows by successive averages: edges (u, v, edge_id, cost, capacity), demands (origin, destination, volume).

    Each iteration finds paths at congested costs and moves flows by 1 / iteration towards them.
    Returns (edge_id, flow) with base flows added, assigned and unassigned volume; unassigned is the last iteration's.
    """
    from .flows import relative_bpr

    spark = edges.sparkSession
    none = spark.createDataFrame([], "edge_id string, flow double")
    base = none if base is None else base
    reference = base if reference is None else reference
    flows = none
    volumes = demands.groupBy("origin", "destination").agg(F.sum("volume").alias("volume"))
    total, missed = float(volumes.agg(F.sum("volume")).head()[0] or 0.0), 0.0
    fixed = edges.join(base.select("edge_id", F.col("flow").alias("_b")), "edge_id", "left").join(reference.select("edge_id", F.col("flow").alias("_r")), "edge_id", "left").na.fill(0.0, ["_b", "_r"])
    for i in range(1, iterations + 1):
        now = fixed.join(flows, "edge_id", "left").na.fill(0.0, ["flow"])
        now = now.withColumn("_cost", F.col("cost") * relative_bpr(F.col("_b") + F.col("flow"), F.col("_r"), F.greatest("capacity", F.lit(1.0))))
        paths = shortest_paths(now, volumes, "_cost").join(volumes, ["origin", "destination"])
        auxiliary = paths.select(F.explode("edge_ids").alias("edge_id"), "volume").groupBy("edge_id").agg(F.sum("volume").alias("flow"))
        # At most a row for each edge of the bounded graph; new lineage for the next round.
        flows = spark.createDataFrame(msa_step(flows, auxiliary, i).toArrow())
        missed = total - float(paths.agg(F.sum("volume")).head()[0] or 0.0)
    merged = flows.unionByName(base.select("edge_id", "flow")).groupBy("edge_id").agg(F.sum("flow").alias("flow"))
    return merged, max(0.0, total - missed), missed


def weak_components(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node that is linked, by spreading the least label with pointer jumps."""
    spark = edges.sparkSession
    ensure_checkpoints(spark)
    both = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).union(edges.select(v, u)).distinct().checkpoint()
    label = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")).withColumnRenamed("a", "node")
    before = None
    for _ in range(rounds):
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("l").alias("m")).withColumnRenamed("a", "node")
        label = label.join(near, "node").select("node", F.least("l", "m").alias("l"))
        jump = label.select(F.col("node").alias("l"), F.col("l").alias("j"))
        label = label.join(jump, "l", "left").select("node", F.least(F.col("l"), F.coalesce("j", "l")).alias("l")).checkpoint()
        now = label.agg(F.sum(F.xxhash64("node", "l").cast("decimal(38,0)"))).head()
        if now == before:
            return label.withColumnRenamed("l", "component")
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def strong_components(graph: Graph) -> list[list]:
    """Of a graph in memory, by Tarjan's method without recursion."""
    n = len(graph.nodes)
    index, low, on, stack, out, clock = [-1] * n, [0] * n, [False] * n, [], [], 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, graph.head[root])]
        while work:
            x, e = work.pop()
            if index[x] < 0:
                index[x] = low[x] = clock
                clock += 1
                stack.append(x)
                on[x] = True
            for e in range(e, graph.head[x + 1]):
                y = int(graph.to[e])
                if index[y] < 0:
                    work += [(x, e), (y, graph.head[y])]
                    break
                if on[y]:
                    low[x] = min(low[x], low[y])
            else:
                if low[x] == index[x]:
                    part = []
                    while True:
                        y = stack.pop()
                        on[y] = False
                        part.append(graph.nodes[y])
                        if y == x:
                            break
                    out.append(sorted(part))
    return sorted(out)


def physical_floor(seconds: float, observed: float) -> bool:
    """Whether an observed time is not below the free-flow one less its tolerance."""
    return observed >= seconds - max(5.0, 0.03 * seconds)


def directional_continuation(edges: DataFrame, key: str = "edge_id") -> DataFrame:
    """Edges from whose end another edge goes on that is not their reverse."""
    onward = edges.select(F.col("u").alias("v"), F.col("v").alias("_to")).distinct()
    return edges.join(onward, "v").where(F.col("_to") != F.col("u")).select(key).distinct()
