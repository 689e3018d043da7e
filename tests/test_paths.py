"""Searches over partitioned edges against a heap search, movements of gateways, bands of distance."""

from __future__ import annotations

import hashlib
import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from lanewright.operators import paths
from lanewright.plans import path_queries

EDGE = "u string, v string, edge_id string, cost double"


def heap(edges, starts):
    """node -> (cost, label) with the rules of paths.search."""
    out, queue = {}, [(c, label, n) for n, c, label in starts]
    heapq.heapify(queue)
    while queue:
        c, label, n = heapq.heappop(queue)
        if n in out:
            continue
        out[n] = (c, label)
        for u, v, _, w in edges:
            if u == n and v not in out:
                heapq.heappush(queue, (c + w, label, v))
    return out


@pytest.fixture(scope="module")
def graph():
    rng = random.Random(4)
    return [(str(a), str(b), f"e{i}", float(rng.randrange(1, 9))) for i, (a, b) in enumerate((rng.randrange(30), rng.randrange(30)) for _ in range(110)) if a != b]


def test_search_and_paths(spark, graph):
    e = spark.createDataFrame(graph, EDGE)
    starts = [("k", "0", 0.0, "b"), ("k", "7", 2.0, "a"), ("m", "3", 1.0, "z"), ("none", "far away", 0.0, "y")]
    found = paths.search(e, spark.createDataFrame(starts, "key string, node string, cost double, label string"))
    got = {(r.key, r.node): (r.cost, r.label) for r in found.collect()}
    want = {(k, n): x for k in ("k", "m", "none") for n, x in heap(graph, [s[1:] for s in starts if s[0] == k]).items()}
    assert got == want
    cheapest, ends = {}, {}
    for u, v, i, c in graph:
        cheapest[u, v] = min(cheapest.get((u, v), (c, i)), (c, i))
        ends[i] = (u, v, c)
    listed = paths.paths_to(found, found.select("key", "node")).collect()
    assert len(listed) == len(want)
    for r in listed:
        assert [ends[i][:2] for i in r.edge_ids] == list(zip(r.node_ids, r.node_ids[1:], strict=False))
        first = next(c for k, n, c, label in starts if (k, n, label) == (r.key, r.node_ids[0], r.label))
        assert r.node_ids[-1] == r.node and first + sum(ends[i][2] for i in r.edge_ids) == r.cost
        assert all(cheapest[ends[i][:2]][1] == i for i in r.edge_ids)


@pytest.mark.parametrize("by_key", [True, False])
def test_targets_bound_the_search(spark, graph, by_key):
    e = spark.createDataFrame(graph, EDGE)
    source = spark.createDataFrame([("k", "0")], "key string, node string")
    want = heap(graph, [("0", 0.0, "")])
    near = sorted(want, key=want.get)[2]
    target = spark.createDataFrame([("k", near)], "key string, node string")
    found = {r.node: r.cost for r in paths.search(e, source, target if by_key else target.select("node")).collect()}
    assert found[near] == want[near][0] and len(found) < len(want)


def test_costs_above_zero(spark):
    for bad in (0.0, -1.0, None, float("nan")):
        e = spark.createDataFrame([("a", "b", "x", bad)], EDGE)
        with pytest.raises(ValueError, match="above zero"):
            paths.search(e, spark.createDataFrame([("k", "a")], "key string, node string"))
    empty = spark.createDataFrame([], EDGE)
    assert [tuple(r)[:3] for r in paths.search(empty, spark.createDataFrame([("k", "a")], "key string, node string")).collect()] == [("k", "a", 0.0)]


def test_movements(spark):
    e = spark.createDataFrame([("a", "b", "ab", 10.0), ("b", "a", "ba", 11.0), ("b", "c", "bc", 5.0), ("c", "a", "ca", 7.0)], EDGE)
    zones = spark.createDataFrame([("z1", "a", 0.0, 0.0, 4.0), ("z2", "c", 3000.0, 4000.0, 9.0)], "zone_id string, node_id string, x double, y double, activity double")
    crossings = [("G", "east", "I5", "inbound", "gi", "b", "X", -123.0, 45.0), ("G", "east", "I5", "outbound", "go", "a", "X", -123.0, 45.0), ("H", "west", "I84", "inbound", "hi", "a", "Y", -123.1, 45.0), ("H", "west", "I84", "outbound", "ho", "c", "Y", -123.1, 45.0)]
    gateway_edges = spark.createDataFrame(crossings, "gateway_id string, side string, ref string, movement string, edge_id string, interior_node_id string, exterior_node_id string, crossing_lon double, crossing_lat double")
    priors = [("gi", "X", "b", "motorway", 400.0, 10.0), ("go", "a", "X", "service", 900.0, 2.0), ("hi", "Y", "a", "other", 0.0, 0.0), ("ho", "c", "Y", "trunk", 100.0, 3.0)]
    as_priors = lambda rows: spark.createDataFrame(rows, "edge_id string, u string, v string, road_class string, estimated_capacity_vph double, free_flow_seconds double")
    gates = paths.gateway_zones(gateway_edges, as_priors(priors))
    g = {r.gateway_id: r for r in gates.collect()}
    assert (g["G"].activity, g["G"].inbound_cost_seconds, g["G"].outbound_cost_seconds, g["G"].side) == (50.0, 10.0, 5.0, "east")
    assert (g["H"].activity, g["H"].inbound_cost_seconds, g["H"].x < g["G"].x) == (11.0, pytest.approx(0.012), True)
    rows = {(r.movement_class, r.origin_zone, r.destination_zone): r for r in paths.gateway_paths(e, zones, gates).collect()}
    inner = {("internal_internal", "z1", "z2"), ("internal_internal", "z2", "z1")}
    mixed = {("gateway_internal", x, z) for x in "GH" for z in ("z1", "z2")} | {("internal_gateway", z, x) for x in "GH" for z in ("z1", "z2")} | {("gateway_gateway", "G", "H"), ("gateway_gateway", "H", "G")}
    assert set(rows) == inner | mixed
    r = rows["internal_internal", "z1", "z2"]
    assert (r.node_ids, r.edge_ids, r.straight_distance_m, r.pair_id) == (["a", "b", "c"], ["ab", "bc"], 5000.0, hashlib.sha256(b"z1|z2").hexdigest()[:20])
    assert r.prior_weight == pytest.approx(6.0 / 5**1.15)
    r = rows["gateway_internal", "G", "z2"]
    assert (r.node_ids, r.edge_ids, r.route_free_flow_seconds, r.origin_node_id) == (["X", "b", "c"], ["gi", "bc"], 15.0, "X")
    assert r.pair_id == hashlib.sha256(b"gateway_internal|G|z2").hexdigest()[:20]
    r = rows["internal_gateway", "z1", "G"]  # no length inside
    assert (r.node_ids, r.edge_ids, r.route_free_flow_seconds) == (["a", "X"], ["go"], 5.0)
    r = rows["gateway_gateway", "H", "G"]
    assert (r.node_ids, r.edge_ids, r.route_free_flow_seconds) == (["Y", "a", "X"], ["hi", "go"], pytest.approx(5.012))
    assert all(len(r.node_ids) == len(r.edge_ids) + 1 and r.edge_ids for r in rows.values())
    for wrong, what in ((gateway_edges.where("edge_id <> 'go'"), "one inbound"), (gateway_edges.withColumn("interior_node_id", F.lit("q")), "direction"), (gateway_edges.withColumn("edge_id", F.lit("nope")), "lack")):
        with pytest.raises(ValueError, match=what):
            paths.gateway_zones(wrong, as_priors(priors))
    with pytest.raises(ValueError, match="repeat"):
        paths.gateway_zones(gateway_edges, as_priors(priors + priors[:1]))
    with pytest.raises(ValueError, match="once"):
        paths.gateway_paths(e, zones, gates.union(gates))


def test_cheapest_between(spark):
    rows = [("a", "b", "ab", 4.0), ("b", "c", "bc", 1.0), ("c", "d", "cd", 2.0), ("x", "c", "xc", 5.0), ("d", "e", "de", 3.0)]
    e = spark.createDataFrame(rows, EDGE)
    trips = spark.createDataFrame([("t", ["ab", "xc"], ["de", "cd"]), ("same", ["ab", "cd"], ["cd"]), ("tie", ["xc", "ab"], ["cd"]), ("none", ["de"], ["ab"])], "trip string, origins array<string>, destinations array<string>")
    got = {r.trip: r for r in paths.cheapest_between(e, trips).collect()}
    assert (got["t"].origin_edge, got["t"].destination_edge, got["t"].cost, got["t"].edge_ids) == ("ab", "cd", 7.0, ["ab", "bc", "cd"])
    assert (got["same"].cost, got["same"].edge_ids) == (2.0, ["cd"])
    assert (got["tie"].origin_edge, got["tie"].edge_ids) == ("xc", ["xc", "cd"])
    assert got["none"].cost is None and got["none"].edge_ids is None


def test_route_checks(spark, graph):
    e = spark.createDataFrame(graph, EDGE).union(spark.createDataFrame([("island", "rock", "i", 1.0)], EDGE))
    r = spark.createDataFrame([("fine", "0", "0"), ("cut", "0", "rock"), ("gone", "0", "nowhere")], "name string, origin string, destination string")
    got = {x.name: tuple(x)[1:] for x in paths.check_routes(e, r).collect()}
    assert got == {"fine": (True, 0.0, None), "cut": (False, None, "NetworkXNoPath"), "gone": (False, None, "NodeNotFound")}


@pytest.mark.parametrize("flat", [True, False])
def test_band(spark, flat):
    rng = random.Random(9)
    rows = [(i, i % 3, rng.uniform(0, 400), 0.0 if flat else rng.uniform(-200, 200)) for i in range(300)]
    p = spark.createDataFrame(rows, "id int, k int, x double, y double")
    pairs = paths.pairs_in_band(p, 20, 90, "id", ("k",), y=None if flat else "y")
    dist = lambda a, b: math.hypot(a[2] - b[2], a[3] - b[3])
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and a[1] == b[1] and 20 <= dist(a, b) <= 90}
    assert {(r[0], r[1]) for r in pairs.select("a.id", "b.id").collect()} == want
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    wide = paths.pairs_in_band(p, 20, 90, "id", ("k",), y=None if flat else "y", parts=4)
    assert {(r[0], r[1]) for r in wide.select("a.id", "b.id").collect()} == want


def test_no_products_in_plans(spark, graph):
    e = spark.createDataFrame(graph, EDGE)
    found = paths.search(e, spark.createDataFrame([("k", "0")], "key string, node string"))
    plan = paths.paths_to(found, found.select("key", "node"))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def counted(spark, graph):
    """The edges, and how often one of their rows was made."""
    made = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return spark.createDataFrame(graph, EDGE).mapInArrow(pass_on, EDGE), made


def test_edges_are_dealt_once(spark, graph):
    e, made = counted(spark, graph)
    routes = spark.createDataFrame([("a", graph[0][0], graph[0][1]), ("b", "none", graph[0][1])], "name string, origin string, destination string")
    assert {r["name"]: r["reason"] for r in paths.check_routes(e, routes).collect()} == {"a": None, "b": "NodeNotFound"}
    assert made.value == len(graph)


def test_origins_and_destinations_are_looked_up_in_one_pass(spark, graph):
    e, made = counted(spark, graph)
    trips = spark.createDataFrame([(1, ["e0", "e1"], ["e2", "e3"]), (2, ["e4"], ["e4"])], "trip int, origins array<string>, destinations array<string>")
    assert {r["trip"] for r in paths.cheapest_between(e, trips).collect()} == {1, 2}
    assert made.value == 2 * len(graph)


def test_points_in_band_move_and_their_pairs_do_not(spark):
    """Ten rows of a cell make 90 pairs, but only the points are dealt out, to a fixed number of cells."""
    p = spark.createDataFrame([(i, 1, 10.0 + i, 10.0) for i in range(10)], "id int, k int, x double, y double")
    pairs = paths.pairs_in_band(p, 1, 50, "id", ("k",))
    assert pairs.count() == 90
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1


def shuffled(spark, work):
    """Bytes that work() shuffles."""

    def so_far():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        all_ = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(all_.apply(i).totalShuffleWrite() for i in range(all_.size()))

    # Filters that Spark adds by itself have a fixed size, which is much beside a small table.
    key = "spark.sql.optimizer.runtime.bloomFilter.enabled"
    added = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        before = so_far()
        work()
        return so_far() - before
    finally:
        spark.conf.set(key, added)


def test_edges_stay_where_they_are(spark):
    """A search of few rows goes to the edges: 40,000 that it never meets are not shuffled."""
    far = spark.range(40_000).select(F.sha1(F.col("id").cast("string")).alias("u"), F.sha1((-F.col("id")).cast("string")).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("edge_id"), (F.col("id") + 1.0).alias("cost"))
    e = spark.createDataFrame([("a", "b", "ab", 4.0), ("a", "b", "ab2", 4.0), ("b", "c", "bc", 1.0), ("a", "c", "ac", 9.0)], EDGE).union(far)
    source, found = spark.createDataFrame([("k", "a")], "key string, node string"), []
    assert shuffled(spark, lambda: found.extend(paths.search(e, source).collect())) < 200_000
    routes = spark.createDataFrame([("r", "a", "c")], "name string, origin string, destination string")
    assert shuffled(spark, lambda: found.append(paths.check_routes(e, routes).collect())) < 200_000
    assert [tuple(r) for r in found.pop()] == [("r", True, 5.0, None)]
    assert {r.node: (r.cost, r.prev, r.edge_id) for r in found} == {"a": (0.0, None, None), "b": (4.0, "a", "ab"), "c": (5.0, "b", "bc")}


def test_lines_move_without_what_is_made_of_them(spark):
    plan = path_queries.edges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Exchange hashpartitioning")
    assert "concat_ws" in above and "concat_ws" not in below and "/ 100" not in below


def test_large_frontiers(spark, graph, monkeypatch):
    """Beyond what is broadcast, edges are dealt by their start node; rows are the same."""
    e = spark.createDataFrame([*graph, *((u, v, f"{i}-again", c) for u, v, i, c in graph[:40])], EDGE)
    sources = spark.createDataFrame([("k", "0", 0.0, 2), ("k", "7", 2.0, 1), ("m", "3", 1.0, 5)], "key string, node string, cost double, label int")
    targets = spark.createDataFrame([("k", graph[5][1]), ("m", graph[9][1])], "key string, node string")
    factors = spark.createDataFrame([("k", i, 3.0) for _, _, i, _ in graph[::3]], "key string, edge_id string, factor double")
    run = lambda: [sorted(map(str, paths.search(e, sources, t, factors=f).collect())) for t, f in ((None, None), (targets, None), (None, factors))]
    want = run()
    monkeypatch.setattr(paths, "FEW", 0)
    assert run() == want and not spark.sparkContext._jsc.getPersistentRDDs()


def test_tables_of_edges_are_deleted(spark, graph):
    with paths.stored(spark.createDataFrame(graph, EDGE), best=True) as e:
        (at,) = {f.rpartition("/")[0] for f in e.inputFiles()}
        assert e.count() == len({(u, v) for u, v, _, _ in graph})
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
