"""Cheapest paths over partitioned edges: searches as rounds of joins, paths by pointer jumps, gateways, checked routes.

Edges lie in one compressed table for all rounds of a search, and the rows that changed (the frontier) go to
them: as a broadcast while they are few; beyond that edges are dealt by their start node once and stay dealt.
So what a round shuffles follows the frontier.  Rounds carry costs only; the edge by which each node is reached
is found in one more pass, when costs have settled.  A search runs for many keys at once, from any number
of sources each, and what is known of a source (a label) travels with the cost: the cheapest of all
combinations of sources and targets is found without making the combinations.  Rounds are as many as the
longest cheapest path has edges; where targets are given, rows that are dearer than all targets of their key
are not followed.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import ExitStack, contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.functions import geo
from lanewright.session import ensure_checkpoints, shuffles_dropped, table_of

from .flows import best_parallel
from .od import gravity

# Factors on free-flow time by road class, and of other classes: fixed values.
CLASS_FACTOR = {
    "motorway": 1.0, "motorway_link": 1.03, "trunk": 1.0, "trunk_link": 1.03, "primary": 1.02, "primary_link": 1.04, "secondary": 1.04, "secondary_link": 1.06,
    "tertiary": 1.07, "tertiary_link": 1.09, "unclassified": 1.13, "residential": 1.18, "living_street": 1.35, "service": 2.5, "track": 4.0,
}
OTHER_FACTOR = 1.2
# Names of the movements and of what is wrong with a route: fixed values.
INTERNAL, GATEWAY = "internal", "gateway"
NO_NODE, NO_PATH = "NodeNotFound", "NetworkXNoPath"
BAND = (3000.0, 55000.0)


def seed_cost(seconds: Column, road_class: Column) -> Column:
    """Routing cost of an edge: free-flow seconds, a hundredth at least, times the factor of its class."""
    table = F.create_map(*(F.lit(x) for pair in CLASS_FACTOR.items() for x in pair))
    return F.greatest(seconds.cast("double"), F.lit(0.01)) * F.coalesce(F.try_element_at(table, road_class), F.lit(OTHER_FACTOR))


@contextmanager
def stored(edges: DataFrame, cost: str = "cost", best: bool = False, ids: bool = True) -> Iterator[DataFrame]:
    """(u, v, edge_id, _c) in a table that lasts as long as the context; best: only the cheapest edge of each (u, v), ties by id; ids: with edge_id.

    Edges are written before the best are taken, so that what they were made from has left the disk when they move.
    """
    whole = table_of(edges.select("u", "v", *(["edge_id"] if ids else []), F.col(cost).cast("double").alias("_c")))
    with ExitStack() as tables:
        if best:
            with whole as e:
                e = tables.enter_context(table_of(best_parallel(e.repartition("u"), "_c")))
        else:
            e = tables.enter_context(whole)
        yield e


#: Wanted ids, nodes, rows of a frontier and the like up to so many are broadcast, so that the edges that they are looked up in stay where they are.
FEW = 200_000


def few(df: DataFrame) -> DataFrame:
    """df, written, and to be broadcast if it has few rows."""
    df = df.checkpoint()
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def search(edges: DataFrame, sources: DataFrame, targets: DataFrame | None = None, cost: str = "cost", rounds: int = 10_000, factors: DataFrame | None = None) -> DataFrame:
    """(key, node, cost, label, prev, edge_id): the cheapest way from a key's sources to every node.

    edges (u, v, edge_id, cost): costs must be above zero.  sources (key, node, optionally cost and label): where a
    key's search starts, at which cost.  targets (key, node; or node, for all keys): once all targets of a key
    are reached, rows beyond the dearest may be missing.
    factors (key, edge_id, factor): what makes an edge dearer for one key; of parallel edges the cheapest without them counts.  Of equal costs the least label wins, then
    the least previous node, then the least edge; so paths are the same however rows are dealt.  A source that is not reached more cheaply from another has no prev.
    """
    with stored(edges, cost, best=factors is not None) as e:
        return search_stored(e, sources, targets, rounds, factors)


def search_stored(edges: DataFrame, sources: DataFrame, targets: DataFrame | None = None, rounds: int = 10_000, factors: DataFrame | None = None, ways: bool = True) -> DataFrame:
    """search over edges that stored() gave; without ways only (key, node, cost, label)."""
    ensure_checkpoints(edges.sparkSession)
    e = edges.where("u <> v")
    shared = targets.select("node").distinct().count() if targets is not None and "key" not in targets.columns else None
    bad = e.where("_c IS NULL OR isnan(_c) OR _c <= 0").limit(1).collect()
    if bad:
        name = bad[0]["edge_id"] if "edge_id" in e.columns else f"from {bad[0]['u']} to {bad[0]['v']}"
        raise ValueError(f"cost of edge {name} is not above zero")
    start = F.col("cost").cast("double") if "cost" in sources.columns else F.lit(0.0)
    label = F.col("label") if "label" in sources.columns else F.lit(None).cast("string")
    rows = sources.select("key", "node", start.alias("cost"), label.alias("label"))
    dealt: list[DataFrame] = []

    def steps(front: DataFrame, n: int, known: DataFrame, size: int, fits: Column, last: bool = False) -> DataFrame:
        """Rows one edge on from front (n of known's rows) that fit what is known of their node (_cost, _label); of a large known they aren't asked.  last: with prev and edge_id."""
        if targets is None:
            front = front.withColumn("_far", F.lit(None).cast("double"))
        else:
            if shared is None:
                t = targets.select("key", "node").join(known.select("key", "node", "cost"), ["key", "node"], "left")
                all_there = F.count_if(F.col("cost").isNull()) == 0
            else:
                t, all_there = known.join(targets.select("node").distinct(), "node"), F.count("*") == shared
            far = t.groupBy("key").agg(F.when(all_there, F.max("cost")).alias("_far"))
            front = front.join(far, "key", "left").where(F.col("_far").isNull() | (F.col("cost") < F.col("_far")))
        front = front.select("key", F.col("node").alias("u"), "cost", "label", "_far")
        used = e if last or factors is not None else e.select("u", "v", "_c")
        if n <= FEW:
            step = used.join(F.broadcast(front), "u")
        elif last:
            step = front.join(used, "u")
        else:
            if not dealt:
                dealt.append(used.repartition("u").persist(StorageLevel.DISK_ONLY))
            step = front.join(dealt[0], "u")
        if factors is not None:
            step = step.join(factors.select("key", "edge_id", "factor"), ["key", "edge_id"], "left").withColumn("_c", F.col("_c") * F.coalesce("factor", F.lit(1.0)))
        prev = [F.col("u").alias("prev"), "edge_id"] if last else []
        step = step.select("key", F.col("v").alias("node"), (F.col("cost") + F.col("_c")).alias("cost"), "label", *prev, "_far").where("_far IS NULL OR cost <= _far").drop("_far")
        if size <= FEW:
            at = known.select("key", "node", F.col("cost").alias("_cost"), F.col("label").alias("_label"))
            step = step.join(F.broadcast(at), ["key", "node"], "left").where(F.col("_cost").isNull() | fits).drop("_cost", "_label")
        return step

    better = F.expr("cost < _cost OR cost = _cost AND (label < _label OR label IS NULL AND _label IS NOT NULL)")
    same = F.expr("cost = _cost AND label <=> _label")
    least = F.min(F.struct("cost", "label"))
    counts = lambda known: known.agg(F.count("*"), F.count_if("moved")).head()
    with shuffles_dropped(edges.sparkSession):
        try:
            known = rows.groupBy("key", "node").agg(least.alias("b")).select("key", "node", "b.*", F.lit(True).alias("moved")).checkpoint()
            size, n = counts(known)
            for _ in range(rounds):
                step = steps(known.where("moved"), n, known, size, better)
                # Costs alone are summed up by hashing, without a sort of all steps.
                step = step.groupBy("key", "node", "label").agg(F.min("cost").alias("cost")).withColumn("old", F.lit(False))
                both = known.drop("moved").withColumn("old", F.lit(True)).unionByName(step)
                now = both.groupBy("key", "node").agg(least.alias("b"), F.min(F.when(F.col("old"), F.struct("cost", "label"))).alias("was"))
                moved = ~F.struct("b.cost", "b.label").eqNullSafe(F.col("was"))
                known = now.select("key", "node", "b.*", moved.alias("moved")).checkpoint()
                size, n = counts(known)
                if not n:
                    break
            else:
                raise RuntimeError(f"costs did not settle in {rounds} rounds")
        finally:
            for d in dealt:
                d.unpersist()
        known = known.drop("moved")
        if not ways:
            return known
        kind = {f.name: f.dataType for f in e.schema}
        begun = rows.withColumns({"prev": F.lit(None).cast(kind["u"]), "edge_id": F.lit(None).cast(kind["edge_id"])})
        reached = begun.unionByName(steps(known, size, known, size, same, last=True)).groupBy("key", "node").agg(F.min(F.struct("cost", "label", "prev", "edge_id")).alias("b"))
        return reached.select("key", "node", "b.*").checkpoint()


def paths_to(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, node, cost, label, node_ids, edge_ids) for wanted (key, node) that a search found.

    Ancestors at distances of powers of two are made by joining the table with itself, and a path takes
    them from the farthest down, so that each of its nodes comes up once: rounds go with the logarithm of
    the longest path, rows with the length of the paths.
    """
    ensure_checkpoints(found.sparkSession)
    jump = found.where("prev IS NOT NULL").select("key", "node", F.col("prev").alias("to")).checkpoint()
    jumps: list[DataFrame] = []
    while not jump.isEmpty():
        jumps.append(jump)
        onward = jump.select("key", F.col("node").alias("to"), F.col("to").alias("_to"))
        jump = jump.join(onward, ["key", "to"]).select("key", "node", F.col("_to").alias("to")).checkpoint()
    wanted = wanted.select("key", "node").distinct()
    rows = found.select("key", "node").join(wanted, ["key", "node"]).select("key", F.col("node").alias("end"), "node", F.lit(0).cast("long").alias("back"))
    for i in reversed(range(len(jumps))):
        rows = rows.unionByName(rows.join(jumps[i], ["key", "node"]).select("key", "end", F.col("to").alias("node"), (F.col("back") + (1 << i)).alias("back"))).checkpoint()
    steps = rows.join(found.select("key", "node", "edge_id"), ["key", "node"])
    listed = steps.groupBy("key", F.col("end").alias("node")).agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), F.col("node").alias("n"), "edge_id"))).alias("s"))
    edge_ids = F.transform(F.filter("s", lambda x: x["edge_id"].isNotNull()), lambda x: x["edge_id"])
    return found.select("key", "node", "cost", "label").join(listed, ["key", "node"]).select("key", "node", "cost", "label", F.col("s.n").alias("node_ids"), edge_ids.alias("edge_ids"))


def pairs_in_band(points: DataFrame, low: float, high: float, id_: str, keys: tuple[str, ...] = (), x: str = "x", y: str | None = "y", parts: int = 1) -> DataFrame:
    """Pairs of different points whose distance lies in [low, high]: columns of both as a and b, and distance.

    Points meet by cells of high / parts: one side goes to its own cell, the other to all that can hold such a pair, 21 of them
    (five on a line) where parts is 1.  So points move a fixed number of times however many are near them, and pairs, of which
    there may be many more, are made and tested where they meet and don't move.  keys: only points that agree in them.
    """
    n, size, reach = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), high / parts, range(-parts - 1, parts + 2)
    gap = lambda d: max(abs(d) - 1, 0)
    near = [(i, j) for i in reach for j in (reach if y else (0,)) if (gap(i) ** 2 + gap(j) ** 2) * size * size <= high * high and ((abs(i) + 1) ** 2 + (abs(j) + 1 if y else 0) ** 2) * size * size >= low * low]
    cx, cy = geo.cell(F.col(x), size), (geo.cell(F.col(y), size) if y else F.lit(0).cast("long"))
    offsets = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in near))) if near else F.explode(F.array().cast("array<struct<i:int,j:int>>"))
    here = points.select(*keys, cx.alias("_cx"), cy.alias("_cy"), F.struct(*points.columns).alias("a"))
    there = points.select(*keys, cx.alias("_cx"), cy.alias("_cy"), F.struct(*points.columns).alias("b"), offsets.alias("_o")).withColumns({"_cx": F.col("_cx") + F.col("_o.i"), "_cy": F.col("_cy") + F.col("_o.j")}).drop("_o")
    # The work lies in the pairs, so adaptive execution may not merge the partitions.
    deal = [*keys, "_cx", "_cy"]
    dx = F.col(f"a.{x}") - F.col(f"b.{x}")
    d = F.hypot(dx, F.col(f"a.{y}") - F.col(f"b.{y}")) if y else F.abs(dx)
    pairs = here.repartition(n, *deal).join(there.repartition(n, *deal), deal).where(F.col(f"a.{id_}") != F.col(f"b.{id_}"))
    return pairs.select("a", "b", d.alias("distance")).where(F.col("distance").between(low, high))


def _pair_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 20)


def gateway_zones(gateway_edges: DataFrame, priors: DataFrame) -> DataFrame:
    """One row a gateway from its two directed edges: sides, crossing in metres, activity, edges, nodes and costs of both ways.

    Raises where a gateway hasn't exactly one inbound and one outbound edge, where one is missing among priors
    (edge_id, u, v, road_class, estimated_capacity_vph, free_flow_seconds), runs the other way there, or where
    priors repeat an edge.
    """
    twice = priors.groupBy("edge_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"edge priors repeat {twice[0]['edge_id']}")
    p = priors.select("edge_id", F.col("u").cast("string").alias("_u"), F.col("v").cast("string").alias("_v"), seed_cost(F.col("free_flow_seconds"), F.col("road_class")).alias("_cost"), F.sqrt(F.greatest(F.col("estimated_capacity_vph").cast("double"), F.lit(1.0))).alias("_root"))
    g = gateway_edges.join(p, "edge_id", "left")
    inside, outside = F.col("interior_node_id").cast("string"), F.col("exterior_node_id").cast("string")
    inbound = F.col("movement") == "inbound"
    right_way = F.when(inbound, (F.col("_u") == outside) & (F.col("_v") == inside)).otherwise((F.col("_u") == inside) & (F.col("_v") == outside))
    of = lambda way, c: F.max(F.when(F.col("movement") == way, c))
    rows = g.groupBy("gateway_id").agg(
        F.count("*").alias("_n"), F.count_if(inbound).alias("_in"), F.count_if(F.col("movement") == "outbound").alias("_out"), F.count_if(F.col("_u").isNull()).alias("_absent"), F.count_if(~F.coalesce(right_way, F.lit(True))).alias("_wrong"),
        of("inbound", F.col("side")).alias("side"), of("inbound", F.col("ref")).alias("ref"),
        ((of("inbound", F.col("crossing_lon")) + of("outbound", F.col("crossing_lon"))) / 2).alias("lon"), ((of("inbound", F.col("crossing_lat")) + of("outbound", F.col("crossing_lat"))) / 2).alias("lat"),
        (of("inbound", F.col("_root")) + of("outbound", F.col("_root"))).alias("activity"),
        *(of(way, F.col(c)).alias(f"{way}_{name}") for way in ("inbound", "outbound") for c, name in (("edge_id", "edge_id"), ("exterior_node_id", "exterior_node_id"), ("interior_node_id", "interior_node_id"), ("_cost", "cost_seconds"))),
    )
    wrong = rows.where("_n <> 2 OR _in <> 1 OR _out <> 1 OR _absent > 0 OR _wrong > 0").orderBy("gateway_id").limit(1).collect()
    if wrong:
        r = wrong[0]
        what = "must have one inbound and one outbound edge" if (r["_n"], r["_in"], r["_out"]) != (2, 1, 1) else "has an edge that priors lack" if r["_absent"] else "has an edge against the direction of the graph"
        raise ValueError(f"gateway {r['gateway_id']} {what}")
    east, north = geo.lonlat_to_utm10(F.col("lon"), F.col("lat"))
    return rows.withColumns({"x": east, "y": north}).drop("_n", "_in", "_out", "_absent", "_wrong", "lon", "lat")


def candidate_pairs(zones: DataFrame, band: tuple[float, float] = BAND, most: int | None = None) -> DataFrame:
    """Pairs of zones (zone_id, node_id, x, y, activity) in the band with different nodes, at most as many as wanted, by pair_id."""
    pairs = pairs_in_band(zones.select("zone_id", "node_id", "x", "y", "activity"), *band, id_="node_id")
    pairs = pairs.withColumn("pair_id", _pair_id(F.col("a.zone_id").cast("string"), F.col("b.zone_id").cast("string")))
    return pairs if most is None else pairs.orderBy("pair_id").limit(most)


def _path_row(kind: str, o: dict[str, Column], d: dict[str, Column], distance: Column, seconds: Column, nodes: Column, edges: Column, pair_id: Column) -> list[Column]:
    km = distance / 1000
    return [
        pair_id.alias("pair_id"), F.lit(kind).alias("movement_class"), o["zone"].cast("string").alias("origin_zone"), d["zone"].cast("string").alias("destination_zone"), o["node"].cast("string").alias("origin_node_id"), d["node"].cast("string").alias("destination_node_id"),
        distance.alias("straight_distance_m"), seconds.alias("route_free_flow_seconds"), o["activity"].alias("origin_activity"), d["activity"].alias("destination_activity"), gravity(F.greatest(o["activity"], F.lit(1e-9)), F.greatest(d["activity"], F.lit(1e-9)), km).alias("prior_weight"),
        nodes.alias("node_ids"), edges.alias("edge_ids"),
    ]


def gateway_paths(edges: DataFrame, zones: DataFrame, gateways: DataFrame, band: tuple[float, float] = BAND, most: int | None = None, cost: str = "cost") -> DataFrame:
    """Candidate movements of all four classes with their paths: between zones in the band, and between zones and gateways.

    Routing begins and ends at the node inside; the edge across the border is put before or behind.  A leg of
    no length is allowed at gateways.  edges (u, v, edge_id, cost), zones (zone_id, node_id, x, y, activity),
    gateways as gateway_zones gives them.  Raises if gateways are missing or repeated.  Ends meet search results
    by their node, so no product of origins and destinations is made but the pairs that are asked for.
    """
    ensure_checkpoints(edges.sparkSession)
    ids = gateways.agg(F.count("*").alias("n"), F.count_distinct("gateway_id").alias("d")).head()
    if not ids.n or ids.n != ids.d:
        raise ValueError("gateways must be there, each once")
    s = lambda c: F.col(c).cast("string")
    e = edges.select(s("u").alias("u"), s("v").alias("v"), s("edge_id").alias("edge_id"), cost)
    z = zones.select(s("zone_id").alias("zone"), s("node_id").alias("node"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("activity").cast("double").alias("activity"))
    g = gateways.select(s("gateway_id").alias("zone"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("activity").cast("double").alias("activity"), *(s(f"{w}_{c}").alias(f"{w}_{c}") for w in ("inbound", "outbound") for c in ("edge_id", "interior_node_id", "exterior_node_id")), *(F.col(f"{w}_cost_seconds").cast("double").alias(f"{w}_cost") for w in ("inbound", "outbound")))
    pairs = candidate_pairs(zones.select(s("zone_id").alias("zone_id"), s("node_id").alias("node_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("activity").cast("double").alias("activity")), band, most)
    pairs = pairs.select("pair_id", "distance", *(F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in "ab" for c in ("zone_id", "node_id", "activity"))).checkpoint()
    z, g = z.checkpoint(), g.checkpoint()
    starts, outs = (g.select(F.col(f"{w}_interior_node_id").alias(c)).distinct() for w, c in (("inbound", "key"), ("outbound", "node")))
    keys = starts.union(z.select("node")).distinct()
    found = search(e, keys.select("key", F.col("key").alias("node")), z.select("node").union(outs).distinct(), cost)
    from_gateways = found.join(starts, "key", "left_semi").join(z.select("node").union(outs), "node", "left_semi").select("key", "node")
    from_zones = found.join(z.select(F.col("node").alias("key")), "key", "left_semi").join(outs, "node", "left_semi").select("key", "node")
    reach = from_gateways.union(from_zones).union(pairs.select(F.col("a_node_id").alias("key"), F.col("b_node_id").alias("node")))
    legs = paths_to(found, reach).select(F.col("key").alias("from"), F.col("node").alias("to"), "cost", "node_ids", "edge_ids").checkpoint()

    inner = legs.join(pairs, (F.col("from") == F.col("a_node_id")) & (F.col("to") == F.col("b_node_id")))
    o, d = ({"zone": F.col(f"{p}_zone_id"), "node": F.col(f"{p}_node_id"), "activity": F.col(f"{p}_activity")} for p in "ab")
    out = inner.select(*_path_row("internal_internal", o, d, F.col("distance"), F.col("cost"), F.col("node_ids"), F.col("edge_ids"), F.col("pair_id")))

    def crossing(origins: DataFrame, destinations: DataFrame, kind: str) -> DataFrame:
        came, goes = kind.split("_")
        a, b = origins.select(*(F.col(c).alias(f"o_{c}") for c in origins.columns)), destinations.select(*(F.col(c).alias(f"d_{c}") for c in destinations.columns))
        inside_a, inside_b = ("inbound_interior_node_id" if came == GATEWAY else "node"), ("outbound_interior_node_id" if goes == GATEWAY else "node")
        rows = legs.join(a, F.col("from") == F.col(f"o_{inside_a}")).join(b, F.col("to") == F.col(f"d_{inside_b}"))
        if came == goes:
            rows = rows.where("o_zone <> d_zone")
        nodes, ids, seconds = F.col("node_ids"), F.col("edge_ids"), F.col("cost")
        if came == GATEWAY:
            nodes, ids, seconds = F.concat(F.array("o_inbound_exterior_node_id"), nodes), F.concat(F.array("o_inbound_edge_id"), ids), F.col("o_inbound_cost") + seconds
        if goes == GATEWAY:
            nodes, ids, seconds = F.concat(nodes, F.array("d_outbound_exterior_node_id")), F.concat(ids, F.array("d_outbound_edge_id")), seconds + F.col("d_outbound_cost")
        o = {"zone": F.col("o_zone"), "node": F.col("o_inbound_exterior_node_id" if came == GATEWAY else "o_node"), "activity": F.col("o_activity")}
        d = {"zone": F.col("d_zone"), "node": F.col("d_outbound_exterior_node_id" if goes == GATEWAY else "d_node"), "activity": F.col("d_activity")}
        distance = F.hypot(F.col("d_x") - F.col("o_x"), F.col("d_y") - F.col("o_y"))
        return rows.select(*_path_row(kind, o, d, distance, seconds, nodes, ids, _pair_id(F.lit(kind), F.col("o_zone"), F.col("d_zone"))))

    return out.unionByName(crossing(g, z, "gateway_internal")).unionByName(crossing(z, g, "internal_gateway")).unionByName(crossing(g, g, "gateway_gateway"))


def cheapest_between(edges: DataFrame, trips: DataFrame, cost: str = "cost", ready: DataFrame | None = None) -> DataFrame:
    """(trip, origin_edge, destination_edge, cost, edge_ids): the cheapest route from one of a trip's origin edges to one of its destination edges, both included.

    trips (trip, origins array, destinations array of edge ids).  All origins of a trip start one search, each
    with the cost of its edge and its place in the list as label; all destinations end it.  Of equal costs the
    first origin wins, then the first destination.  A trip without a route has nulls.
    ready: the edges as stored() gave them, if they are there already.
    """
    ensure_checkpoints(edges.sparkSession)
    trips = trips.select("trip", "origins", "destinations").checkpoint()
    named = few(trips.select(F.explode(F.concat("origins", "destinations")).alias("edge_id")).distinct())
    e = edges.select("edge_id", "u", "v", F.col(cost).cast("double").alias("cost")).join(named, "edge_id", "left_semi").checkpoint()
    spread = lambda c: trips.select(F.col("trip").alias("key"), F.posexplode(c).alias("place", "edge_id")).join(e, "edge_id").checkpoint()
    origins, ends = spread("origins"), spread("destinations")
    sources = origins.select("key", F.col("v").alias("node"), "cost", F.col("place").alias("label"))
    targets = ends.select("key", F.col("u").alias("node")).distinct()
    found = search(edges, sources, targets, cost) if ready is None else search_stored(ready, sources, targets)
    via = ends.select("key", F.col("u").alias("node"), F.col("place").alias("last"), F.col("edge_id").alias("destination_edge"), F.col("cost").alias("own")).join(found.select("key", "node", "cost", "label"), ["key", "node"])
    via = via.join(origins.select("key", F.col("place").alias("label"), F.col("edge_id").alias("origin_edge")), ["key", "label"])
    via = via.select("key", (F.col("cost") + F.col("own")).alias("total"), F.col("label").alias("first"), "last", "origin_edge", "destination_edge", "node")
    # An edge that is origin and destination is a route of its own.
    same = origins.select("key", "edge_id", "place", "cost").join(ends.select("key", "edge_id", F.col("place").alias("last")), ["key", "edge_id"])
    same = same.select("key", F.col("cost").alias("total"), F.col("place").alias("first"), "last", F.col("edge_id").alias("origin_edge"), F.col("edge_id").alias("destination_edge"), F.lit(None).cast(e.schema["u"].dataType).alias("node"))
    best = via.unionByName(same).groupBy("key").agg(F.min(F.struct("total", "first", "last", "origin_edge", "destination_edge", "node")).alias("b")).select("key", "b.*").checkpoint()
    legs = paths_to(found, best.where("node IS NOT NULL")).select("key", "node", "edge_ids")
    whole = F.when(F.col("node").isNull(), F.array("origin_edge")).otherwise(F.concat(F.array("origin_edge"), "edge_ids", F.array("destination_edge")))
    routed = best.join(legs, ["key", "node"], "left").select(F.col("key").alias("trip"), "origin_edge", "destination_edge", F.col("total").alias("cost"), whole.alias("edge_ids"))
    return trips.select("trip").join(routed, "trip", "left")


def check_routes(edges: DataFrame, routes: DataFrame, cost: str = "cost") -> DataFrame:
    """routes (name, origin, destination nodes) -> name, success, travel_time_seconds to one place, reason."""
    r = routes.select(F.col("name").alias("key"), "origin", "destination")
    ensure_checkpoints(edges.sparkSession)
    with stored(edges, cost, ids=False) as e:
        found = search_stored(e, r.select("key", F.col("origin").alias("node")), r.select("key", F.col("destination").alias("node")), ways=False).select("key", F.col("node").alias("destination"), "cost")
        ends = few(r.select(F.explode(F.array("origin", "destination")).alias("n")).distinct())
        nodes = e.select(F.explode(F.array("u", "v")).alias("n")).join(ends, "n", "left_semi").distinct().checkpoint()
    known = r.join(nodes.select(F.col("n").alias("origin"), F.lit(True).alias("_o")), "origin", "left").join(nodes.select(F.col("n").alias("destination"), F.lit(True).alias("_d")), "destination", "left")
    out = known.join(found, ["key", "destination"], "left")
    there = F.col("_o").isNotNull() & F.col("_d").isNotNull()
    good = there & F.col("cost").isNotNull()
    return out.select(F.col("key").alias("name"), good.alias("success"), F.when(good, F.bround("cost", 1)).alias("travel_time_seconds"), F.when(~there, NO_NODE).when(~good, NO_PATH).alias("reason"))


# How much dearer a used edge gets, and which routes are passed over: fixed values.
PENALTY, LONGEST, OVERLAP = 1.4, 2.0, 0.85


def alternatives(edges: DataFrame, requests: DataFrame, cost: str = "cost", length: str = "length_m", count: int = 3, tries: int = 14) -> DataFrame:
    """(key, place, cost, length, node_ids, edge_ids): up to count routes for each request (key, origin, destination), the fastest first.

    Every try searches for all requests at once; edges that a request's earlier tries used are dearer for it by
    1 + 1.4 * uses.  Routes that take over twice the fastest, or share .85 of the shorter one's length with one
    that was taken, are passed over.  A request is done when it has its routes or no path at all.
    """
    spark = edges.sparkSession
    ensure_checkpoints(spark)
    lengths = edges.select("edge_id", F.col(cost).cast("double").alias("_true"), F.col(length).cast("double").alias("_long"))
    kept = best_parallel(edges.select("u", "v", "edge_id", cost), cost)
    open_ = requests.select("key", "origin", "destination").checkpoint()
    used: DataFrame | None = None
    taken: DataFrame | None = None
    for _ in range(tries):
        if open_.isEmpty():
            break
        factors = None if used is None else used.select("key", "edge_id", (1 + PENALTY * F.col("uses")).alias("factor"))
        ends = open_.select("key", F.col("destination").alias("node"))
        found = search(kept, open_.select("key", F.col("origin").alias("node")), ends, cost, factors=factors)
        ways = paths_to(found, ends).select("key", "node_ids", "edge_ids").checkpoint()
        steps = ways.select("key", F.explode(F.array_distinct("edge_ids")).alias("edge_id")).join(lengths, "edge_id").checkpoint()
        size = steps.groupBy("key").agg(F.sum("_true").alias("cost"), F.sum("_long").alias("length"))
        new = ways.join(size, "key", "left").na.fill(0.0, ["cost", "length"])
        if taken is None:
            fits = new.withColumn("place", F.lit(1))
            taken = fits.select("key", "place", "cost", "length", "node_ids", "edge_ids").checkpoint()
        else:
            common = taken.select("key", "place", F.col("length").alias("_other"), F.explode("edge_ids").alias("edge_id")).distinct().join(steps, ["key", "edge_id"]).groupBy("key", "place", "_other").agg(F.sum("_long").alias("_both"))
            share = common.join(size.select("key", "length"), "key").groupBy("key").agg(F.max(F.col("_both") / F.greatest(F.least("_other", "length"), F.lit(1.0))).alias("_share"))
            have = taken.groupBy("key").agg(F.count("*").cast("int").alias("_have"), F.min_by("cost", "place").alias("_fastest"))
            fits = new.join(have, "key").join(share, "key", "left").where((F.col("cost") <= LONGEST * F.col("_fastest")) & (F.coalesce("_share", F.lit(0.0)) < OVERLAP))
            taken = taken.unionByName(fits.select("key", (F.col("_have") + 1).alias("place"), "cost", "length", "node_ids", "edge_ids")).checkpoint()
        again = steps.select("key", "edge_id", F.lit(1).alias("uses"))
        used = (again if used is None else used.unionByName(again)).groupBy("key", "edge_id").agg(F.sum("uses").alias("uses")).checkpoint()
        full = taken.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= count)
        open_ = open_.join(ways.select("key"), "key", "left_semi").join(full, "key", "left_anti").checkpoint()
    if taken is None:
        node, edge = edges.schema["u"].dataType.simpleString(), edges.schema["edge_id"].dataType.simpleString()
        return spark.createDataFrame([], f"key {requests.schema['key'].dataType.simpleString()}, place int, cost double, length double, node_ids array<{node}>, edge_ids array<{edge}>")
    return taken


def compare_routes(edges: DataFrame, restricted: DataFrame, requests: DataFrame, cost: str = "cost") -> DataFrame:
    """requests (key, origin, destination, requested, active) -> key, status, and cost and edge_ids before and under restrictions.

    Status: not_requested, inactive, available or no_route; the restricted route is searched for the last two only.
    """
    asked = requests.select("key", "origin", "destination", F.coalesce("requested", F.lit(False)).alias("requested"), F.coalesce("active", F.lit(False)).alias("active"))

    def routes(e: DataFrame, of: DataFrame, name: str) -> DataFrame:
        ends = of.select("key", F.col("destination").alias("node"))
        found = search(e, of.select("key", F.col("origin").alias("node")), ends, cost)
        return paths_to(found, ends).select("key", F.col("cost").alias(f"{name}_cost"), F.col("edge_ids").alias(f"{name}_edges"))

    out = asked.join(routes(edges, asked, "baseline"), "key", "left").join(routes(restricted, asked.where("requested AND active"), "restricted"), "key", "left")
    status = F.when(~F.col("requested"), "not_requested").when(~F.col("active"), "inactive").when(F.col("restricted_cost").isNull(), "no_route").otherwise("available")
    return out.select("key", status.alias("status"), "baseline_cost", "baseline_edges", "restricted_cost", "restricted_edges")
