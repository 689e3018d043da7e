"""Operators of evidence against small cases worked out by hand."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from lanewright.functions import geo, hashing
from lanewright.operators import evidence, frames, validate
from lanewright.sources import readers, sinks


def test_approach_edges(spark):
    steps = [("p", 0, "a", 400.0), ("p", 1, "b", 2800.0), ("p", 2, "c", 0.0), ("p", 3, "d", 600.0), ("p", 4, "x", 50.0), ("p", 5, "e", 9000.0), ("q", 0, "f", 100.0), ("q", 1, "a", None), ("r", 0, "x", -5.0), ("r", 1, "g", 700.0)]
    s = spark.createDataFrame(steps, "path_id string, position long, edge_id string, length double")
    closed = spark.createDataFrame([("x",), ("x",), ("lone",), (None,)], "edge_id string")
    # 600 m before x lies d's start, 3000 m before it lies b; a begins p, x begins r; q meets no closure.
    assert {r.edge_id for r in evidence.approach_edges(s, closed).collect()} == {"a", "d", "b", "x", "lone"}
    assert evidence.approach_edges(s.limit(0), closed.limit(0)).count() == 0


def test_acceptance_and_findings(spark):
    m = spark.createDataFrame([("primary", "e2", 0.9, "accepted"), ("primary", "e1", 0.9, "accepted"), ("primary", "e3", 1.0, "review"), ("trunk", "e4", 0.5, None)], "road_class string, edge string, score double, status string")
    got = {r.road_class: (r.total, r.accepted, r.accepted_percent, r.representative) for r in evidence.class_acceptance(m, "road_class", "edge", "score").collect()}
    assert got == {"primary": (3, 2, 66.667, "e1"), "trunk": (1, 0, 0.0, None)}
    found = evidence.findings(spark.createDataFrame([(200, 0, 3, 1, None)], "rows long, duplicate_keys long, missing_speed long, invalid_speed long, low_sample long"))
    assert [tuple(r) for r in found.collect()] == [("medium", "missing_or_invalid_speed", 4, 2.0)]
    assert evidence.review_status(found).head()[0] == "PASS"
    assert evidence.review_status(found.withColumn("severity", F.lit("high"))).head()[0] == "REVIEW REQUIRED"


def test_gates(spark):
    period = "holdout_edge_count long, holdout_path_coverage double, holdout_wape double, positive_flow_edge_percent double, flow_conservation_max_error_vph double"
    rows = [(20, 0.7, 0.5, 15.0, 1e-6), (19, 0.7, 0.5, 15.0, 1e-6), (20, 0.7, None, 15.0, 0.0)]
    assert [r[0] for r in spark.createDataFrame(rows, period).coalesce(1).select(evidence.period_gate()).collect()] == [True, False, False]
    graph = "node_count long, edge_count long, largest_weak_percent double, invalid_geometry long, zero_length long, missing_speed long, failed_routes long"
    rows = [(9, 9, 95.0, 0, 0, 0, 0), (0, 9, 90.0, 0, 2, 0, 1)]
    assert [r[0] for r in spark.createDataFrame(rows, graph).coalesce(1).select(evidence.graph_failures()).collect()] == [[], ["empty", "disconnected", "length", "routes"]]


def test_deltas_and_connectors(spark):
    b, s = (spark.createDataFrame(x, "k string, seconds double") for x in ([("a", 10.0), ("b", 1.0)], [("a", 12.3456), ("c", 2.0)]))
    assert {r.k: r.seconds for r in evidence.deltas(b, s, ["k"], ["seconds"]).collect()} == {"a": 2.346, "b": None, "c": None}
    z = spark.createDataFrame([("internal", "motorway"), ("external", "motorway"), ("internal", "tertiary"), ("other", "trunk"), (None, None)], "z string, c string").coalesce(1)
    assert [r[0] for r in z.select(evidence.connects(F.col("z"), F.col("c"))).collect()] == [False, True, True, False, False]


def test_private_keys_and_ids(spark):
    texts = ['{"a": [{"Lat": 1}, {"b": {"coordinates": []}}]}', '{"a": "lat", "b": ": lng"}', "", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(evidence.place_keys(F.col("t"))).collect()
    assert [r[0] for r in got] == [["coordinates", "lat"], [], [], []]
    names = ["", "portal|é|1", "x" * 1000]
    got = spark.createDataFrame([(n,) for n in names], "n string").coalesce(1).select(hashing.uuid5(str(uuid.NAMESPACE_URL), F.col("n"))).collect()
    assert [r[0] for r in got] == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_lines_and_directions(spark):
    line = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (3.0, 4.0), (3.0, 4.0), (3.0, 10.0))))
    at = lambda d: geo.along_line(line, F.lit(d))
    r = spark.range(1).select(*(at(d).alias(f"p{i}") for i, d in enumerate((-1.0, 2.5, 5.0, 8.0, 99.0))), geo.place_on_line(F.lit(10.0), F.lit(7.0), line).alias("m"), geo.along_line(F.slice(line, 1, 0), F.lit(1.0)).alias("none")).head()
    assert [tuple(r[f"p{i}"]) for i in range(5)] == [(0.0, 0.0), (1.5, 2.0), (3.0, 4.0), (3.0, 7.0), (3.0, 10.0)] and r.m == 8.0 and r.none is None
    e = spark.createDataFrame([(1, "f", "a", "b"), (2, "f", "b", "a"), (3, "f", "b", "a"), (4, "g", "b", "a")], "edge_id long, fingerprint string, u string, v string")
    assert {tuple(x) for x in evidence.both_directions(e).collect()} == {("f", "a", "b", 1, 2), ("g", "a", "b", None, 4)}


def test_frames_between(spark):
    f = spark.createDataFrame([("r", 0, "a", 0.0, 0.0), ("r", 10, "a", 10.0, 20.0), ("r", 0, "b", 5.0, 5.0), ("r", 10, "c", 1.0, 1.0)], "run string, elapsed int, agent string, x double, y double")
    asked = spark.createDataFrame([("r", 2.5), ("r", 10.0), ("r", -3.0), ("r", 99.0), ("none", 1.0)], "run string, at double")
    got = {(r["at"], r.agent): (r.x, r.y) for r in frames.between(f, asked).collect()}
    assert got == {(2.5, "a"): (2.5, 5.0), (2.5, "b"): (5.0, 5.0), (10.0, "a"): (10.0, 20.0), (10.0, "b"): (5.0, 5.0), (-3.0, "a"): (0.0, 0.0), (-3.0, "b"): (5.0, 5.0), (99.0, "a"): (10.0, 20.0), (99.0, "c"): (1.0, 1.0)}


def test_stations_imports_and_only_rows(spark):
    s = spark.createDataFrame([({"stationid": " 1 ", "highwayid": "5"}, 1.0, 2.0), ({"stationid": "2", "highwayid": "9"}, 1.0, 2.0), ({"stationid": "3", "highwayid": "5"}, None, None), ({"stationid": "4"}, 0.0, 0.0)], "properties map<string,string>, x double, y double")
    h = spark.createDataFrame([(5, " I-5 ")], "highwayid int, highwayname string")
    seen = spark.createDataFrame([(f"portal-station-{i}",) for i in (1, 1, 2, 3)], "station_id string")
    got = {r.station_id[-1]: (r.highway, r.reason) for r in readers.observed_stations(s, h, seen).collect()}
    assert got == {"1": ("I-5", None), "2": (None, "unknown_highway"), "3": ("I-5", "no_point")}
    old, new = (spark.createDataFrame(x, "id string, trip struct<start:string>") for x in ([("a", ("n1",))], [("b", ("n2",)), ("c", None)]))
    assert sinks.import_all(old, new, "id").count() == 3
    for bad in (old, new.union(new), spark.createDataFrame([("d", (1.0,))], "id string, trip struct<lat:double>")):
        with pytest.raises(ValueError):
            sinks.import_all(old, bad, "id")
    assert validate.only_row(new, F.col("id") == "b").id == "b"
    for condition in (F.lit(True), F.lit(False)):
        with pytest.raises(LookupError):
            validate.only_row(new, condition)
