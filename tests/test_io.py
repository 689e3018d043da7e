"""Sources, sinks and streams on small files."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lanewright.sources import readers, sinks
from lanewright.streaming import streams


def test_csv_and_parquet(spark, tmp_path):
    (tmp_path / "a.csv").write_text(' Name ,Note\n"x ""y""","a,b"\nz,\n')
    df = readers.table(spark, f"{tmp_path}/a.csv")
    assert df.columns == ["name", "note"] and [tuple(r) for r in df.collect()] == [('x "y"', "a,b"), ("z", None)]
    sinks.partitioned(df.withColumn("month", F.when(F.col("name") == "z", 3)), f"{tmp_path}/p", ["month"])
    back = readers.parquet(spark, f"{tmp_path}/p", ["name", "month"], "month = '3'")
    assert [tuple(r) for r in back.collect()] == [("z", "3")]
    assert readers.parquet(spark, f"{tmp_path}/p").where("month = 'unknown'").count() == 1
    with pytest.raises(ValueError):
        readers.table(spark, "a.xls")


def test_features(spark, tmp_path):
    feature = lambda kind, c, **p: {"type": "Feature", "properties": p, "geometry": {"type": kind, "coordinates": c}}
    doc = {"type": "FeatureCollection", "features": [feature("Point", [1.5, 2], id="a"), feature("LineString", [[0, 0], [1, 1]], id="b"), feature("MultiLineString", [[[0, 0], [1, 1]], [[5, 5], [6, 6], [7, 7]]], id="c")]}
    (tmp_path / "f.geojson").write_text(json.dumps(doc))
    p = readers.point_features(spark, f"{tmp_path}/f.geojson").head()
    assert (p.x, p.y, p.properties["id"]) == (1.5, 2.0, "a")
    lines = {r.properties["id"]: [tuple(q) for q in r.line] for r in readers.line_features(spark, f"{tmp_path}/f.geojson").collect()}
    assert lines == {"b": [(0.0, 0.0), (1.0, 1.0)], "c": [(5.0, 5.0), (6.0, 6.0), (7.0, 7.0)]}


def test_xml(spark, tmp_path):
    (tmp_path / "n.xml").write_text('<net><edge id=":in" function="internal"><lane id=":in_0" length="1" speed="2"/></edge><edge id="A_B"><lane id="A_B_0" length="100.5" speed="13.89"/><lane id="A_B_1" length="99" speed="13.89"/></edge></net>')
    assert [tuple(r) for r in readers.network_edges(spark, f"{tmp_path}/n.xml").collect()] == [("A_B", 100.5, 2)]
    (tmp_path / "r.xml").write_text('<routes><vehicle id="v" depart="1.5"><route edges="A_B B_C"/></vehicle></routes>')
    r = readers.routes(spark, f"{tmp_path}/r.xml").head()
    assert (r.vehicle_id, r.depart, r.edge_ids) == ("v", 1.5, ["A_B", "B_C"])
    (tmp_path / "t.xml").write_text('<tripinfos><tripinfo id="v" depart="1" arrival="5" duration="4" routeLength="9"/></tripinfos>')
    assert readers.trip_info(spark, f"{tmp_path}/t.xml").head().duration == 4.0


def test_files_and_logs(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin.part").write_bytes(b"abc")
    sha = hashlib.sha256(b"abc").hexdigest()
    manifest = spark.createDataFrame([("a.bin", 3, sha), ("b.bin.part", 3, sha), ("c.bin", 3, sha)], "name string, bytes long, sha256 string")
    assert {r.name: r.verified for r in readers.verified_files(spark, str(tmp_path), manifest).collect()} == {"a.bin": True, "b.bin.part": False, "c.bin": False}
    (tmp_path / "x.log").write_text("Warning: no connection\nfine\nTeleporting vehicle\n")
    assert {r.category: r.n for r in readers.log_categories(spark, f"{tmp_path}/x.log", {"connection": "no connection", "teleport": "teleporting"}).collect()} == {"connection": 1, "teleport": 1, "other": 1}
    (tmp_path / "g.json").write_text(json.dumps({"gateways": [{"gateway_id": "g", "movement": m, "edge_id": m[0], "crossing_lon": 1.0, "crossing_lat": 2.0} for m in ("outbound", "inbound")]}))
    assert [r.movement for r in readers.gateways(spark, f"{tmp_path}/g.json").collect()] == ["inbound", "outbound"]


def test_keyed_sinks(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert [tuple(r) for r in sinks.insert_new(old, new, ["k"]).collect()] == [("c", 4)]
    log = spark.createDataFrame([("s", "x", False, 1, 1)], "id string, body string, deleted boolean, created_at int, revision int")
    row = spark.createDataFrame([("s", "y", False, 2)], "id string, body string, deleted boolean, created_at int")
    log = sinks.append_revision(log, "id", "s", 1, row)
    assert [r.body for r in sinks.latest_revisions(log, "id").collect()] == ["y"]
    with pytest.raises(ValueError):
        sinks.append_revision(log, "id", "s", 1, row)


def test_streams(spark, tmp_path):
    rows = [("e1", 10, True), ("e1", 20, True), ("e1", 30, False), ("e2", 5, False)]
    src, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    spark.createDataFrame(rows, "edge_id string, at int, active boolean").coalesce(1).write.json(src)
    sink = lambda df, i: df.write.mode("append").parquet(out)
    read = lambda: streams.toggles(streams.read_chunks(spark, src, "edge_id string, at int, active boolean"))
    streams.run_available(read(), sink, check)
    spark.createDataFrame([("e1", 40, False), ("e1", 50, True)], "edge_id string, at int, active boolean").coalesce(1).write.mode("append").json(src)
    streams.run_available(read(), sink, check)
    streams.run_available(read(), sink, check)
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    every = spark.read.schema("edge_id string, at int, active boolean").json(src)
    assert got == sorted(map(tuple, streams.toggles_batch(every).collect())) == [("e1", 10, True), ("e1", 30, False), ("e1", 50, True), ("e2", 5, False)]


def test_windows_of_streams_equal_batches(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").write.json(src)
    stream = streams.windowed(streams.read_chunks(spark, src, "event_id long, ts timestamp, event_type string, value double"), "ts", ["event_type"], "value")
    streams.run_available(stream, lambda df, i: df.write.mode("overwrite" if i == 0 else "append").parquet(out), f"{tmp_path}/check", "complete")
    batch = streams.windowed(spark.read.schema("event_id long, ts timestamp, event_type string, value double").json(src), "ts", ["event_type"], "value")
    assert sorted(map(tuple, spark.read.parquet(out).select("start", "event_type", "n").distinct().collect())) == sorted(map(tuple, batch.select("start", "event_type", "n").collect()))


def test_ledger(spark):
    have = spark.createDataFrame([("c1", "x")], "chunk_id string, sha256 string")
    assert [r.chunk_id for r in streams.ledger_new(spark.createDataFrame([("c1", "x"), ("c2", "y")], have.schema), have).collect()] == ["c2"]
    with pytest.raises(ValueError):
        streams.ledger_new(spark.createDataFrame([("c1", "z")], have.schema), have)
