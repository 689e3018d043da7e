"""Logs of runs with racing writers, checks of tables, and streams with capped state."""

from __future__ import annotations

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from lanewright.operators import evidence, validate
from lanewright.sources import readers, runs
from lanewright.streaming import streams


def test_lifecycle(spark, tmp_path):
    root = f"{tmp_path}/runs"
    first = runs.start(spark, root, "r1", "validation", "k", 7, graph_version="g")
    assert (first["status"], first["revision"], first["progress"]) == ("queued", 1, 0.0)
    with pytest.raises(runs.Conflict):
        runs.start(spark, root, "r1", "validation", "k", 7)
    with pytest.raises(ValueError):
        runs.start(spark, root, "r2", "other", "k", 7)
    with pytest.raises(KeyError):
        runs.get(spark, root, "none")
    runs.move(spark, root, "r1", "running", 1)
    with pytest.raises(runs.Conflict, match="expected"):
        runs.move(spark, root, "r1", "completed", 1)
    with pytest.raises(runs.Conflict, match="lead"):
        runs.move(spark, root, "r1", "cancelled")
    done = runs.move(spark, root, "r1", "completed", 2, summary_json="{}")
    assert done["progress"] == 1.0 and done["started_at"] and done["finished_at"]
    assert runs.cancel(spark, root, "r1") == runs.get(spark, root, "r1") == done
    runs.start(spark, root, "r2", "regional_comparison", "k", 8)
    assert runs.cancel(spark, root, "r2")["status"] == "cancel_requested"
    assert runs.cancel(spark, root, "r2")["revision"] == 2
    log = runs.states(spark, root)
    assert {(r.run_id, r.status, r.revision, r.graph_version) for r in runs.current(log).collect()} == {("r1", "completed", 3, "g"), ("r2", "cancel_requested", 2, None)}
    assert log.count() == 5 and runs.broken_steps(log).count() == 0


def test_one_writer_wins(spark, tmp_path):
    root, won, lost = f"{tmp_path}/runs", [], []
    runs.start(spark, root, "r", "validation", "k", 1)

    def write(i):
        try:
            won.append((i, runs.move(spark, root, "r", "running", 1, error_message=str(i))))
        except runs.Conflict:
            lost.append(i)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and len(lost) == 7
    assert runs.get(spark, root, "r")["error_message"] == str(won[0][0])
    assert [p.name for p in (tmp_path / "runs" / "r").iterdir() if p.suffix == ".json" and p.name.startswith("0")].__len__() == 2


def test_rename_without_overwriting(spark, tmp_path):
    jvm = spark._jvm
    (tmp_path / "a").write_text("a")
    (tmp_path / "b").write_text("b")
    path = lambda n: jvm.org.apache.hadoop.fs.Path(f"file:{tmp_path}/{n}")
    with pytest.raises(FileExistsError):
        runs._rename(spark, path("a"), path("b"))
    runs._rename(spark, path("a"), path("c"))
    assert (tmp_path / "c").read_text() == "a" and (tmp_path / "b").read_text() == "b"


def test_broken_steps(spark):
    rows = [("a", 1, "queued"), ("a", 2, "running"), ("a", 4, "completed"), ("b", 1, "running"), ("c", 1, "queued"), ("c", 2, "completed"),
            ("d", 1, "queued"), ("d", 1, "running"), ("e", 1, "queued"), ("e", 2, "lost"), ("f", 1, "queued"), ("f", 2, None), ("g", 1, "queued"), ("g", 2, "failed"), ("g", 3, "running")]
    log = spark.createDataFrame(rows, "run_id string, revision long, status string")
    got = {(r.run_id, r.revision, r.reason) for r in runs.broken_steps(log).collect()}
    assert got == {("a", 4, "revision missing"), ("b", 1, "no start"), ("c", 2, "not allowed"), ("d", 1, "revision repeats"), ("e", 2, "unknown status"), ("f", 2, "unknown status"), ("g", 3, "not allowed")}
    assert runs.broken_steps(log.limit(0)).count() == 0


def _chunks(spark, path, rows):
    spark.createDataFrame(rows, "chunk_id string, at string, station int, way string").coalesce(1).write.mode("append").json(path)


def test_capped_groups_over_restarts(spark, tmp_path):
    src, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    read = lambda most: streams.capped_groups(streams.read_chunks(spark, src, "chunk_id string, at timestamp, station int, way string"), ["station", "way"], most=most, late="0 seconds", hold_seconds=600)
    sink = lambda df, i: df.write.mode("append").parquet(out)
    seen = lambda: sorted((r.chunk_id, r.groups, r.closed) for r in spark.read.parquet(out).collect())
    _chunks(spark, src, [("c1", "2024-01-01T00:00:00Z", 1, "n"), ("c1", "2024-01-01T00:01:00Z", 1, "n"), ("c1", "2024-01-01T00:01:00Z", 1, None), ("c2", "2024-01-01T00:01:00Z", None, "s")])
    streams.run_available(read(3), sink, check)
    assert seen() == [("c1", 2, False), ("c2", 1, False)]
    # A restart goes on with what is known: one more group, then the cap.
    _chunks(spark, src, [("c1", "2024-01-01T00:02:00Z", 2, "n"), ("c1", "2024-01-01T00:02:00Z", 1, "n")])
    streams.run_available(read(3), sink, check)
    assert ("c1", 3, False) in seen() and len(seen()) == 3
    # Time passes both chunks: they are closed and start from nothing.
    _chunks(spark, src, [("c3", "2024-01-01T02:00:00Z", 9, "n")])
    streams.run_available(read(3), sink, check)
    assert {("c1", 3, True), ("c2", 1, True), ("c3", 1, False)} <= set(seen())
    _chunks(spark, src, [("c3", "2024-01-01T02:00:01Z", i, "n") for i in range(4)])
    with pytest.raises(Exception, match="over 3 groups"):
        streams.run_available(read(3), sink, check)


def test_stored_faults(spark):
    trip = dict(id="t", graph_version="g", departure_time="x", day_type="friday", corridor_label="c", actual_travel_seconds=5.0, incident_flag=0, created_at="x", updated_at="x", origin_node="a", destination_node="b", origin_zone=None, destination_zone=None, reported_no_traffic_seconds=None)
    rows = [trip, trip | {"origin_zone": "z"}, trip | {"destination_node": None}, trip | {"day_type": "noday", "actual_travel_seconds": 0.0}, trip | {"id": None, "incident_flag": 2},
            trip | {"origin_node": None, "destination_node": None, "origin_zone": "y", "destination_zone": "z"}, trip | {"reported_no_traffic_seconds": -1.0}]
    kind = ", ".join(f"{k} {'double' if k.endswith('seconds') else 'int' if k == 'incident_flag' else 'string'}" for k in trip)
    table = spark.createDataFrame([tuple(r.values()) for r in rows], kind)
    assert sorted(r["_broken"] for r in validate.stored_faults(table, "benchmark_trips").collect()) == [["day_type", "actual_travel_seconds"], ["ends"], ["ends"], ["id is null", "incident_flag"], ["reported_no_traffic_seconds"]]
    assert validate.stored_faults(table.drop("reported_no_traffic_seconds"), "benchmark_trips").count() == 4
    assert validate.stored_faults(table.limit(0), "benchmark_trips").count() == 0
    with pytest.raises(ValueError, match="day_type"):
        validate.stored_faults(table.drop("day_type"), "benchmark_trips")
    faults = validate.violations(spark.createDataFrame([(1, "queued"), (2, "lost"), (3, None)], "id int, status string"), {"status": validate.CHECKS["simulation_runs"]["status"]})
    assert [r.id for r in faults.collect()] == [2]


def test_first_status(spark):
    rows = spark.createDataFrame([("a", 2, "late"), ("a", 1, "z"), ("a", 1, "y"), ("b", None, "n")], "k string, at int, status string")
    assert sorted(map(tuple, validate.first_status(rows, ["k"], ["at"]).collect())) == [("a", "y"), ("b", "n")]


def test_gateway_connectors(spark, tmp_path):
    row = {"gateway_id": " g1 ", "inbound_sumo_edge_id": "i", "outbound_sumo_edge_id": "o"}
    good = {"schema_version": 1, "sumo_network_version": "v", "sumo_network_sha256": "s", "gateway_count": 2, "gateways": [row, row | {"gateway_id": "g2", "evidence": "seen"}]}

    def read(**change):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        path.write_text(json.dumps(good | change, indent=1))
        return sorted(map(tuple, readers.gateway_connectors(spark, str(path), "v", "s").collect()))

    assert read() == [("g1", "i", "o", "reviewed_gateway_connector"), ("g2", "i", "o", "seen")]
    for why, change in [("schema", {"schema_version": 2}), ("version of", {"sumo_network_version": "w"}), ("checksum", {"sumo_network_sha256": None}), ("no gateways", {"gateways": []}), ("no gateways", {"gateways": None}),
                        ("without", {"gateways": [row, row | {"gateway_id": " "}]}), ("twice", {"gateways": [row, row]}), ("number", {"gateway_count": 3})]:
        with pytest.raises(ValueError, match=why):
            read(**change)


def test_toggles_of_nulls_and_ties(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = [(k, t, (t * 7 + k) % 5 < 2) for k in range(3) for t in range(200)] + [(9, 1, None), (9, 2, True), (9, 3, None)]
    kind = "edge_id int, at int, active boolean"
    spark.createDataFrame(rows, kind).repartition(3).write.json(src)
    streams.run_available(streams.toggles(streams.read_chunks(spark, src, kind)), lambda df, i: df.write.mode("append").parquet(out), f"{tmp_path}/check")
    want = streams.toggles_batch(spark.createDataFrame(rows, kind).withColumn("active", F.coalesce("active", F.lit(False))))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, want.collect()))


def test_cancelled_streams_and_timings(spark, tmp_path):
    root, src, out, check = (f"{tmp_path}/{x}" for x in ("runs", "in", "out", "check"))
    kind = "edge_id int, at int, active boolean"
    for i in range(4):
        spark.createDataFrame([(i, i, True)], kind).coalesce(1).write.mode("append").json(src)
    runs.start(spark, root, "r", "validation", "k", 1)
    runs.move(spark, root, "r", "running")
    told = []

    def sink(df, i):
        df.write.mode("overwrite").parquet(f"{out}/{i}")
        if i == 1:
            runs.cancel(spark, root, "r")
            time.sleep(3)

    read = lambda: streams.toggles(streams.read_chunks(spark, src, kind, 1))
    streams.run_available(read(), sink, check, cancelled=lambda: runs.is_cancelled(spark, root, "r"), report=told.append)
    assert runs.get(spark, root, "r")["status"] == "cancel_requested"
    assert len(list((tmp_path / "out").iterdir())) < 4
    assert {"triggerExecution"} <= {r.phase for r in told[0].collect()} and told[0].columns == ["batch_id", "input_rows", "phase", "ms"]
    # The next run takes up what is left; a batch done again writes its own folder anew.
    streams.run_available(read(), lambda df, i: df.write.mode("overwrite").parquet(f"{out}/{i}"), check)
    assert sorted(r.edge_id for r in spark.read.parquet(f"{out}/*").collect()) == [0, 1, 2, 3]


def test_place_keys_with_escapes(spark):
    texts = ['{"lat": 1}', '{"\\u006Cat": 1}', '{"\\u004c\\u0041T": 1}', '{"\\\\u006cat": 1}', '{"note": "\\"lat\\": 5"}', '{"a": [{"LNG" : 2}], "lat": 0}', None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", evidence.place_keys(F.col("t")).alias("k")).collect()
    assert [r.k for r in sorted(rows)] == [["lat"], ["lat"], ["lat"], [], [], ["lat", "lng"], [], []]


def test_campaign_faults(spark):
    good = dict(name="a-1", start_date="2024-01-01", end_date="2024-01-31", highway_ids=[1, 2], resolution=None, days_of_week=[2, 3], chunk_days=1, delay_ms=100, request_timeout_ms=10000, max_retries=0, max_response_bytes=None, max_groups_per_chunk=1000000)
    cases = [({}, None), ({"name": "-a"}, ["name"]), ({"name": None}, ["name"]), ({"end_date": "2023-12-31"}, ["end_date"]), ({"end_date": "2027-01-01"}, ["days"]), ({"start_date": None}, ["start_date is null"]),
             ({"highway_ids": []}, ["highway_ids"]), ({"highway_ids": None}, ["highway_ids"]), ({"highway_ids": [1, None]}, ["highway_ids"]), ({"highway_ids": list(range(1, 66))}, ["highway_ids"]), ({"resolution": "00:05:00"}, ["resolution"]),
             ({"days_of_week": [8], "max_retries": 11}, ["days_of_week", "max_retries"]), ({"days_of_week": None}, None), ({"delay_ms": 99}, ["delay_ms"])]
    kind = "i int, name string, start_date string, end_date string, highway_ids array<int>, resolution string, days_of_week array<int>, chunk_days int, delay_ms int, request_timeout_ms int, max_retries int, max_response_bytes long, max_groups_per_chunk long"
    table = spark.createDataFrame([(i, *(good | c).values()) for i, (c, _) in enumerate(cases)], kind).withColumns({c: F.col(c).cast("date") for c in ("start_date", "end_date")})
    assert {r.i: r["_broken"] for r in validate.campaign_faults(table).collect()} == {i: w for i, (_, w) in enumerate(cases) if w}


def test_missing_dates(spark):
    rows = spark.createDataFrame([("2024-01-01",), ("2024-01-01",), ("2024-01-03",), (None,), ("2025-01-01",)], "d string")
    r = evidence.missing_dates(rows, "d", "2024-01-01", "2024-01-07", (1, 2, 3), 1).head()
    assert (r.severity, r.n, r.rate_percent, [str(d) for d in r.examples]) == ("medium", 1, 33.3333, ["2024-01-02"])
    assert evidence.missing_dates(rows, "d", "2024-01-01", "2024-01-01").count() == 0
    assert evidence.missing_dates(rows.limit(0), "d", "2024-01-01", "2024-01-02").head().n == 2
