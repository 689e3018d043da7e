"""Golden values of small fixtures: rows in, literals out."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lanewright.functions import clean, geo, hashing, text, times
from lanewright.operators import flows, matching, observations, od, paths, priors, profiles, routing, sampling, scenarios, schedules, spatial, validate


def one(df):
    return df.head()


def scalar(spark, c):
    return spark.range(1).select(c.alias("x")).head().x


def test_traps(spark):
    df = spark.createDataFrame([(float("nan"), "abc"), (None, None), (3.0, "4.5")], "a double, b string")
    got = df.select(clean.number("a").alias("a"), clean.number("b").alias("b"), clean.clip(clean.number("b"), 1, 2).alias("c"), clean.ratio(F.col("a"), F.lit(0.0)).alias("d")).collect()
    assert [tuple(r) for r in got] == [(None,) * 4, (None,) * 4, (3.0, 4.5, 2.0, None)]
    assert clean.nan_to_null(df).where("a IS NULL").count() == 2
    assert scalar(spark, clean.canonical_id(F.lit("123.0"))) == "123" and scalar(spark, clean.blank_to_null(F.lit(" NaN "))) is None


LANES = [("s10", "t", "NORTH", 40.0, 10.0, 8.0, 45.0), ("s10", "t", "NORTH", 45.0, 20.0, 12.0, 45.0)]


def test_lanes_to_stations(spark):
    lanes = spark.createDataFrame(LANES, "station string, ts string, direction string, speed double, volume double, occupancy double, countreadings double")
    r = one(observations.lanes_to_stations(lanes, ["station", "ts", "direction"]))
    assert (r.volume, r.occupancy, r.quality_flag) == (120.0, 10.0, "good") and r.speed_kph == pytest.approx(69.73824)
    low = lanes.withColumn("countreadings", F.lit(3.0))
    assert one(observations.lanes_to_stations(low, ["station"])).quality_flag == "low_sample"


def test_enrich(spark):
    rows = [("station-1", "2025-09-08T08:00:00-07:00", "80", "1200", "10", "good"), ("station-1", "2025-09-08T08:15:00-07:00", None, "0", "101", "low_sample"), ("station-1", "2025-09-09T00:00:00-07:00", "50", "1", None, "good"), ("x", "no date", "50", "1", None, None)]
    df = spark.createDataFrame(rows, "station_or_segment_id string, timestamp_local string, speed_kph string, volume string, occupancy string, quality_flag string")
    out = observations.enrich(observations.in_dates(df, "timestamp_local", "2025-09-08", "2025-09-08"))
    got = out.orderBy("timestamp_local").collect()
    assert [r.minute_of_day for r in got] == [480, 495] and [r.profile_eligible for r in got] == [True, False]
    assert not observations.enrich(df).where("station_or_segment_id = 'x'").head().profile_eligible


def test_profile_compile(spark):
    rows = [("station-1", "2025-09-08", 480, 80.0, 1000.0), ("station-1", "2025-09-09", 480, 64.0, 1200.0), ("station-1", "2025-09-08", 900, 50.0, 1400.0), ("station-2", "2025-09-08", 480, 70.0, 800.0), ("station-1", "2025-09-08", 720, 60.0, 900.0)]
    obs = spark.createDataFrame([(*r, 1, True) for r in rows], "station_or_segment_id string, local_date string, minute_of_day int, speed_kph double, volume double, iso_weekday int, profile_eligible boolean")
    matches = spark.createDataFrame([("station-1", "edge-1", "accepted"), ("station-2", "edge-2", "review")], "station_id string, edge_id string, status string")
    selected = profiles.eligible_rows(obs)
    joined = profiles.with_edges(selected, matches)
    assert selected.count() == 4 and joined.where("edge_id IS NULL").count() == 1
    out = profiles.bucket_medians(joined.where("edge_id IS NOT NULL"), ["period", "bucket_minute", "edge_id"], "speed_kph", "volume", "station_or_segment_id")
    m = one(out.where("period = 'morning'"))
    assert out.count() == 2 and (m.speed_median, m.volume_median, m.n) == (72.0, 1100.0, 2)
    s = one(profiles.snapshot(out, 487))
    assert (s.edge_id, s.flow, s.speed, s.bucket_minute) == ("edge-1", 1100.0, 72.0, 480)


def test_import_quality(spark):
    rows = [("E", "2025-09-08T07:00:00", "900", "25", "good"), ("E", "2025-10-06T08:00:00", "850", "40", "good"), ("E", "2025-09-08T16:00:00", "1100", "20", "good"), ("E", "2025-10-06T17:00:00", None, "30", "reviewed"), ("unmatched", "not-a-date", "100", "0", "bad")]
    df = validate.with_optional(spark.createDataFrame(rows, "station_or_segment_id string, timestamp_local string, volume string, speed_kph string, quality_flag string"), {"travel_time_seconds": "double"})
    r = one(observations.import_quality(observations.accept_import(df, spark.createDataFrame([("E",)], "edge_id string"))))
    assert (r.n_rows, r.accepted, r.rejected, r.matched_stations, r.unmatched_stations, r.missing_speed, r.missing_volume) == (5, 4, 1, 1, 1, 20.0, 20.0)
    assert r.flags == ["bad", "good", "reviewed"]


def day_schedule(spark):
    rows = [(d, m, "det", "edge", float(o + m), "observed_historical_input", ["a"] if d == "friday" else ["b"]) for d, o in (("mon_thu", 0), ("friday", 100), ("saturday", 200), ("sunday", 300)) for m in range(0, 1440, 15)]
    rows = [(*r[:5], "modeled_unobserved" if r[0] in ("saturday", "sunday") else r[5], r[6]) for r in rows]
    return spark.createDataFrame(rows, "day_type string, bucket_start_minute int, detector_id string, app_edge_id string, volume_mean double, evidence_level string, quality_flags array<string>")


def test_state_at(spark):
    s, pacific = day_schedule(spark), timezone(timedelta(hours=-7))
    r = one(schedules.state_at(s, datetime(2025, 9, 8, 7, 22, tzinfo=pacific), ["detector_id", "app_edge_id"], ["volume_mean"]))
    assert r.volume_mean == pytest.approx(442.0)
    assert schedules.bracket(datetime(2025, 9, 8, 7, 22, tzinfo=pacific)) == (("mon_thu", 435), ("mon_thu", 450), pytest.approx(7 / 15))
    assert schedules.bracket(datetime(2025, 9, 12, 23, 59, tzinfo=pacific))[:2] == (("friday", 1425), ("saturday", 0))
    r = one(schedules.state_at(s, datetime(2025, 9, 12, 23, 59, tzinfo=pacific), ["detector_id"], ["volume_mean"]))
    assert r.evidence_level == "modeled_unobserved" and r.quality_flags == ["a", "b"]
    with pytest.raises(ValueError):
        schedules.bracket(datetime(2025, 9, 8, 7, 22))


def test_compile_schedule(spark):
    rows = [("d1", "mon_thu", 0, 10.0, 50.0), ("d1", "mon_thu", 30, 20.0, 60.0), ("d1", "mon_thu", 1425, 40.0, 60.0)]
    df = spark.createDataFrame(rows, "detector_id string, day_type string, bucket int, volume double, speed double")
    out = schedules.compile_schedule(df, ["detector_id"], {"volume": (25.0, 240), "speed": (1.0, 160)}, {"p50": 0.5, "p90": 0.9})
    got = {(r.day_type, r.bucket): r for r in out.collect()}
    assert len(got) == 384 and got["mon_thu", 15].volume_mean == 15.0 and got["mon_thu", 15].evidence_level == "modeled_gap_fill"
    assert got["friday", 0].volume_mean == 10.0 and got["friday", 0].evidence_level == "modeled_gap_fill"
    assert got["sunday", 30].volume_mean == 20.0 and got["sunday", 30].evidence_level == "modeled_unobserved"
    assert got["mon_thu", 0].volume_p50 == 12.5 and got["mon_thu", 0].speed_p90 == 50.5
    checks = {r.check: r.passed for r in schedules.schedule_gate(out, ["volume_mean", "speed_mean"], [["volume_p50", "volume_p90"]]).collect()}
    assert all(checks.values()) and len(checks) == 7


def test_text(spark):
    assert scalar(spark, text.tagged_speed(F.lit("35 mph"))) == pytest.approx(35 * 1.609344)
    assert scalar(spark, text.tagged_speed(F.lit('["45 mph", "35 mph"]'))) == pytest.approx(35 * 1.609344)
    assert scalar(spark, text.tagged_speed(F.lit("signals"))) is None and scalar(spark, text.tagged_number(F.lit("2; 3;x"))) == 3.0
    assert scalar(spark, text.road_name(F.lit("NE Martin Luther King Jr Boulevard"))) == "MARTIN LUTHER KING JR BLVD"
    assert scalar(spark, text.road_ref(F.lit("I 5;US 26"))) == "I-5"
    assert scalar(spark, text.route_tokens(F.lit("I–5 / us26 and SR 14"))) == ["I5", "US26", "WA14"]
    assert [scalar(spark, text.road_form(F.lit(x))) for x in ("Exit ramp", "I-5 @ Main", "I5 to NB I205", "x")] == ["link", "mainline", "link", "unknown"]
    assert [scalar(spark, text.direction_bearing(F.lit(x))) for x in ("NB", "South-West bound", "?")] == [0.0, 225.0, None]
    agree = lambda a, b: scalar(spark, text.names_agree(F.lit(a), F.lit(""), F.lit(b), F.lit("")))
    assert agree("MAIN ST", "MAIN AVE") and not agree("OAK ST", "MAIN ST")
    assert scalar(spark, text.json_list(F.lit('["a","b"]'))) == ["a", "b"] and scalar(spark, text.json_list(F.lit("plain"))) == ["plain"]
    assert scalar(spark, text.human_bytes(F.lit(1536))) == "1.5 KB"


def test_geo(spark):
    lon, lat = geo.web_mercator_to_lonlat(F.lit(-13661137.0), F.lit(5700582.7))
    assert -123 < scalar(spark, lon) < -122 and 45 < scalar(spark, lat) < 46
    e, n = geo.lonlat_to_utm10(F.lit(-123.0), F.lit(45.0))
    assert scalar(spark, e) == pytest.approx(500000.0, abs=1e-3) and scalar(spark, n) == pytest.approx(4982950.4, abs=0.5)
    line = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (0.0, 10.0), (10.0, 10.0))))
    assert scalar(spark, geo.point_line(F.lit(5.0), F.lit(12.0), line)) == 2.0 and scalar(spark, geo.line_length(line)) == 20.0
    assert scalar(spark, geo.overlap_fraction(line, line, 0.1)) == 1.0
    assert scalar(spark, geo.fingerprint(line)) == scalar(spark, geo.fingerprint(F.reverse(line)))
    assert scalar(spark, geo.bearing_difference(F.lit(350.0), F.lit(10.0))) == 20.0
    assert scalar(spark, geo.cell(F.lit(-0.5), 1.0)) == -1


def station_pairs(spark, edges):
    line = lambda x, down: [(float(x), 5040100.0), (float(x), 5039900.0)] if down else [(float(x), 5039900.0), (float(x), 5040100.0)]
    st = spark.createDataFrame([("s", 525000.0, 5040000.0, 0.0, ["I5"], "mainline")], "station_id string, x double, y double, target_bearing double, target_tokens array<string>, road_form string")
    ed = spark.createDataFrame([(n, c, t, line(x, d)) for n, x, d, c, t in edges], "edge_id string, road_class string, tokens array<string>, line array<struct<x:double,y:double>>")
    pairs = spatial.points_near_lines(st, ed, 250.0).withColumn("bearing", geo.line_bearing(F.col("line")))
    return one(matching.select_matches(matching.score_candidates(pairs)))


def test_station_match(spark):
    r = station_pairs(spark, [("north", 525005, False, "motorway", ["I5"]), ("south", 524995, True, "motorway", ["I5"])])
    assert (r.edge_id, r.status, r.bearing_difference) == ("north", "accepted", 0.0)
    r = station_pairs(spark, [("only", 525000, False, "motorway", ["I205"])])
    assert r.status == "review" and "route_reference_mismatch" in r.reasons


def test_authority(spark):
    rows = [("e", "s1", 40.0, 94.0, True), ("e", "s2", 56.0, 92.0, True), ("f", "s3", 40.2336, 96.0, True)]
    df = spark.createDataFrame(rows, "edge_id string, source string, speed double, score double, eligible boolean")
    got = {r.edge_id: r for r in matching.select_authority(df, "edge_id", "score", "speed", "source").collect()}
    assert got["e"].ambiguous and not got["e"].selected and got["f"].selected


PATHS = [("a", ["1", "2", "3"], ["edge-1", "edge-2"], 1.0), ("b", ["1", "2", "4"], ["edge-1", "edge-3"], 1.0), ("c", ["5", "6"], ["edge-4"], 1.0)]


def test_calibration(spark):
    p = spark.createDataFrame(PATHS, "path_id string, node_ids array<string>, edge_ids array<string>, prior_weight double")
    o = spark.createDataFrame([("edge-1", 1000.0, "train"), ("edge-2", 600.0, "train"), ("edge-3", 400.0, "holdout")], "edge_id string, observed double, split string")
    out = flows.calibrate(p, o, 60)
    m = one(flows.error_metrics(o.where("split = 'train'"), flows.predictions(out, "weight")))
    assert m.wape < 0.03 and m.coverage == 1.0 and abs(one(out.where("path_id = 'b'")).weight - 400) < 35
    assert one(flows.error_metrics(o.limit(0), flows.predictions(out, "weight"))).mae == float("inf")


def test_conservation(spark):
    p = spark.createDataFrame([("a", ["1", "2", "3"], ["edge-1", "edge-2"], 125.0), ("b", ["3", "2", "4"], ["edge-3", "edge-4"], 75.0)], "path_id string, node_ids array<string>, edge_ids array<string>, w double")
    f = flows.edge_flows(p, "w")
    assert {r.edge_id: r.flow for r in f.collect()} == {"edge-1": 125.0, "edge-2": 125.0, "edge-3": 75.0, "edge-4": 75.0}
    assert one(flows.conservation_error(p, f, "w")).max_error == 0.0
    bad = f.withColumn("flow", F.when(F.col("edge_id") == "edge-1", 115.0).otherwise(F.col("flow")))
    assert one(flows.conservation_error(p, bad, "w")).max_error == 10.0


def diamond(spark):
    legs = [("1", "2", 900.0, "primary"), ("2", "3", 900.0, "primary"), ("1", "4", 1000.0, "secondary"), ("4", "3", 1000.0, "secondary"), ("1", "5", 1100.0, "residential"), ("5", "3", 1100.0, "residential")]
    both = legs + [(v, u, n, c) for u, v, n, c in legs]
    return spark.createDataFrame([(u, v, f"{u}_{v}", n / 12.0, n, 1200.0, c) for u, v, n, c in both], "u string, v string, edge_id string, cost double, length_m double, capacity double, road_class string")


def test_routes_and_assignment(spark):
    e = diamond(spark)
    pair = spark.createDataFrame([("1", "3"), ("3", "1"), ("1", "9")], "origin string, destination string")
    got = {(r.origin, r.destination): r for r in routing.shortest_paths(e, pair).collect()}
    assert len(got) == 2 and got["1", "3"].edge_ids == ["1_2", "2_3"] and got["1", "3"].cost == pytest.approx(150.0)
    far = {(r.origin, r.node): r.cost for r in routing.relax(e, pair.select("origin").distinct()).collect()}
    assert far["1", "3"] == pytest.approx(150.0)
    asked = spark.createDataFrame([("r", "1", "3", True, True), ("off", "1", "3", True, False), ("no", "1", "3", None, True), ("lost", "1", "9", True, True)], "key string, origin string, destination string, requested boolean, active boolean")
    found = paths.alternatives(e, asked.where("key IN ('r', 'lost')")).orderBy("place").collect()
    assert [(r.key, r.node_ids, r.length) for r in found] == [("r", ["1", "2", "3"], 1800.0), ("r", ["1", "4", "3"], 2000.0), ("r", ["1", "5", "3"], 2200.0)]
    closed = e.where("edge_id <> '1_2'")
    compared = {r.key: r for r in paths.compare_routes(e, closed, asked).collect()}
    assert {k: r.status for k, r in compared.items()} == {"r": "available", "off": "inactive", "no": "not_requested", "lost": "no_route"}
    assert compared["r"].restricted_edges == ["1_4", "4_3"] and compared["off"].baseline_edges == ["1_2", "2_3"] and compared["off"].restricted_edges is None
    demand = spark.createDataFrame([("1", "3", 600.0)], "origin string, destination string, volume double")
    before, assigned, missed = routing.assign(e, demand, 3)
    after, assigned2, missed2 = routing.assign(closed, demand, 3)
    assert (assigned, missed, assigned2, missed2) == (600.0, 0.0, 600.0, 0.0)
    c = flows.scenario_changes(before, after, "edge_id")
    assert c.count() >= 4 and {r.edge_id: r.change for r in c.collect()}["1_2"] < 0
    _, got3, missed3 = routing.assign(e, spark.createDataFrame([("1", "9", 5.0)], "origin string, destination string, volume double"), 1)
    assert (got3, missed3) == (0.0, 5.0)


def test_components(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "u string, v string")
    assert {r.node: r.component for r in routing.weak_components(e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    g = routing.load_graph(e.withColumns({"edge_id": F.concat("u", "v"), "cost": F.lit(1.0)}))
    assert routing.strong_components(g) == [["a", "b", "c"], ["d"], ["x"], ["y"]]
    assert not routing.physical_floor(100, 80) and routing.physical_floor(100, 95)


def test_od(spark):
    w = lambda m: scalar(spark, od.pm_weight(F.lit(m)))
    assert (w(450), w(990), w(1440)) == (0.0, 1.0, 0.5)
    seeds = spark.createDataFrame([("a", 100.0, 300.0), ("b", 200.0, 100.0)], "pair_id string, am double, pm double")
    assert one(od.blend(seeds, "am", "pm", 0.0, 300.0).agg(F.sum("rate").alias("s"))).s == pytest.approx(300.0)
    rows = [("Z1", "Z2", 1200.0, "internal", "internal"), ("X1", "Z1", 300.0, "external", "internal"), ("Z1", "X1", 250.0, "internal", "external"), ("Z2", "Z1", 1100.0, "internal", "internal")]
    m = {r.movement: r.trips for r in od.movement_matrix(spark.createDataFrame(rows, "o string, d string, trips double, ot string, dt string"), "ot", "dt", "trips").collect()}
    assert m == {"internal_to_internal": 2300.0, "external_to_internal": 300.0, "internal_to_external": 250.0, "external_to_external": 0.0}
    g = [("g1", "west", "I 5", "inbound", "e1", 1.0, 2.0), ("g1", "west", "I 5", "outbound", "e2", 3.0, 4.0), ("g2", "east", "I 84", "inbound", "e3", 0.0, 0.0)]
    got = {r.gateway_id: r for r in od.gateway_pairs(spark.createDataFrame(g, "gateway_id string, side string, ref string, movement string, edge_id string, crossing_lon double, crossing_lat double")).collect()}
    assert got["g1"].consistent and got["g1"].lon == 2.0 and not got["g2"].consistent


def test_priors(spark):
    rows = [
        ("e1", "c", "residential", 50.0, "city", "medium", None, None),
        ("e2", "c", "residential", None, None, None, 40.0, 2.0),
        ("e3", "c", "residential", None, None, None, None, None),
        ("e4", "d", "motorway", None, None, None, None, None),
        ("e5", "", "residential", 20.0, "city", "high", None, None),
        ("e6", "", "residential", 20.0, "city", "high", None, None),
        ("e7", "", "residential", None, None, None, None, None),
        ("e8", None, "residential", None, None, None, None, 3.0),
    ]
    e = spark.createDataFrame(rows, "edge_id string, corridor string, road_class string, authority_speed double, authority_source string, authority_confidence string, osm_speed double, osm_lanes double")
    got = {r.edge_id: r for r in priors.resolve(e).collect()}
    speed = {k: (r.speed_kph, r.speed_source, r.speed_confidence) for k, r in got.items()}
    assert len(got) == 8 and speed["e1"] == (50.0, "city", "medium") and speed["e2"] == (40.0, "osm_explicit", "medium")
    assert speed["e3"] == (45.0, "same_corridor_neighbor", "low")
    assert speed["e4"] == (100.0, "road_class_default", "low") == (*speed["e4"],) and speed["e7"] == (30.0, "road_class_default", "low") == speed["e8"]
    assert (got["e4"].lanes, got["e4"].capacity_vph) == (3.0, 6000.0) and got["e3"].capacity_vph == 700.0
    assert (got["e8"].lanes_source, got["e8"].capacity_confidence) == ("osm_explicit", "medium") and got["e3"].lanes_source == "road_class_default"


def test_sampling(spark):
    rows = spark.createDataFrame([("a", 12.0), ("b", 7.0)], "k string, trips double")
    units = sampling.balanced_rounding(rows, "k", "trips", 5, 42)
    audit = one(sampling.conservation_audit(units, "trips", "units", 5))
    assert audit.passed and sum(r.units for r in units.collect()) == 4
    t = sampling.trips(units, "k", "units", 25200, 7200, 42)
    first, again = (sorted(map(tuple, t.repartition(n).collect())) for n in (1, 7))
    assert first == again and all(25200 <= r[-1] < 32400 for r in first)
    draws = sampling.bootstrap(spark, spark.createDataFrame([(float(i),) for i in range(50)], "v double"), "v", 200, 3).withColumn("m", sampling.lognormal(F.col("draw"), 3))
    q = one(sampling.reliability(draws, "m", 1.2, {"p50": 0.5, "p85": 0.85, "p95": 0.95}))
    assert 1 <= q.p50 <= q.p85 <= q.p95 and 0 < q.probability < 1


def test_validation(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    with pytest.raises(ValueError):
        validate.require_columns(df, ["nope"])
    with pytest.raises(ValueError):
        validate.assert_unique(df, ["k"])
    assert [r.k for r in validate.keep_unique(df, ["k"]).collect()] == ["b"]
    assert scalar(spark, validate.intake_status(F.lit(False), F.lit(True))) == "validated_not_assignment_ready"
    assert 0 <= scalar(spark, hashing.fraction(F.lit("a"))) < 1
    assert scalar(spark, hashing.fraction64(F.lit("a"))) == pytest.approx(scalar(spark, hashing.fraction(F.lit("a"))), abs=1e-12)
    assert scalar(spark, times.active(F.lit(5), F.lit(5), F.lit(6))) and not scalar(spark, times.active(F.lit(6), F.lit(5), F.lit(6)))


def test_zones(spark):
    rows = [(f"n{i}", float(i % 10) * 500, float(i // 10) * 500, float(i)) for i in range(100)]
    nodes = spark.createDataFrame(rows, "node_id string, x double, y double, activity double")
    z = spatial.select_zones(nodes, 6)
    assert z.count() == 6 and len({r.node_id for r in z.collect()}) == 6


def test_relax_goes_on_until_nothing_changes(spark):
    """A chain of 55 edges beside a dear shortcut to its end, and a bound that is too low."""
    e = spark.createDataFrame([(f"{i:02}", f"{i + 1:02}", 1.0) for i in range(55)] + [("00", "55", 100.0)], "u string, v string, cost double").coalesce(1)
    far = {r.node: r.cost for r in routing.relax(e, spark.createDataFrame([("00",)], "origin string")).collect()}
    assert far == {f"{i:02}": float(i) for i in range(56)}
    with pytest.raises(RuntimeError, match="settle"):
        routing.relax(e, spark.createDataFrame([("00",)], "origin string"), rounds=3)


def test_scenarios(spark):
    edges = spark.createDataFrame([("e1", "a", "b"), ("e2", "b", "c"), ("e3", "c", "d")], "edge_id string, u string, v string")
    flows_ = spark.createDataFrame([("e1", 900.0), ("e2", 600.0), ("e9", 5.0)], "edge_id string, flow double")
    closed = spark.createDataFrame([("e1", "full"), ("e1", "full"), ("e2", "lanes"), ("e3", "full")], "edge_id string, type string")
    demand, stay = scenarios.displaced_demand(edges, flows_, closed)
    assert [tuple(r) for r in demand.collect()] == [("a", "b", 900.0)] and {r.edge_id for r in stay.collect()} == {"e2", "e9"}
    rows = [("k", 1, 100.0, 1000.0, 50.0, 900.0, ["x", "y"]), ("k", 2, 120.0, 1000.0, 0.0, 0.0, ["x", "z"]), ("k", 3, 110.0, 1000.0, 20.0, 0.0, ["p"]), ("k", 4, 300.0, 1000.0, 200.0, 0.0, ["q"]), ("one", 5, 7.0, 0.0, 0.0, 0.0, [])]
    ranked = scenarios.rank_routes(spark.createDataFrame(rows, "k string, route_id long, travel_seconds double, distance_m double, penalty_seconds double, residential_m double, edge_ids array<string>"), ["k"])
    assert {(r.k, r.ranking): (r.route_id, r.overlap_percent) for r in ranked.collect()} == {("k", "fastest"): (1, 100.0), ("k", "reliable"): (2, 50.0), ("k", "balanced"): (3, 0.0), ("one", "fastest"): (5, 0.0)}
    chunks = scenarios.date_chunks(spark, "2026-01-01", "2026-01-04", 1, (5, 6), spark.createDataFrame([(11,)], "highway_id long"), "00:15:00").collect()
    assert sorted(r.id for r in chunks) == ["highway-11_2026-01-01_2026-01-01_00-15-00", "highway-11_2026-01-02_2026-01-02_00-15-00"]
    p = spark.createDataFrame([(1, [1, 2], [7]), (2, [1], []), (3, [1], [7]), (4, [1, 2], [7]), (4, [1, 2], [7])], "path_id long, node_ids array<long>, edge_ids array<long>")
    assert sorted((r.path_id, r.reason) for r in scenarios.valid_paths(p).collect()) == [(1, None), (2, "empty"), (3, "sizes"), (4, "repeated"), (4, "repeated")]
