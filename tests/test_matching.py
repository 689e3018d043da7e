"""Nearest values, matches and points against all pairs; degrees against sets."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from lanewright.functions import canonical
from lanewright.operators import flows, matching, spatial


def test_nearest_values(spark):
    rng = random.Random(7)
    draw = lambda: rng.choice([None, *(x / 4 for x in range(-30, 30))])
    left = [(i, rng.choice("abc"), draw()) for i in range(60)]
    right = [(i, rng.choice("abd"), draw()) for i in range(80)]
    k = 3
    found = matching.nearest_values(spark.createDataFrame(left, "s int, n string, x double"), spark.createDataFrame(right, "c int, n string, y double"), ["n"], "x", "y", "c", k).collect()
    order = lambda x, y, c: (x is None or y is None, 0.0 if x is None or y is None else abs(x - y), c)
    for s, n, x in left:
        got = sorted(order(r["x"], r["y"], r["c"]) for r in found if r["s"] == s)
        want = sorted(order(x, y, c) for c, m, y in right if m == n)
        assert got[:k] == want[:k], s


def test_nearest_values_makes_few_pairs_of_one_group(spark):
    left = spark.range(300).selectExpr("id AS s", "1 AS n", "CAST(id % 3 AS double) AS x")
    right = spark.range(2000).selectExpr("id AS c", "1 AS n", "CAST(id % 5 AS double) AS y")
    found = matching.nearest_values(left, right, ["n"], "x", "y", "c", 2)
    assert 2 * 300 <= found.count() <= 8 * 300


def test_shared_ids_gives_pairs_once_without_a_distinct(spark):
    left = spark.createDataFrame([(1, [5, 3, 3]), (1, [9]), (2, [4]), (3, None)], "a int, ids array<int>")
    right = spark.createDataFrame([(7, [9, 3, 5]), (8, [4, 4]), (8, [3])], "b int, ids array<int>")
    out = matching.shared_ids(left, right, "a", "b", "ids")
    assert sorted(map(tuple, out.collect())) == [(1, 7), (1, 8), (2, 8)]
    assert "Join" in out._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[0]


def test_match_stations_is_the_best_of_all_pairs(spark):
    rng = random.Random(11)
    tokens = lambda: rng.choice([None, [], ["I5"], ["US26"], ["I5", "US26"], ["OR8"]])
    bearing = lambda: rng.choice([None, *(float(b) for b in range(-90, 720, 5))])
    at = lambda: (rng.choice([None, *range(-9, 9)]), rng.randint(-400, 400) * 1.0)
    place = lambda: (lambda i, y: (None if i is None else i * 45.0, y))(*at())
    roads = ["motorway", "motorway_link", "trunk", "primary_link", "residential", None]
    edges = [(i, *place(), bearing(), tokens(), rng.choice(roads)) for i in range(400)]
    edges += [(1000 + e[0], *e[1:]) for e in edges[:100]]
    stations = [(i, *place(), bearing(), tokens(), rng.choice(["unknown", "link", "mainline"])) for i in range(120)]
    e = spark.createDataFrame(edges, "edge_id int, ox double, oy double, bearing double, tokens array<string>, road_class string")
    s = spark.createDataFrame(stations, "station_id int, x double, y double, target_bearing double, target_tokens array<string>, road_form string")
    rows = lambda df: sorted(map(repr, df.select("station_id", "edge_id", "distance", "score", "margin", "reasons", "status").collect()))
    want = matching.select_matches(matching.score_candidates(spatial.points_within(e, s, matching.MAX_DISTANCE, ("ox", "oy"), ("x", "y"))))
    assert rows(matching.match_stations(s, e)) == rows(want)


def test_match_stations_makes_few_pairs_where_all_is_near(spark):
    e = spark.range(4000).selectExpr("id AS edge_id", "CAST(id * 37 % 241 AS double) AS ox", "CAST(id * 53 % 239 AS double) AS oy", "CAST(id * 7 % 360 AS double) AS bearing", "array('I5') AS tokens", "'motorway' AS road_class")
    s = spark.range(50).selectExpr("id AS station_id", "CAST(id * 11 % 150 AS double) AS x", "CAST(id * 17 % 150 AS double) AS y", "CAST(id * 29 % 360 AS double) AS target_bearing", "'mainline' AS road_form", "array('I5') AS target_tokens")
    tiers, finest = matching._tiered(e)
    assert 50 <= matching._search(s, tiers, finest).count() < 50 * 4000 / 100


def test_station_match_scores_makes_no_pairs_of_a_whole_neighbourhood(spark):
    plan = entry.queries()["station_match_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_nearest_within_is_the_nearest_of_all_pairs(spark):
    rng = random.Random(5)
    at = lambda: (rng.choice([None, *(i / 8 for i in range(-60, 60))]), rng.randint(-40, 40) / 8)
    left, right = [(i, *at()) for i in range(300)], [(i, *at()) for i in range(400)]
    right += [(1000 + i, 0.3 + i / 5000, 0.2 + i % 7 / 9000) for i in range(200)]
    a, b = spark.createDataFrame(left, "a int, x double, y double"), spark.createDataFrame(right, "b int, ox double, oy double")
    for radius in (0.5, 3.0):
        got = {r["a"]: (r["distance"], r["b"]) for r in spatial.nearest_within(a, b, ["a"], "b", radius).collect()}
        want = {}
        for r in spatial.points_within(a, b, radius).collect():
            want[r["a"]] = min(want.get(r["a"], (9e9, 0)), (r["distance"], r["b"]))
        assert got == want


def test_nearest_within_makes_few_pairs_in_a_crowd(spark):
    a = spark.range(500).selectExpr("id AS a", "id * 37 % 499 / 499D AS x", "id * 91 % 497 / 497D AS y")
    b = spark.range(5000).selectExpr("id AS b", "id * 17 % 4999 / 4999D AS ox", "id * 733 % 4993 / 4993D AS oy")
    assert 500 <= spatial.nearest_pairs(a, b, "b", 1.0, ("x", "y"), ("ox", "oy")).count() <= 500 * 20


def test_degrees_hold_no_sets_of_neighbours(spark):
    rng = random.Random(3)
    some = lambda: rng.choice([None, *range(12)])
    edges = [(some(), some()) for _ in range(150)]
    e = spark.createDataFrame(edges, "u long, v long")
    for simple in (False, True):
        rows = set(edges) if simple else edges
        want = {(n, sum(u == n for u, _ in rows), sum(v == n for _, v in rows), len(({v for u, v in rows if u == n} | {u for u, v in rows if v == n}) - {None})) for n in {x for r in rows for x in r}}
        out = flows.degrees(e, simple)
        assert set(map(tuple, out.collect())) == want
        assert "distinct" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_json_text_is_what_python_writes(spark):
    texts = ["plain ~ []{}", "", 'a"\\q', "\u00e9\x7f\u2028 \U0001f600\x00\x1f\b\f\r\t\nz", "end\n", "\x85\ud7ff\ue000\uffff", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", canonical.json_text(F.col("t"))).collect()
    assert all(j == json.dumps(t) for t, j in got)


def test_route_summaries_send_no_row_to_python_and_deal_lineitem_by_route(spark):
    out = entry.queries()["route_summaries"](spark, "/root/testdata/sf0.001")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan
    shuffles = plan.split("Initial Plan")[-1]
    assert shuffles.count("Exchange hashpartitioning") + shuffles.count("Exchange SinglePartition") == 1
