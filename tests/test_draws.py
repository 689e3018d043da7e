"""Weighted draws, endpoints, states at many instants, canonical JSON against plain Python."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from datetime import datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lanewright.functions import canonical
from lanewright.operators import sampling, schedules


def fraction(*parts):
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / float(1 << 52)


def pick(choices, u):
    total, run = sum(w for _, w in choices if w > 0), 0.0
    for c, w in sorted(choices):
        if w > 0:
            run += w
            if run / total > u:
                return c
    return max(c for c, w in choices if w > 0)


@pytest.mark.parametrize("text", [False, True])
def test_weighted_choice(spark, text):
    name = (lambda i: f"c{i:04d}") if text else (lambda i: i)
    choices = [("a", name(i), (i * 37 % 11) / 7) for i in range(700)] + [("b", name(1), 0.0), ("b", name(2), 3.0), ("c", name(5), 1e-9), ("c", name(6), 1e9), ("d", name(1), 0.0)]
    requests = [(i, "abcde"[i % 5]) for i in range(3000)]
    kind = "string" if text else "int"
    got = sampling.weighted_choice(spark.createDataFrame(requests, "id int, g string"), spark.createDataFrame(choices, f"g string, choice {kind}, w double"), "g", "choice", "w", F.pmod(F.col("id") * 0.6180339887, F.lit(1.0)))
    want = {(i, pick([(c, w) for h, c, w in choices if h == g], i * 0.6180339887 % 1.0)) for i, g in requests if g in "abc"}
    rows = [(r.id, r.choice) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_spans_are_adjacent(spark):
    rows = [("g", i, 0.1 * (i % 9 + 1)) for i in range(2000)]
    spans = sorted((r._lo, r._hi) for r in sampling.cumulative_shares(spark.createDataFrame(rows, "g string, c int, w double"), "g", "c", "w", 16).collect())
    assert spans[0][0] == 0.0 and spans[-1][1] == float("inf") and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_endpoints(spark):
    zones = {"z": [("e1", 1.0), ("e2", 2.0), ("e3", 0.5)], "one": [("e1", 4.0)]}
    edges = spark.createDataFrame([(z, e, w) for z, c in zones.items() for e, w in c], "zone string, edge string, weight double")
    requests = [(i, "z" if i % 3 else "one", "z" if i % 2 else "one") for i in range(400)]
    got = {r.id: (r.from_edge, r.to_edge) for r in sampling.weighted_endpoints(spark.createDataFrame(requests, "id int, origin string, destination string"), edges, edges, 9).collect()}
    want = {}
    for i, o, d in requests:
        start = pick(zones[o], fraction(9, i, "from"))
        for attempt in range(5):
            end = pick(zones[d], fraction(9, i, "to", attempt))
            if end != start:
                break
        want[i] = (start, end)
    assert got == want
    assert Counter(a == b for a, b in got.values())[True] >= sum(o == d == "one" for _, o, d in requests)


def test_dispersed_pairs(spark):
    requests = spark.createDataFrame([("r", "o", "d"), ("lone", "x", "y"), ("same", "s", "s")], "id string, origin string, destination string")
    starts = spark.createDataFrame([("r", f"a{i}") for i in range(5)] + [("r", "both")], "id string, node string")
    ends = spark.createDataFrame([("r", f"b{i}") for i in range(5)] + [("r", "both")], "id string, node string")
    rows = sampling.dispersed_pairs(requests, starts, ends, 12, 4).collect()
    of = lambda k: sorted((r.place, r.start, r.end) for r in rows if r.id == k)
    assert [p for p, _, _ in of("r")] == list(range(12)) and of("r")[0] == (0, "o", "d")
    assert all(a != b and (a[0] == "a" or a == "both") and (b[0] == "b" or b == "both") for _, a, b in of("r")[1:])
    assert len({(a, b) for _, a, b in of("r")}) > 5
    assert of("lone") == [(i, "x", "y") for i in range(12)] and of("same") == [(0, "s", "s")]
    assert sampling.dispersed_pairs(requests, starts, ends, 1, 4).count() == 3
    again = sampling.dispersed_pairs(requests.repartition(3), starts, ends, 12, 4).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_states_at_many_instants(spark):
    rows = [(d, day, m, float(m + (100 if day == "friday" else 0) + i), "observed" if m < 900 else "typical") for i, d in enumerate("ab") for day in ("mon_thu", "friday", "saturday", "sunday") for m in range(0, 1440, 15) if (d, m) != ("b", 450)]
    s = spark.createDataFrame(rows, "detector string, day_type string, bucket_start_minute int, volume_mean double, evidence_level string")
    at = datetime(2025, 9, 8, 14, 22, tzinfo=timezone.utc)
    instants = {"x": at, "night": datetime(2025, 9, 12, 6, 52, 30, tzinfo=timezone.utc), "pm": datetime(2025, 9, 8, 23, 30, tzinfo=timezone.utc)}
    got = {(r.instant, r.detector): (r.volume_mean, r.evidence_level) for r in schedules.states_at(s, instants, ["detector"], ["volume_mean"]).collect()}
    want = {(n, r.detector): (r.volume_mean, r.evidence_level) for n, t in instants.items() for r in schedules.state_at(s, t, ["detector"], ["volume_mean"]).collect()}
    assert {k: (pytest.approx(v[0]), v[1]) for k, v in want.items()} == got and ("x", "b") not in got
    total = schedules.schedule_scaling(s, at, ["detector"]).first()
    assert (total.requested_volume, total.pm_anchor_volume) == (pytest.approx(442.0), pytest.approx(990 + 991)) and total.evidence_levels
    assert total.am_anchor_volume == pytest.approx(450.0)
    assert schedules.schedule_scaling(s.limit(0), at, ["detector"]).first().requested_volume == 0.0


def test_canonical_json(spark):
    rows = [({"b": 1.0, "a": 1e-07, "Ü": 0.1}, ["x\"\n", None], True, 3, Decimal("2.50"), datetime(2025, 1, 2, 3, 4, 5)), ({}, [], None, -(1 << 62), None, None)]
    kind = "m map<string,double>, l array<string>, f boolean, n long, d decimal(5,2), t timestamp_ntz"
    df = spark.createDataFrame(rows, kind).select(F.struct("t", "n", "m", "l", F.struct("f", "d").alias("deep")).alias("v"))
    want = [{"t": t.isoformat() if t else None, "n": n, "m": m, "l": l, "deep": {"f": f, "d": None if d is None else float(d)}} for m, l, f, n, d, t in rows]
    tight = [json.dumps(w, sort_keys=True, separators=(",", ":")) for w in want]
    assert [r.c for r in df.select(canonical.canonical_json(F.col("v")).alias("c")).collect()] == tight
    assert [r.k for r in df.select(canonical.cache_key(F.col("v")).alias("k")).collect()] == [hashlib.sha256(t.encode()).hexdigest() for t in tight]
    seeds = [int.from_bytes(hashlib.sha256(json.dumps(w, sort_keys=True).encode()).digest()[:8], "big") for w in want]
    assert [int(r.s) for r in df.select(canonical.stable_seed(F.col("v")).alias("s")).collect()] == seeds
    with pytest.raises(Exception, match="finite"):
        spark.range(1).select(canonical.canonical_json(F.lit(float("nan")))).collect()
