from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewright.llm import components, mixing, quality_classifier, quality_rules, url_filters
from lanewright.llm.common import read_table

DIR = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def base(text):
    t = text or ""
    w = re.findall(WORD, t)
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {p for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


CASES = [(0, None), (1, ""), (2, " \n\t "), (3, "a b c " * 50), (4, "one two three four five six seven eight nine"), (5, "x\ny\nx\n\nx y"), (6, "# * $ é😀 " + "w " * 8), (7, "q " * 4000), (8, "a b c d e f g h i a b c d e f g h j")]


def test_rule_statistics(spark):
    docs = spark.createDataFrame([(*c, 1) for c in CASES], "doc_id long, text string, v int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.score_rules(docs).collect()}
    assert got == {d: base(t) for d, t in CASES}
    assert quality_rules.score_rules(docs.limit(0)).count() == 0
    assert quality_rules.filter_documents(docs).columns == docs.columns


def test_rules_follow_labels(spark):
    docs, labels = read_table(spark, DIR, "documents"), read_table(spark, DIR, "labels")
    both = quality_rules.score_rules(docs).join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in both}
    assert n.get((1, True), 0) >= 0.95 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, True), 0) <= 0.2 * (n.get((0, True), 0) + n.get((0, False), 0))


def test_planted_accuracies_are_recovered(spark):
    """Votes drawn from known rates, some far from where the estimation starts."""
    rng = np.random.default_rng(4)
    n, says = 20000, np.array([0.9, 1.0, 0.7, 0.95, 0.8, 1.0])
    on_good, on_bad = np.array([0.99, 0.8, 0.75, 0.95, 0.7, 0.9]), np.array([0.9, 0.7, 0.85, 0.35, 0.6, 0.95])
    good = rng.random(n) < 0.75
    right = rng.random((n, 6)) < np.where(good[:, None], on_good, on_bad)
    votes = np.where(rng.random((n, 6)) < says, np.where(right == good[:, None], 1, -1), 0)
    patterns = Counter(map(tuple, votes.tolist()))
    df = spark.createDataFrame([([(list(v), float(c)) for v, c in patterns.items()],)], "p array<struct<v:array<int>,n:double>>")
    m = df.select(quality_rules.estimate(F.col("p"), 6).alias("m")).head().m
    assert abs(m.prior - 0.75) < 0.02
    assert np.abs(np.array(m.good) - on_good).max() < 0.03 and np.abs(np.array(m.bad) - on_bad).max() < 0.04


def test_rules_of_null_ids_and_long_words(spark):
    docs = spark.createDataFrame([(None, "x" * 2_000_000, 1), (None, None, 1), (3, "a b " * 200_000, 1)], "doc_id long, text string, kept int")
    got = {(r.doc_id, r.n_words): r.kept for r in quality_rules.score_rules(docs.drop("kept")).collect()}
    assert got == {(None, 1): False, (None, 0): False, (3, 400_000): False}
    assert quality_rules.filter_documents(docs).count() == 0


def test_urls(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://x.example.org/es/a", None),
        (2, "https://mirror.net/a", link.format("http://x.example.org/es/a")),
        (3, "https://other.net/b", '<META http-equiv="refresh" content="0; url=https://mirror.net/a#top">'),
        (4, "https://free.net/c", link.format("http://sub.com/fr/1")),
        (5, "https://free.net/d?utm_source=x", link.format("https://free.net/c/") + link.format("http://x.com/de/2")),
        (6, "http://x.com/de/2", ""),
        (7, "http://sub.com/fr/1", "x"),
        (8, None, None),
        (9, "no url", "<link rel=canonical href=/z>"),
        (10, "HTTP://WWW.Example.ORG/en/17?q#f", None),
        (11, "http://example.org", None),
        (12, "http://anorg/", None),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, key string")).collect()}
    assert got[1][2:] == ("example.org/es/", "block") and got[2][2:] == (None, "block") and got[3][2:] == (None, "block")
    assert got[4][2:] == (None, "allow") and got[5][2:] == (None, "allow") and got[6][2:] == ("com/de/", "block") and got[7][2:] == ("com/fr/", "allow")
    assert got[8] == ("", "", None, "allow") == got[9]
    assert got[10] == ("www.example.org", "/en/17", "example.org/en/1", "block")
    assert got[11] == ("example.org", "", None, "allow") and got[12][2] is None


def test_components(spark):
    import random

    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b), near[b].add(a)
    for n in near:
        todo, seen = [n], {n}
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert got[n] == min(seen)
    assert set(got) == set(near)


def test_targets_and_flow():
    assert mixing.capped_targets([10, 100, 100], [1, 1, 1], 3) == pytest.approx([30, 90, 90])
    assert mixing.capped_targets([0, 0], [1, 2], 3) == [0, 0] and mixing.capped_targets([], [], 3) == []
    flows = mixing.min_cost_flow([10, 10, 20], [(0,), (1,), (0, 1)], [25, 30], 3)
    assert sum(f.get(0, 0) for f in flows) == 25 and sum(f.get(1, 0) for f in flows) == 30
    assert all(sum(f.values()) <= 2 * s for f, s in zip(flows, [10, 10, 20], strict=True))


def best_flow(supply, members, quotas, repeats):
    """(most flow, least cost) over all whole flows, by trying every one."""
    arcs = [(p, q) for p, m in enumerate(members) for q in m]
    best = (0, 0)
    for amounts in itertools.product(*(range(min(quotas[q], supply[p] * repeats) + 1) for p, q in arcs)):
        given, taken = Counter(), Counter()
        for (p, q), x in zip(arcs, amounts, strict=True):
            given[p] += x
            taken[q] += x
        if all(taken[q] <= quotas[q] for q in taken) and all(given[p] <= supply[p] * repeats for p in given):
            cost = sum(k * min(supply[p], max(0, given[p] - k * supply[p])) for p in given for k in range(repeats))
            best = max(best, (sum(amounts), -cost))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_flow_against_all_flows(seed):
    rng = np.random.default_rng(seed)
    supply = rng.integers(0, 4, 3).tolist()
    members = [tuple(sorted(rng.choice(3, rng.integers(1, 3), replace=False).tolist())) for _ in supply]
    quotas = rng.integers(0, 6, 3).tolist()
    flows = mixing.min_cost_flow(supply, members, quotas, 3)
    given = [sum(f.values()) for f in flows]
    cost = sum(k * min(s, max(0, g - k * s)) for s, g in zip(supply, given, strict=True) for k in range(3))
    assert all(sum(f.get(q, 0) for f in flows) <= quotas[q] for q in range(3)) and all(g <= 3 * s for g, s in zip(given, supply, strict=True))
    assert (sum(given), -cost) == best_flow(supply, members, quotas, 3)


def plain_targets(sizes, weights, cap):
    """Shares raised together in small steps, none above its cap."""
    done, left = np.zeros(len(sizes)), float(sum(sizes))
    room = cap * np.array(sizes, float)
    while left > 1e-9:
        open_ = room - done > 1e-12
        if not open_.any():
            break
        w = np.where(open_, weights, 0)
        step = min(left / w.sum(), min((room - done)[open_] / w[open_]))
        done += step * w
        left -= step * w.sum()
    return done.tolist()


@pytest.mark.parametrize("seed", range(5))
def test_targets_against_raising_shares(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 1000, 7).tolist()
    weights = [(1, 2, 3)[i % 3] for i in range(7)]
    assert mixing.capped_targets(sizes, weights, 3) == pytest.approx(plain_targets(sizes, np.array(weights, float), 3))


def test_mix(spark):
    rows = [(i, f"w{i} " * (1 + i % 7), None if i % 11 == 0 else f"s{i % 4}") for i in range(200)] + [(300, None, "s1"), (301, "", "s9")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, target int")
    got = mixing.mix_documents(docs).collect()
    again = sorted(map(tuple, mixing.mix_documents(docs.repartition(7)).collect()), key=str)
    assert sorted(map(tuple, got), key=str) == again and len(got) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = plain_targets([sizes[n] for n in names], np.array([(1.0, 2.0, 3.0)[i % 3] for i in range(len(names))]), 3)
    assert [target[n] for n in names] == pytest.approx(want)
    assert all(abs(taken[n] - target[n]) <= 4 for n in names)
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_overlapping_sources(spark):
    rows = [(i, ["a"] if i < 50 else ["b"] if i < 60 else ["a", "b"], 10) for i in range(100)]
    sized = spark.createDataFrame(rows, "doc_id long, sources array<string>, size long")
    got = mixing.mix(sized, weights=(1, 3)).collect()
    assert len(got) == 100 and all(r.taken in (0, 10, 20, 30) for r in got)
    few = mixing.mix(sized, weights=(1, 3), max_patterns=1).collect()
    # Merged patterns keep their memberships, sizes and targets.
    same = lambda rows: sorted((r.doc_id, r.sources, r.size, r.source_size, r.target) for r in rows)
    assert same(few) == same(got) and sum(r.taken for r in few) > 0.8 * sum(r.taken for r in got)


def test_many_patterns_of_two_sources(spark):
    rows = [(i, [f"s{i % 25}", f"s{(i * 7 + 1) % 26}", None][: 2 + (i % 50 == 0)], 5 + i % 3) for i in range(900)] + [(None, ["s1"], 4)]
    sized = spark.createDataFrame(rows, "doc_id long, sources array<string>, size long").selectExpr("coalesce(doc_id, 5000) AS doc_id", "sources", "size")
    full, few = (mixing.mix(sized, max_patterns=n).collect() for n in (4096, 8))
    sizes = Counter()
    for _, s, x in rows:
        for one in set(s):
            sizes[one] += x
    for rows_ in (full, few):
        assert len(rows_) == 901 and all(r.source_size == sizes[r.sources[0]] and r.taken % r.size == 0 and r.taken <= 3 * r.size for r in rows_)
    assert {(r.doc_id, r.target) for r in full} == {(r.doc_id, r.target) for r in few}


def test_clashing_columns_of_the_mix(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 1, 2, 3), (None, "c", None, 1, 2, 3)], "doc_id long, text string, source string, mixed_id int, copies int, `a.b` int")
    assert mixing.repeat_documents(docs).columns == docs.columns
    assert {r.doc_id for r in mixing.mix_documents(docs).collect()} == {1, None}


def test_classifier(spark):
    docs, labels = read_table(spark, DIR, "documents"), read_table(spark, DIR, "labels")
    got = {r.doc_id: r for r in quality_classifier.score_documents(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(p == q for p, q in held) >= 0.9 * len(held)


def test_classifier_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "w " * 50000, "x")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_classifier.score_documents(docs, none).collect()} == {0.5}
    assert quality_classifier.score_documents(docs.limit(0), none).count() == 0


def plain_scores(x, y, fit, shrink, ridge, temper):
    """Scores by explicit inverses and determinants, from the definition."""
    train = [(v, c) for v, c, f in zip(x, y, fit, strict=True) if f and c is not None]
    groups = {c: np.array([v for v, k in train if k == c]) for c in (0, 1)}
    mean = {c: g.mean(0) for c, g in groups.items()}
    cov = {c: sum(np.outer(v - mean[c], v - mean[c]) for v in g) / len(g) for c, g in groups.items()}
    pooled = (len(groups[0]) * cov[0] + len(groups[1]) * cov[1]) / len(train)
    scale = np.diag(np.maximum(np.diag(pooled) + ((mean[0] - mean[1]) / 2) ** 2, 1e-6))
    share, density = len(groups[1]) / len(train), {}
    for c, g in groups.items():
        w = len(g) / (len(g) + shrink)
        s = w * cov[c] + (1 - w) * pooled + ridge * scale
        density[c] = [-0.5 * (v - mean[c]) @ np.linalg.inv(s) @ (v - mean[c]) - 0.5 * np.linalg.slogdet(s)[1] for v in x]
    odds = temper * (np.array(density[1]) - np.array(density[0])) + np.log(share / (1 - share))
    return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def test_classifier_scores_against_the_definition(spark):
    import zlib

    qc = quality_classifier
    docs, labels = read_table(spark, DIR, "documents"), read_table(spark, DIR, "labels")
    rows = docs.collect()
    marked = {r.doc_id: r.quality for r in labels.collect()}
    x = [np.round(np.array(qc.statistics(r.text)) * qc.GRID) / qc.GRID for r in rows]
    fit = [zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in rows]
    want = plain_scores(x, [marked.get(r.doc_id) for r in rows], fit, qc.SHRINK, qc.RIDGE, qc.TEMPER)
    got = {r.doc_id: r for r in qc.score_documents(docs, labels).collect()}
    assert [got[r.doc_id].score for r in rows] == pytest.approx(want.tolist(), abs=1e-6)
    assert all(got[r.doc_id].held_out == (not f) for r, f in zip(rows, fit, strict=True))
    # The weight of a class's own covariance grows with its rows.
    small, large = (qc.Discriminant({k: np.concatenate([[n], np.zeros(qc.DIMENSIONS), (n * (k + 1) * np.eye(qc.DIMENSIONS)).ravel()]) for k in (0, 1)}) for n in (10, 100_000))
    assert abs(small.classes[0][1][0, 0] - small.classes[1][1][0, 0]) < 0.05 < abs(large.classes[0][1][0, 0] - large.classes[1][1][0, 0])
