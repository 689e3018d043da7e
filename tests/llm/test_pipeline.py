"""The pipeline stage by stage against brute force, and as a whole."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline
from lanewright.llm import mixing, near_dedup, quality_rules, substring_dedup
from lanewright.llm.common import materialize, read_table

from .test_near_dedup import brute as near_brute
from .test_substring_dedup import brute as substring_brute
from .test_tokens import check_places

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read_table(spark, DIR, "documents")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(materialize(stage(spark, seen[-1], DIR), name))
    raw, good, single, cut, mixed, packed = seen
    for df in (good, single, cut, mixed):
        assert df.columns == raw.columns and [t for _, t in df.dtypes] == [t for _, t in raw.dtypes]
    labels = {r.doc_id: r.quality for r in read_table(spark, DIR, "labels").collect()}
    kept = {r.doc_id for r in good.collect()}
    clean = [d for d, q in labels.items() if q == 1]
    junk = [d for d, q in labels.items() if q == 0]
    assert sum(d in kept for d in clean) >= 0.95 * len(clean) and sum(d in kept for d in junk) <= 0.2 * len(junk)
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert {r.doc_id for r in single.collect()} == {d for d, _, c, k in near_brute(rows, 80) if k}
    before = {r.doc_id: r.text for r in single.collect()}
    report = {d: n for d, _, n, _ in substring_brute(list(before.items()))}
    after = {r.doc_id: r.text for r in cut.collect()}
    assert set(after) == set(before)
    assert all(len(after[d].split()) == len(before[d].split()) - n if n else after[d] == before[d] for d, n in report.items())
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix_documents(cut).where("taken > 0").collect()}
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert copies == taken and max(copies.values()) <= 3
    check_places(packed.collect())


def test_repeated_and_null_ids(spark):
    rng = random.Random(1)
    a, b, c, d = (" ".join(f"{k}{rng.randrange(10**6)}" for _ in range(60)) for k in "abcd")
    rows = [(1, a), (2, a), (2, b), (None, c), (None, a), (3, d), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    take = lambda df: sorted(map(tuple, df.collect()), key=order)
    assert take(near_dedup.keep_one(docs)) == sorted([(1, a), (2, b), (None, c), (3, d), (None, None)], key=order)
    assert take(substring_dedup.dedup_texts(docs)) == sorted([(1, a), (2, ""), (2, b), (None, c), (None, ""), (3, d), (None, None)], key=order)
    sized = spark.createDataFrame([(1, "a b c", "s"), (1, "", "s"), (None, "f g", "s")], "doc_id long, text string, source string")
    assert {tuple(r) for r in mixing.repeat_documents(sized).collect()} == {(1, "a b c", "s"), (None, "f g", "s")}
    good = spark.createDataFrame([(None, GOOD), (1, GOOD), (1, "x")], "doc_id long, text string")
    assert take(quality_rules.filter_documents(good)) == [(1, GOOD), (None, GOOD)]


GOOD = " ".join(f"The {x} walked slowly to the {y} before it was dark." for x, y in zip(["farmer", "teacher", "painter", "doctor", "sailor", "baker"], ["river", "market", "school", "harbour", "garden", "station"], strict=True))


def test_run_and_empty(spark, tmp_path):
    read_table(spark, DIR, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
