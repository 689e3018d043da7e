"""Ids of the whole range of 64 bits, beside null ids: results don't depend on how ids are numbered, only on their order."""

from __future__ import annotations

import pytest

from lanewright.llm import common, mixing, near_dedup, substring_dedup
from lanewright.llm.common import IdSpace, read_table

DIR = "/root/testdata/sf0.001"
FAR = [-(1 << 63), -(1 << 62) - 1, -5, 0, 1 << 62, (1 << 62) + 5, (1 << 63) - 1]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(r.text, r.source) for r in read_table(spark, DIR, "documents").orderBy("doc_id").limit(24).collect()]
    rows[1], rows[4], rows[6], rows[9] = rows[0], rows[0], rows[5], rows[5]
    return rows[:14]


def results(spark, texts, ids):
    docs = spark.createDataFrame([(i, t, s) for i, (t, s) in zip([*ids, *[None] * (len(texts) - len(ids))], texts, strict=True)], "doc_id long, text string, source string")
    place = {i: k for k, i in enumerate(ids)} | {None: None}
    out = []
    for df, columns in ((substring_dedup.dedup_report(docs), ["doc_id"]), (near_dedup.near_components(docs), ["doc_id", "component_id"]), (mixing.mix_documents(docs), ["doc_id"])):
        rows = [tuple(place[r[c]] if c in columns else r[c] for c in df.columns if c != "taken") for r in df.collect()]
        out.append(sorted(rows, key=str))
    return out


@pytest.mark.parametrize("ids", [FAR, [3, 1 << 62, (1 << 63) - 1]])
def test_far_ids_beside_null_ids(spark, texts, ids):
    near = list(range(len(ids)))
    assert results(spark, texts[: len(ids) + 3], ids) == results(spark, texts[: len(ids) + 3], near)


def test_numbers_go_back_to_ids(spark):
    docs = spark.createDataFrame([(i, "x") for i in [*FAR, None]], "doc_id long, text string")
    ids = IdSpace(docs)
    numbered = docs.select("doc_id", ids.known().alias("n"))
    back = numbered.select("doc_id", "n", ids.given("n").alias("b")).collect()
    assert all(r.doc_id == r.b for r in back)
    assert [r.doc_id for r in sorted(back, key=lambda r: r.n)] == [*FAR, None]
    assert IdSpace(docs.where("doc_id IS NOT NULL")).gap is None


def test_no_room_for_null_ids(spark):
    rows = [(r << 56, "x") for r in range(-128, 128)] + [(None, "x")]
    with pytest.raises(ValueError, match="all ranges"):
        IdSpace(spark.createDataFrame(rows, "doc_id long, text string"))


def test_own_folder_where_none_is_set(spark, monkeypatch):
    """Without spark.checkpoint.dir a local session gets one folder of its own, a cluster an error."""

    class Context:
        master = "local[2]"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    first = common.shared_dir(Session())
    assert first.startswith("file:///") and common.shared_dir(Session()) == first
    monkeypatch.setattr(Context, "master", "spark://x")
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())
