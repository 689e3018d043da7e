"""A training corpus from raw documents in five stages, each one of the operators of lanewright.llm.

Documents that the quality rules reject go; one document of each near-duplicate group stays; word
windows seen before are cut out of the texts; sources are mixed to their targets (a document taken
twice has two rows); what remains is packed into sequences.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from lanewright.llm import mixing, near_dedup, packing, quality_rules, substring_dedup
from lanewright.llm.common import read_table, released
from lanewright.llm.tokens import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, percent=80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_texts(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mixture", mixture), ("pack", pack)]
#: Seeded selection, tokens and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; what a stage wrote on the way is deleted when its result stands."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = released(partial(stage, spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
