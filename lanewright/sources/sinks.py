"""Sinks: Parquet by Hive partitions, CSV, JSON lines, documents, keyed upserts, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.operators.evidence import place_keys
from lanewright.operators.validate import assert_unique


def parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """zstd Parquet; the committer makes the write all or nothing."""
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def partitioned(df: DataFrame, path: str, columns: list[str], mode: str = "errorifexists") -> None:
    """Hive partitions, null as unknown; rows of one partition are spread only as far as their size asks."""
    named = df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in columns})
    named.hint("rebalance", *columns).write.mode(mode).option("compression", "zstd").partitionBy(*columns).parquet(path)


def review_csv(df: DataFrame, path: str) -> None:
    text = {n: F.to_json(n) for n, t in df.dtypes if t.startswith(("array", "struct", "map"))}
    df.withColumns(text).write.csv(path, header=True, quoteAll=False, escape='"')


def json_lines(df: DataFrame, path: str, compression: str = "gzip") -> None:
    df.write.option("compression", compression).json(path)


def document(df: DataFrame, rows: str, order: str) -> DataFrame:
    """One row with all rows in order: for reports of bounded size only."""
    return df.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*df.columns).alias("r")))), lambda x: x["r"]).alias(rows))


def xml(df: DataFrame, path: str, root: str, row: str) -> None:
    df.write.format("xml").option("rootTag", root).option("rowTag", row).save(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows whose key isn't there yet, the first of repeated ones."""
    return new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys)


def append_revision(log: DataFrame, key: str, value: str, expected: int, row: DataFrame) -> DataFrame:
    """Append-only revisions: row may follow only if the key's last revision is the expected one."""
    last = log.where(F.col(key) == value).agg(F.coalesce(F.max("revision"), F.lit(0))).head()[0]
    if last != expected:
        raise ValueError(f"revision conflict: {last} is there, {expected} was expected")
    return log.unionByName(row.withColumn("revision", F.lit(expected + 1).cast(log.schema["revision"].dataType)))


def latest_revisions(log: DataFrame, key: str, limit: int = 200) -> DataFrame:
    """The last revision of each key that isn't deleted, newest first."""
    rest = [c for c in log.columns if c != key]
    last = log.groupBy(key).agg(F.max_by(F.struct(*rest), "revision").alias("_r")).select(key, "_r.*")
    return last.where("NOT deleted").orderBy(F.desc("created_at"), key).limit(limit)


def import_all(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with all rows of new, or none: rows with keys that name places, a key twice and a key already there are errors."""
    if bad := new.where(F.size(place_keys(F.to_json(F.struct(*new.columns)))) > 0).select(key).head():
        raise ValueError(f"{bad[0]} names places")
    assert_unique(new, [key])
    if bad := new.join(old.select(key), key, "left_semi").select(key).head():
        raise ValueError(f"{bad[0]} is there already")
    return old.unionByName(new)
