"""Streams: quarter-hour windows, resumable chunks, stateful toggles, playback windows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def windowed(df: DataFrame, ts: str, keys: list[str], value: str, width: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Counts, sums and means of tumbling windows; the same for batches and streams."""
    source = df.withWatermark(ts, late) if df.isStreaming else df
    out = source.groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max(value).alias("largest"))
    return out.select(F.col("window.start").alias("start"), *keys, "n", "total", "mean", "largest")


def edge_tick_stats(ticks: DataFrame) -> DataFrame:
    """(tick, edge_id, speed) of vehicles -> for each edge: entries, mean over occupied ticks of the tick's mean, occupied ticks."""
    by_tick = ticks.groupBy("tick", "edge_id").agg(F.count("*").alias("c"), F.avg("speed").alias("s"))
    return by_tick.groupBy("edge_id").agg(F.sum("c").alias("entries"), F.avg("s").alias("mean_speed"), F.count("*").alias("occupied_ticks"))


def read_chunks(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", timeout: int = 120, cancelled: Callable[[], bool] | None = None, report: Callable[[DataFrame], None] | None = None) -> int:
    """Process what is there and stop; a second run over the same checkpoint processes nothing anew. Gives the batches' number.

    cancelled is asked once a second; where it says so the stream stops, and the batch it was at is done again, with the
    same number, by the next run. report gets the table of timings, of a cancelled run too.

    The state is kept in RocksDB, as processors with named state need it; the session's own choice comes back afterwards.
    """
    conf, name = df.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, before)
    try:
        until = time.monotonic() + timeout
        while not query.awaitTermination(1):
            if cancelled is not None and cancelled():
                break
            if time.monotonic() > until:
                raise TimeoutError("the stream did not end")
        return len(query.recentProgress)
    finally:
        query.stop()
        if report is not None:
            report(timings(df.sparkSession, query.recentProgress))


def timings(spark: SparkSession, progress: list) -> DataFrame:
    """(batch_id, input_rows, phase, ms) of a stream's progress: one row for each batch and phase, few as batches are."""
    rows = [(p["batchId"], p["numInputRows"], phase, int(ms)) for p in progress for phase, ms in sorted(p["durationMs"].items())]
    return spark.createDataFrame(rows, "batch_id long, input_rows long, phase string, ms long")


def ledger_new(chunks: DataFrame, ledger: DataFrame) -> DataFrame:
    """Chunks that the ledger doesn't have with the same digest; a changed digest of a known chunk is an error."""
    both = chunks.join(ledger.select("chunk_id", F.col("sha256").alias("_old")), "chunk_id", "left")
    if bad := both.where("_old IS NOT NULL AND _old <> sha256").head():
        raise ValueError(f"chunk {bad.chunk_id} changed")
    return both.where("_old IS NULL").drop("_old")


class _Toggles(StatefulProcessor):
    """Keeps the last value of a key; gives the rows that differ from the row before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "active boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        f = pd.concat([r[["at", "active"]] for r in rows]).sort_values("at", kind="stable", ignore_index=True)
        now = f["active"].fillna(False).astype(bool)
        before = now.astype(object).shift(1)
        before.iloc[0] = self.last.get()[0] if self.last.exists() else None
        yield f.assign(active=now, key=key[0])[now.astype(object) != before][["key", "at", "active"]]
        self.last.update((bool(now.iloc[-1]),))


def toggles(df: DataFrame, key: str = "edge_id", at: str = "at") -> DataFrame:
    """(key, at, active) -> rows where active differs from the key's last one, across batches: kept as state.

    Rows of a batch are put in order of time, then of arrival; batches follow each other as they come. A null counts as not active.
    A key's rows of one micro-batch meet in one task, so files_per_trigger bounds them.
    """
    kind = {n: t for n, t in df.dtypes}
    schema = f"key {kind[key]}, at {kind[at]}, active boolean"
    # Names are plain inside: Spark gives columns that begin with an underscore other names there.
    rows = df.select(F.col(key).alias("key"), F.col(at).alias("at"), "active")
    return rows.groupBy("key").transformWithStateInPandas(_Toggles(), schema, "append", "none").toDF(key, at, "active")


class _Groups(StatefulProcessor):
    """Keeps the groups a chunk has shown and their number; a timer clears both when the chunk is over."""

    def __init__(self, most: int, hold_ms: int):
        self.most, self.hold_ms = most, hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "digest binary", "there boolean")
        self.count = handle.getValueState("count", "n long, until long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        n, until = self.count.get() if self.count.exists() else (0, -1)
        newest = until
        for f in rows:
            for digest in f["digest"].drop_duplicates():
                digest = bytes(digest)
                if not self.seen.containsKey((digest,)):
                    n += 1
                    if n > self.most:
                        raise ValueError(f"chunk {key[0]} has over {self.most} groups")
                    self.seen.updateValue((digest,), (True,))
            newest = max(newest, int(f["at_ms"].max()) + self.hold_ms)
        if newest != until:
            if until >= 0:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(newest)
        self.count.update((n, newest))
        yield pd.DataFrame({"chunk_id": [key[0]], "groups": [n], "closed": [False]})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0]
        self.seen.clear()
        self.count.clear()
        yield pd.DataFrame({"chunk_id": [key[0]], "groups": [n], "closed": [True]})


def capped_groups(df: DataFrame, parts: list[str], at: str = "at", chunk: str = "chunk_id", most: int = 250_000, late: str = "1 hour", hold_seconds: int = 3600) -> DataFrame:
    """(chunk_id, groups, closed): how many different groups (parts) each chunk has shown after every batch; over most is an error.

    The cap is the feature: a chunk past it is an error, no row of it is left out. Rows later than `late` are
    left out by the watermark. A chunk is closed and its state cleared hold_seconds after its newest row, once the watermark (late) has passed that. Copies of a group are
    taken out within each Arrow batch before the shuffle, so a chunk with many rows sends little more than its groups;
    a state holds at most `most` digests of 32 bytes. Nulls are a value of their own; rows without a time are an error.
    """
    text = F.to_json(F.struct(*[F.col(p).cast("string").alias(f"p{i}") for i, p in enumerate(parts)]))
    told = F.when(F.col(at).isNull(), F.raise_error(F.lit("row without a time"))).otherwise(F.unix_millis(at))
    kind = dict(df.dtypes)[chunk]
    rows = df.select(F.col(chunk).alias("chunk_id"), F.col(at).alias("told"), F.unhex(F.sha2(text, 256)).alias("digest"), told.alias("at_ms"))

    def distinct(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.sort_values("at_ms").drop_duplicates(["chunk_id", "digest"], keep="last")

    few = rows.mapInPandas(distinct, rows.schema).withWatermark("told", late)
    schema = f"chunk_id {kind}, groups long, closed boolean"
    return few.groupBy("chunk_id").transformWithStateInPandas(_Groups(most, hold_seconds * 1000), schema, "append", "EventTime")


def toggles_batch(df: DataFrame, key: str = "edge_id", at: str = "at") -> DataFrame:
    from pyspark.sql.window import Window

    before = F.lag("active").over(Window.partitionBy(key).orderBy(at))
    return df.withColumn("_b", before).where("_b IS NULL OR _b <> active").select(key, at, "active")


def playback(df: DataFrame, at: str, seconds: int = 60) -> DataFrame:
    """Rows of each window of simulated seconds, in order, as one nested row a window."""
    return df.groupBy(F.floor(F.col(at) / seconds).cast("long").alias("window")).agg(F.array_sort(F.collect_list(F.struct(at, *[c for c in df.columns if c != at]))).alias("rows"))
