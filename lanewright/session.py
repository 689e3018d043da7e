"""A session with the settings that the operators count on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoints(spark: SparkSession) -> None:
    """Reliable checkpoints go to spark.checkpoint.dir; where it is unset, to a local folder in local mode and nowhere else."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="lanewright-")
    context.setCheckpointDir(at)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, what an execution has shuffled is removed at its end (Spark 4.1 and later), not when the driver happens to collect its garbage.

    For steps whose frames are executed once: make what is returned unexecuted outside.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def table_of(df: DataFrame) -> Iterator[DataFrame]:
    """df as a compressed table beside the checkpoints, deleted in the end; what df was made from is dropped once it is written."""
    spark = df.sparkSession
    ensure_checkpoints(spark)
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(f"{context._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}")
    fs = at.getFileSystem(context._jsc.hadoopConfiguration())
    fs.deleteOnExit(at)
    try:
        with shuffles_dropped(spark):
            df.write.parquet(at.toString(), compression="zstd")
        yield spark.read.schema(df.schema).parquet(at.toString())
    finally:
        fs.delete(at, True)


def session(name: str = "lanewright", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI casts, adaptive execution with skew handling; everything else is the cluster's."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
