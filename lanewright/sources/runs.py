"""Runs as append-only logs of states: a state is a file made only if absent, so of two writers one wins.

A run's states are root/run_id/<revision>.json, each a whole row. Nothing is changed in place: the newest
revision is the run. Spark reads all runs at once; a single move touches only the run's own folder.
"""

from __future__ import annotations

import json
import os
import uuid
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Kinds and statuses of runs, and where a status may lead.
KINDS = ["validation", "regional_comparison"]
TRANSITIONS = {
    "queued": ["running", "failed", "cancel_requested"],
    "running": ["completed", "failed", "cancel_requested"],
    "cancel_requested": ["completed", "failed", "cancelled"],
    "completed": [],
    "failed": [],
    "cancelled": [],
}
FIELDS = "run_kind string, run_key string, seed long, graph_version string, network_version string, request_json string, progress double, created_at string, started_at string, finished_at string, summary_json string, error_message string"
SCHEMA = f"run_id string, revision long, status string, {FIELDS}"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


class Conflict(ValueError):
    """Another writer was first, or the status may not follow."""


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole if there is none; False where there is one. Readers never see a part of it.

    A finished temporary file beside it gets the name: by a hard link on local disks, by a rename without
    overwriting elsewhere, which is one step on HDFS. Object stores whose rename isn't one step don't keep the promise.
    """
    jvm, at, fs = _files(spark, path)
    at = fs.makeQualified(at)
    fs.mkdirs(at.getParent())
    part = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(part, False)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(part.toUri().getPath(), at.toUri().getPath())
        else:
            _rename(spark, part, at)
        return True
    except FileExistsError:
        return False
    finally:
        fs.delete(part, False)


def _rename(spark: SparkSession, part, at) -> None:
    jvm = spark._jvm
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(part, at, options)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            raise FileExistsError(at.toString()) from e
        raise


def _name(root: str, run_id: str, revision: int) -> str:
    return f"{root}/{run_id}/{revision:08d}.json"


def _write(spark: SparkSession, root: str, row: dict) -> dict:
    whole = {c: row.get(c) for c in COLUMNS}
    if not create_once(spark, _name(root, row["run_id"], row["revision"]), json.dumps(whole, sort_keys=True) + "\n"):
        raise Conflict(f"run {row['run_id']} has a revision {row['revision']} already")
    return whole


def start(spark: SparkSession, root: str, run_id: str, kind: str, run_key: str, seed: int, **fields) -> dict:
    """The first state, queued, of a new run; a Conflict where the run is there."""
    if kind not in KINDS:
        raise ValueError(f"no kind of run {kind}")
    return _write(spark, root, fields | {"run_id": run_id, "revision": 1, "status": "queued", "run_kind": kind, "run_key": run_key, "seed": seed, "progress": 0.0, "created_at": _now()})


def get(spark: SparkSession, root: str, run_id: str) -> dict:
    """The newest state of one run, from its own folder only; KeyError where there is none."""
    jvm, at, fs = _files(spark, f"{root}/{run_id}")
    names = [s.getPath() for s in fs.listStatus(at) if not s.getPath().getName().startswith(".")] if fs.exists(at) else []
    if not names:
        raise KeyError(run_id)
    stream = fs.open(max(names, key=lambda p: p.getName()))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
    finally:
        stream.close()


def move(spark: SparkSession, root: str, run_id: str, status: str, expected: int | None = None, **fields) -> dict:
    """The next state of a run. expected is the revision the caller decided on: a Conflict where it isn't the newest any more."""
    last = get(spark, root, run_id)
    if expected is not None and last["revision"] != expected:
        raise Conflict(f"revision {last['revision']} is there, {expected} was expected")
    if status not in TRANSITIONS[last["status"]]:
        raise Conflict(f"{last['status']} does not lead to {status}")
    times = {"started_at": _now()} if status == "running" else {} if TRANSITIONS[status] else {"finished_at": _now(), "progress": 1.0 if status == "completed" else 0.0}
    return _write(spark, root, last | times | fields | {"revision": last["revision"] + 1, "status": status})


def cancel(spark: SparkSession, root: str, run_id: str, attempts: int = 8) -> dict:
    """Ask a run to stop. Ended runs and those already asked stay as they are; a lost race is decided anew."""
    for _ in range(attempts):
        last = get(spark, root, run_id)
        if "cancel_requested" not in TRANSITIONS[last["status"]]:
            return last
        try:
            return move(spark, root, run_id, "cancel_requested", last["revision"])
        except Conflict:
            continue
    raise Conflict(f"run {run_id} changed {attempts} times")


def is_cancelled(spark: SparkSession, root: str, run_id: str) -> bool:
    """Whether someone asked the run to stop, for a stream or a job that asks between its steps."""
    return get(spark, root, run_id)["status"] in ("cancel_requested", "cancelled")


def states(spark: SparkSession, root: str) -> DataFrame:
    """All states of all runs."""
    return spark.read.schema(SCHEMA).json(f"{root}/*/*.json")


def current(log: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The newest state of each run: partial aggregation before the shuffle, no window."""
    key = key or ["run_id"]
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), "revision").alias("_r")).select(*key, "_r.*")


def broken_steps(log: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key, revision, status) -> states that may not follow the state before: with the status before and a reason.

    A run starts as queued; a status that no table names is unknown. Revisions that repeat or leave gaps are faults, too.
    A run has few states, so its window is small.
    """
    key = key or ["run_id"]
    w = Window.partitionBy(*key).orderBy("revision", "status")
    allowed = F.create_map(*[c for s, to in TRANSITIONS.items() for c in (F.lit(s), F.array(*map(F.lit, to)).cast("array<string>"))])
    steps = log.select(*key, "revision", "status", F.lag("status").over(w).alias("before"), F.lag("revision").over(w).alias("_rev"))
    reason = (
        F.when(F.col("status").isNull() | ~F.col("status").isin(list(TRANSITIONS)), "unknown status")
        .when(F.col("_rev").isNull(), F.when(F.col("status") != "queued", "no start"))
        .when(F.col("revision") == F.col("_rev"), "revision repeats")
        .when(F.col("revision") != F.col("_rev") + 1, "revision missing")
        .when(~F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("before")), F.col("status")), F.lit(False)), "not allowed")
    )
    return steps.withColumn("reason", reason).where("reason IS NOT NULL").drop("_rev")
