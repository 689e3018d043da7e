"""Frames of a run between which a moment lies, and joins of readings with what describes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def between(frames: DataFrame, asked: DataFrame) -> DataFrame:
    """frames (run, elapsed, agent, x, y), asked (run, at and columns of its own) -> a row for each agent of the frame before
    at, moved towards its place in the frame from at on; an agent without one stays.  Before the first and after the
    last frame these count alone; a run without frames gives no row.  A window runs over a run's moments, not its agents."""
    own = [c for c in asked.columns if c not in ("run", "at")]
    moments = frames.select("run", "elapsed").distinct()
    both = asked.select("run", "at", F.struct("at", *own).alias("ask"), F.lit(None).cast("double").alias("frame")).unionByName(
        moments.select("run", F.col("elapsed").cast("double").alias("at"), F.col("elapsed").cast("double").alias("frame")), allowMissingColumns=True)
    # At the same moment what is asked comes first, so that the frame counts as the next one.
    order = Window.partitionBy("run").orderBy("at", F.col("ask").isNull())
    left = F.last("frame", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    right = F.first("frame", ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    placed = both.select("run", "ask", left.alias("l"), right.alias("r")).where("ask IS NOT NULL")
    placed = placed.select("run", "ask.*", F.coalesce("l", "r").alias("left"), F.coalesce("r", "l").alias("right"))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("at") - F.col("left")) / F.greatest(F.col("right") - F.col("left"), F.lit(1.0))))
    before = frames.select("run", F.col("elapsed").cast("double").alias("left"), "agent", "x", "y")
    after = frames.select("run", F.col("elapsed").cast("double").alias("right"), "agent", F.col("x").alias("_x"), F.col("y").alias("_y"))
    moved = placed.join(before, ["run", "left"]).join(after, ["run", "right", "agent"], "left")
    towards = lambda c: F.coalesce(F.col(c) + (F.col("_" + c) - F.col(c)) * share, F.col(c)).alias(c)
    return moved.select("run", "at", *own, "agent", towards("x"), towards("y"))


def star(readings: DataFrame, dimensions: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """readings with the columns of each dimension (unique by its key), and missing: the first dimension that lacks the key, else null."""
    out, missing = readings, F.lit(None).cast("string")
    for name, (dimension, key) in reversed(dimensions.items()):
        out = out.join(dimension.withColumn(f"_has_{name}", F.lit(True)), key, "left")
        missing = F.when(F.col(f"_has_{name}").isNull(), name).otherwise(missing)
    return out.withColumn("missing", missing).drop(*(f"_has_{n}" for n in dimensions))
