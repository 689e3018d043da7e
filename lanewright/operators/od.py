"""Origin-destination tables: units, keys, movements, blending, gateways, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("origin", "destination", "period", "vehicle_class")
# Anchors of the afternoon weight over the minutes of the day: fixed values.
PM_WEIGHT = ((0, 0.5), (300, 0.15), (450, 0.0), (660, 0.25), (840, 0.75), (990, 1.0), (1200, 0.8), (1440, 0.5))


def normalize_units(df: DataFrame, trips: str, basis: Column, minutes: Column) -> DataFrame:
    """trips given per hour or per period, as both."""
    hourly = F.when(basis == "vph", F.col(trips)).otherwise(F.col(trips) * 60 / minutes)
    total = F.when(basis == "vph", F.col(trips) * minutes / 60).otherwise(F.col(trips))
    return df.withColumns({"trips_vph": hourly, "trips_period": total})


def movement(origin_type: Column, destination_type: Column) -> Column:
    side = lambda t: F.when(t == "internal", "internal").otherwise("external")
    return F.concat_ws("_to_", side(origin_type), side(destination_type))


def movement_matrix(df: DataFrame, origin_type: str, destination_type: str, trips: str) -> DataFrame:
    """The four movements, those without trips as zero."""
    spark = df.sparkSession
    spine = spark.createDataFrame([(f"{a}_to_{b}",) for a in ("internal", "external") for b in ("internal", "external")], "movement string")
    sums = df.groupBy(movement(F.col(origin_type), F.col(destination_type)).alias("movement")).agg(F.sum(trips).alias("trips"), F.count("*").alias("n"))
    return spine.join(sums, "movement", "left").select("movement", F.coalesce("trips", F.lit(0.0)).alias("trips"), F.coalesce("n", F.lit(0)).alias("n"))


def period_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("period").agg(F.count("*").alias("n"), F.sum("trips").alias("trips"), F.array_sort(F.collect_set("vehicle_class")).alias("classes"))


def piecewise(x: Column, anchors: tuple[tuple[float, float], ...]) -> Column:
    """Linear between the anchors, constant beyond them."""
    out = F.lit(anchors[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(anchors, anchors[1:]))):
        out = F.when(x < x1, y0 + (y1 - y0) * (x - x0) / (x1 - x0)).otherwise(out)
    return F.when(x < anchors[0][0], F.lit(anchors[0][1])).otherwise(out)


def pm_weight(minute: Column) -> Column:
    return piecewise(F.pmod(minute, F.lit(1440)), PM_WEIGHT)


def blend(df: DataFrame, am: str, pm: str, weight: float, total: Column | float) -> DataFrame:
    """rate: the mixed distribution of two columns, scaled to the total. Two sums, one broadcast row."""
    sums = df.agg(F.sum(am).alias("_a"), F.sum(pm).alias("_p"))
    mixed = (1 - weight) * F.coalesce(F.try_divide(F.col(am), F.col("_a")), F.lit(0.0)) + weight * F.coalesce(F.try_divide(F.col(pm), F.col("_p")), F.lit(0.0))
    scale = total if isinstance(total, Column) else F.lit(float(total))
    return df.join(F.broadcast(sums)).withColumn("rate", mixed * scale).drop("_a", "_p")


def gravity(origin: Column, destination: Column, km: Column) -> Column:
    return F.greatest(F.lit(1e-9), F.sqrt(origin * destination) / F.pow(F.greatest(km, F.lit(1.0)), 1.15))


def gateway_pairs(df: DataFrame) -> DataFrame:
    """Gateways with their two directed edges in one row; consistent where one side, ref and both movements are there."""
    way = lambda c, m: F.max(F.when(F.col("movement") == m, F.col(c)))
    g = df.groupBy("gateway_id").agg(F.count("*").alias("n"), F.size(F.collect_set("movement")).alias("movements"), F.count_distinct("side").alias("sides"), F.count_distinct("ref").alias("refs"), way("edge_id", "inbound").alias("inbound_edge"), way("edge_id", "outbound").alias("outbound_edge"), F.avg("crossing_lon").alias("lon"), F.avg("crossing_lat").alias("lat"))
    return g.withColumn("consistent", (F.col("n") == 2) & (F.col("movements") == 2) & (F.col("sides") == 1) & (F.col("refs") == 1))
