"""Sources: Parquet, CSV, JSON features, XML of networks and routes, checked landing files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewright.operators.validate import require_columns


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """Projected and filtered scan; Hive partitions of the path are columns."""
    df = spark.read.parquet(path)
    df = df.where(where) if where else df
    return require_columns(df, columns).select(*columns) if columns else df


def all_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header with trimmed lower-case names, every value text, quotes doubled inside quotes."""
    df = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=True)
    return df.toDF(*(c.strip().lower() for c in df.columns))


def table(spark: SparkSession, path: str) -> DataFrame:
    """CSV or Parquet by suffix."""
    if path.rsplit("?", 1)[0].endswith(".csv"):
        return all_text_csv(spark, path)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError("only .csv and .parquet are read")


POINT = "type string, features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def features(spark: SparkSession, path: str) -> DataFrame:
    """properties (map), kind and coordinates (JSON text) of each feature of GeoJSON files."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", POINT).alias("c"))
    return raw.select(F.explode("c.features").alias("f")).select("f.properties", F.col("f.geometry.type").alias("kind"), "f.geometry.coordinates")


def point_features(spark: SparkSession, path: str) -> DataFrame:
    at = F.from_json("coordinates", "array<double>")
    return features(spark, path).where("kind = 'Point'").select("properties", F.get(at, F.lit(0)).alias("x"), F.get(at, F.lit(1)).alias("y"))


def line_features(spark: SparkSession, path: str) -> DataFrame:
    """Lines as arrays of points; of several parts the one with the most points."""
    single = F.from_json("coordinates", "array<array<double>>")
    many = F.from_json("coordinates", "array<array<array<double>>>")
    longest = F.element_at(F.array_sort(F.transform(many, lambda p: F.struct(F.size(p).alias("n"), p.alias("p")))), -1)["p"]
    points = F.transform(F.when(F.col("kind") == "LineString", single).otherwise(longest), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return features(spark, path).where("kind IN ('LineString', 'MultiLineString')").select("properties", points.alias("line"))


def network_edges(spark: SparkSession, path: str) -> DataFrame:
    """edge_id, length, lanes of a network's XML, internal edges left out; the length is the first lane's."""
    kind = "_id string, _function string, lane array<struct<_id:string,_length:double,_speed:double>>"
    edges = spark.read.format("xml").option("rowTag", "edge").schema(kind).load(path)
    return edges.where("_id NOT LIKE ':%'").select(F.col("_id").alias("edge_id"), F.get("lane", F.lit(0))["_length"].alias("length_m"), F.size("lane").alias("lanes"))


def routes(spark: SparkSession, path: str) -> DataFrame:
    """vehicle and its edges in order."""
    kind = "_id string, _depart double, route struct<_edges:string>"
    return spark.read.format("xml").option("rowTag", "vehicle").schema(kind).load(path).select(F.col("_id").alias("vehicle_id"), F.col("_depart").alias("depart"), F.split(F.trim("route._edges"), r"\s+").alias("edge_ids"))


def trip_info(spark: SparkSession, path: str) -> DataFrame:
    kind = "_id string, _depart double, _arrival double, _duration double, _routeLength double"
    return spark.read.format("xml").option("rowTag", "tripinfo").schema(kind).load(path).select(F.col("_id").alias("vehicle_id"), F.col("_depart").alias("depart"), F.col("_arrival").alias("arrival"), F.col("_duration").alias("duration"), F.col("_routeLength").alias("length_m"))


def verified_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """manifest (name, bytes, sha256) with whether each file is there as it says; partial files never pass."""
    seen = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("_bytes"), F.sha2("content", 256).alias("_sha"))
    out = manifest.join(seen.where("name NOT LIKE '%.part'"), "name", "left")
    return out.withColumn("verified", F.coalesce((F.col("bytes") == F.col("_bytes")) & (F.col("sha256") == F.col("_sha")), F.lit(False))).drop("_bytes", "_sha")


def gateways(spark: SparkSession, path: str) -> DataFrame:
    """The gateways of an inventory, in a fixed order."""
    kind = "gateways array<struct<gateway_id:string,side:string,ref:string,movement:string,edge_id:string,interior_node_id:string,exterior_node_id:string,crossing_lon:double,crossing_lat:double,road_class:string,road_name:string>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("g"))
    return raw.select(F.explode("g.gateways").alias("g")).select("g.*").orderBy("gateway_id", "movement", "edge_id")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, gzip or not, by a given schema."""
    return spark.read.schema(schema).json(path)


def log_categories(spark: SparkSession, path: str, ladder: dict[str, str]) -> DataFrame:
    """Lines counted by the first category whose text they hold."""
    out = F.lit("other")
    for name, text in reversed(list(ladder.items())):
        out = F.when(F.lower("value").contains(text.lower()), name).otherwise(out)
    return spark.read.text(path).groupBy(out.alias("category")).agg(F.count("*").alias("n"))


def observed_stations(stations: DataFrame, highways: DataFrame, observed: DataFrame, prefix: str = "portal-station-") -> DataFrame:
    """Stations (properties, x, y) that observations name, each once, with the name of their highway (highwayid, highwayname);
    reason says what is wrong: no point, or a highway that isn't listed."""
    own = stations.select(F.concat(F.lit(prefix), F.trim(F.col("properties")["stationid"])).alias("station_id"), F.col("properties")["highwayid"].cast("long").alias("highwayid"), F.trim(F.coalesce(F.col("properties")["locationtext"], F.lit(""))).alias("location"), "x", "y")
    named = highways.select(F.col("highwayid").cast("long").alias("highwayid"), F.trim("highwayname").alias("highway"), F.lit(True).alias("_known"))
    out = own.join(observed.select("station_id").distinct(), "station_id", "left_semi").groupBy("station_id").agg(F.min(F.struct("highwayid", "location", "x", "y")).alias("s")).select("station_id", "s.*")
    reason = F.when(F.col("x").isNull() | F.col("y").isNull(), "no_point").when(F.col("_known").isNull(), "unknown_highway")
    return out.join(named, "highwayid", "left").withColumn("reason", reason).drop("_known")


def gateway_connectors(spark: SparkSession, path: str, version: str, sha256: str) -> DataFrame:
    """(gateway_id, origin, destination, evidence) of a connector file that is bound to one network.

    Errors, in this order: another schema than 1, another version or checksum of the network, no gateways, rows
    without an id or an edge, a gateway twice, another count than the file declares. All are told by one pass over the rows.
    """
    kind = "schema_version long, sumo_network_version string, sumo_network_sha256 string, gateway_count long, gateways array<struct<gateway_id:string,inbound_sumo_edge_id:string,outbound_sumo_edge_id:string,evidence:string>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("g")).select("g.*")
    text = lambda c: F.trim(F.coalesce(F.col(f"r.{c}"), F.lit("")))
    each = raw.select("schema_version", "sumo_network_version", "sumo_network_sha256", "gateway_count", F.explode_outer("gateways").alias("r"))
    rows = each.select("*", text("gateway_id").alias("gateway_id"), text("inbound_sumo_edge_id").alias("origin"), text("outbound_sumo_edge_id").alias("destination"), F.coalesce(F.nullif(text("evidence"), F.lit("")), F.lit("reviewed_gateway_connector")).alias("evidence"))
    told = rows.agg(
        F.coalesce(F.bool_and(F.coalesce(F.col("schema_version") == 1, F.lit(False))), F.lit(False)).alias("schema"),
        F.coalesce(F.bool_and(F.coalesce(F.col("sumo_network_version") == version, F.lit(False))), F.lit(False)).alias("version"),
        F.coalesce(F.bool_and(F.coalesce(F.col("sumo_network_sha256") == sha256, F.lit(False))), F.lit(False)).alias("sha"),
        F.count("r").alias("n"),
        F.count_if(F.expr("r IS NOT NULL AND (gateway_id = '' OR origin = '' OR destination = '')")).alias("bare"),
        F.count_distinct(F.when(F.col("r").isNotNull(), F.col("gateway_id"))).alias("ids"),
        F.max("gateway_count").alias("declared"),
    ).head()
    for wrong, why in [(not told.schema, "schema_version is not 1"), (not told.version, "not the version of the network"), (not told.sha, "not the checksum of the network"),
                       (told.n == 0, "no gateways"), (told.bare > 0, "a gateway without an id or an edge"), (told.ids != told.n, "a gateway twice"), (told.declared != told.n, "gateway_count is not the number of gateways")]:
        if wrong:
            raise ValueError(f"{path}: {why}")
    return rows.select("gateway_id", "origin", "destination", "evidence")
