"""GeoParquet: footers checked for one declared CRS, geometries decoded from WKB in Arrow batches."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_SHAPE = pa.list_(pa.list_(pa.list_(_POINT)))
SHAPE = "array<array<array<struct<x:double,y:double>>>>"
# Codes of the format, and the CRS of files that name none: fixed values.
KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}
DEFAULT_CRS = "OGC:CRS84"


def _crs_name(column: dict) -> str | None:
    """authority:code of a column's CRS; the format's own if it isn't mentioned, None if it is null."""
    if "crs" not in column:
        return DEFAULT_CRS
    crs = column["crs"]
    if crs is None:
        return None
    at = crs.get("id") or {}
    return f"{at['authority']}:{at['code']}" if at else crs.get("name", "unnamed")


def _footers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    for b in batches:
        rows = []
        for path in b.column(0).to_pylist():
            system, at = fs.FileSystem.from_uri(path)
            with system.open_input_file(at) as f:
                meta = json.loads((pq.read_metadata(f).metadata or {}).get(b"geo", b"{}"))
            for name, column in (meta.get("columns") or {"": {"crs": None}}).items():
                rows.append((name, name == meta.get("primary_column"), column.get("encoding"), _crs_name(column)))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.bool_(), pa.string(), pa.string()), strict=True)], ["name", "main", "encoding", "crs"])


def geometry_columns(df: DataFrame) -> list:
    """name, main, encoding, crs as the files' footers have them: a row for each different one, read where the files are."""
    spark = df.sparkSession
    files = df.inputFiles()
    paths = spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, min(len(files), 256)))
    return paths.mapInArrow(_footers, "name string, main boolean, encoding string, crs string").distinct().collect()


def read_geoparquet(spark: SparkSession, path: str | list[str], crs: str | None = None) -> tuple[DataFrame, str]:
    """The table with its main geometry column decoded to kind and shape, and its CRS.

    Raises where a file has no geometry metadata or no CRS, where files differ in column or CRS, where the
    encoding is not WKB, or where another CRS than the one asked for is declared.
    """
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    found = geometry_columns(df)
    if any(r.name == "" for r in found):
        raise ValueError("no geometry metadata in a file")
    main = [r for r in found if r.main]
    if any(r.crs is None for r in main):
        raise ValueError("a geometry has no CRS")
    if len({(r.name, r.crs) for r in main}) != 1:
        raise ValueError("files differ in geometry column or CRS: " + ", ".join(sorted(f"{r.name} {r.crs}" for r in main)))
    if {r.encoding for r in main} != {"WKB"}:
        raise ValueError("only WKB geometries are read")
    if crs is not None and main[0].crs != crs:
        raise ValueError(f"CRS is {main[0].crs}, not {crs}")
    return decode(df, main[0].name), main[0].crs


def parse_wkb(raw: bytes) -> tuple[str, list]:
    """kind and shape (polygons of rings of points) of a geometry; points and lines as a ring of their own; heights are dropped."""
    at = 0

    def head() -> tuple[str, int, int]:
        nonlocal at
        order = "<" if raw[at] else ">"
        code = struct.unpack_from(order + "I", raw, at + 1)[0]
        at += 5
        extra = bool(code & 0x80000000) + bool(code & 0x40000000)
        if code & 0x20000000:
            at += 4
        code &= 0x0FFFFFFF
        extra = extra or (2 if code >= 3000 else 1 if code >= 1000 else 0)
        return order, code % 1000, 2 + extra

    def count(order: str) -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(order + "I", raw, at - 4)[0]

    def points(order: str, n: int, width: int) -> list[dict]:
        nonlocal at
        xy = np.frombuffer(raw, order + "f8", n * width, at).reshape(n, width)
        at += 8 * n * width
        return [{"x": x, "y": y} for x, y in xy[:, :2].tolist()]

    def one() -> tuple[int, list]:
        order, code, width = head()
        if code == 1:
            p = points(order, 1, width)
            return code, [] if p[0]["x"] != p[0]["x"] else [[p]]
        if code == 2:
            return code, [[points(order, count(order), width)]]
        if code == 3:
            rings = [points(order, count(order), width) for _ in range(count(order))]
            return code, [rings] if rings else []
        if code in (4, 5, 6):
            return code, [part for _ in range(count(order)) for part in one()[1]]
        raise ValueError(f"geometry type {code} is not read")

    code, shape = one()
    return KINDS[code], shape


def _decode(batches: Iterable[pa.RecordBatch], place: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [(None, None) if raw is None else parse_wkb(raw) for raw in b.column(place).to_pylist()]
        rest = [c for i, c in enumerate(b.columns) if i != place]
        yield pa.record_batch([*rest, pa.array([k for k, _ in found], pa.string()), pa.array([s for _, s in found], _SHAPE)], names)


def decode(df: DataFrame, column: str) -> DataFrame:
    """df with a WKB column replaced by kind and shape; null stays null."""
    place = df.columns.index(column)
    rest = [f for f in df.schema.fields if f.name != column]
    names = [*(f.name for f in rest), "kind", "shape"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return df.mapInArrow(partial(_decode, place=place, names=names), (fields + ", " if fields else "") + f"kind string, shape {SHAPE}")


def lines(df: DataFrame) -> DataFrame:
    """The line of each row of kind LineString, as an array of points."""
    return df.where("kind = 'LineString'").withColumn("line", F.get(F.get("shape", F.lit(0)), F.lit(0))).drop("kind", "shape")


def zone_features(features: DataFrame) -> DataFrame:
    """properties and shape of polygon features (properties, kind, coordinates as JSON text); features without one have an empty shape."""
    polygon, many = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    shape = F.when(F.col("kind") == "Polygon", F.array(F.from_json("coordinates", polygon))).when(F.col("kind") == "MultiPolygon", F.from_json("coordinates", many)).otherwise(F.array().cast(many))
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    return features.select("properties", F.transform(shape, lambda rings: F.transform(rings, lambda ring: F.transform(ring, point))).alias("shape"))
