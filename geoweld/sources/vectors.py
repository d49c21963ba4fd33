"""Reading and writing vector layers.

A layer has attribute columns, kind (point, line, polygon), parts (array of arrays of
points), members (for each part, the number from 0 of the point, line or polygon that it belongs to; a polygon's first
part is its outer ring, the others are its holes) and the bounds minx, miny, maxx, maxy as columns of their own, so that a filter on them
reaches the Parquet statistics.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweld.functions.geometry import BOX

PARTS = "array<array<struct<x:double,y:double>>>"
GEOMETRY = "struct<type:string,coordinates:string>"


def _with_bounds(df: DataFrame) -> DataFrame:
    flat = F.flatten("parts")
    xs, ys = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
    return df.withColumns({"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)})


def within(df: DataFrame, bbox: tuple[float, float, float, float] | None) -> DataFrame:
    """Rows whose bounds meet the box; a comparison of columns, so files and row groups outside are skipped."""
    if bbox is None:
        return df
    x1, y1, x2, y2 = bbox
    return df.where((F.col("minx") <= x2) & (F.col("maxx") >= x1) & (F.col("miny") <= y2) & (F.col("maxy") >= y1))


def read_layer(spark: SparkSession, path: str, columns: list[str] | None = None, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A layer kept as Parquet; of `columns` those that exist, with the bounds."""
    df = within(spark.read.parquet(path), bbox)
    if columns is None:
        return df
    there = {c.lower(): c for c in df.columns}
    wanted = [there[c.lower()] for c in columns if c.lower() in there]
    return df.select(*wanted, *(c for c in BOX if c not in wanted))


def layer_metadata(df: DataFrame) -> DataFrame:
    """n and bounds, one row; Spark answers from Parquet footers where it may."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


def parts_of_json(kind: Column, coordinates: Column) -> Column:
    """GeoJSON coordinates, as JSON text, as parts; the exterior and holes of polygons are parts alike. Null for other kinds."""
    pair = lambda c: F.struct(F.get(c, 0).alias("x"), F.get(c, 1).alias("y"))
    line = lambda ps: F.transform(ps, pair)
    point = F.from_json(coordinates, "array<double>")
    one, two, three = (F.from_json(coordinates, "array<" * k + "double" + ">" * k) for k in (2, 3, 4))
    return (
        F.when(kind == "Point", F.array(F.array(pair(point))))
        .when(kind == "MultiPoint", F.transform(one, lambda p: F.array(pair(p))))
        .when(kind == "LineString", F.array(line(one)))
        .when(kind.isin("MultiLineString", "Polygon"), F.transform(two, line))
        .when(kind == "MultiPolygon", F.flatten(F.transform(three, lambda poly: F.transform(poly, line))))
    )


def members_of_json(kind: Column, coordinates: Column, parts: Column) -> Column:
    """Which point, line or polygon each of the parts belongs to."""
    polygons = F.from_json(coordinates, "array<array<string>>")
    by_polygon = F.flatten(F.transform(polygons, lambda rings, i: F.transform(rings, lambda r: i)))
    return F.when(kind == "MultiPolygon", by_polygon).otherwise(_members(parts, kind == "Polygon"))


def _members(parts: Column, one_polygon: Column) -> Column:
    return F.transform(parts, lambda p, i: F.when(one_polygon, F.lit(0)).otherwise(i))


def read_geojson_lines(spark: SparkSession, path: str, properties: str, polygons_only: bool = False) -> DataFrame:
    """One GeoJSON feature a line, gzipped or not; properties is the schema of the attributes.

    Blank and broken lines and rows without a geometry are left out, and
    with polygons_only those of another kind.
    """
    raw = spark.read.schema(f"properties struct<{properties}>, geometry {GEOMETRY}").option("mode", "PERMISSIVE").json(path)
    kind = F.col("geometry.type")
    parts = parts_of_json(kind, F.col("geometry.coordinates"))
    members = members_of_json(kind, F.col("geometry.coordinates"), parts)
    made = raw.select("properties.*", kind.alias("geometry_type"), parts.alias("parts"), members.alias("members"))
    made = made.where(F.col("parts").isNotNull() & (F.size("parts") > 0))
    if polygons_only:
        made = made.where(F.col("geometry_type").isin("Polygon", "MultiPolygon"))
    return _with_bounds(made.withColumn("kind", feature_kind(F.col("geometry_type"))).drop("geometry_type"))


def feature_kind(geometry_type: Column) -> Column:
    t = F.lower(geometry_type)
    return F.when(t.contains("polygon"), "polygon").when(t.contains("line"), "line").when(t.contains("point"), "point")


def parts_of_wkt(wkt: Column) -> Column:
    """The parts of a WKT text: each innermost pair of brackets is one."""
    rings = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))
    point = lambda t: F.struct(F.split(F.trim(t), r"\s+")[0].try_cast("double").alias("x"), F.split(F.trim(t), r"\s+")[1].try_cast("double").alias("y"))
    return F.transform(rings, lambda r: F.transform(F.split(r, ","), point))


def members_of_wkt(wkt: Column) -> Column:
    """Which polygon of a multipolygon, or which point or line, each part belongs to."""
    rings = lambda t: F.regexp_extract_all(t, F.lit(r"\(([^()]+)\)"), F.lit(1))
    polygons = F.regexp_extract_all(wkt, F.lit(r"\(\s*(\([^()]+\)(?:\s*,\s*\([^()]+\))*)\s*\)"), F.lit(1))
    by_polygon = F.flatten(F.transform(polygons, lambda t, i: F.transform(rings(t), lambda r: i)))
    return F.when(wkt.rlike(r"(?i)^\s*MULTIPOLYGON"), by_polygon).otherwise(_members(rings(wkt), wkt.rlike(r"(?i)^\s*POLYGON")))


def read_csv_wkt(spark: SparkSession, path: str, column: str = "geometry", polygons_only: bool = True) -> DataFrame:
    """A CSV file with header and a WKT column; an error if there is no such column."""
    raw = spark.read.csv(path, header=True)
    if column not in raw.columns:
        raise ValueError(f"{path} has no column {column}")
    kind = feature_kind(F.regexp_extract(F.col(column), r"^\s*([A-Za-z]+)", 1))
    made = raw.withColumns({"kind": kind, "parts": parts_of_wkt(F.col(column)), "members": members_of_wkt(F.col(column))}).where("kind IS NOT NULL AND size(parts) > 0")
    return _with_bounds((made.where("kind = 'polygon'") if polygons_only else made).drop(column))


def read_tsv_points(spark: SparkSession, path: str, lon: str = "LONG", lat: str = "LAT") -> DataFrame:
    """A tab-separated file as points; rows without readable coordinates are left out."""
    raw = spark.read.csv(path, header=True, sep="\t")
    x, y = F.col(lon).try_cast("double"), F.col(lat).try_cast("double")
    made = raw.withColumns({"kind": F.lit("point"), "parts": F.array(F.array(F.struct(x.alias("x"), y.alias("y")))), "members": F.array(F.lit(0))})
    return _with_bounds(made.where(x.isNotNull() & y.isNotNull()))


def read_csv_where(spark: SparkSession, path: str, column: str, value: str) -> DataFrame:
    """Rows of a catalog whose column equals value apart from case and outer spaces."""
    return spark.read.csv(path, header=True).where(F.lower(F.trim(column)) == value.strip().lower())


def read_states(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents of run states; broken ones are left out."""
    raw = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path, multiLine=True)
    return raw.where("_broken IS NULL").drop("_broken")


def geojson(df: DataFrame) -> DataFrame:
    """value: a GeoJSON feature of each row, for write.text; of several points, lines or polygons a Multi one.

    Without a column members, the parts of a polygon are the rings of one. A row without parts has a null geometry.
    """
    attributes = [c for c in df.columns if c not in {"kind", "parts", "members", *BOX}]
    polygon = F.col("kind") == "polygon"
    members = F.col("members") if "members" in df.columns else _members(F.col("parts"), polygon)
    rings = F.transform("parts", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    paired = F.arrays_zip(members.alias("m"), rings.alias("r"))
    polygons = F.transform(F.array_distinct(members), lambda m: F.transform(F.filter(paired, lambda x: x["m"] == m), lambda x: x["r"]))
    many = F.size(F.array_distinct(members)) > 1
    first, text = F.get(rings, F.lit(0)), F.to_json
    coordinates = (
        F.when(polygon & many, text(polygons)).when(polygon, text(rings))
        .when(F.col("kind") == "line", F.when(many, text(rings)).otherwise(text(first)))
        .otherwise(F.when(many, text(F.transform(rings, lambda r: F.get(r, F.lit(0))))).otherwise(text(F.get(first, F.lit(0)))))
    )
    name = F.when(polygon, "Polygon").when(F.col("kind") == "line", "LineString").otherwise("Point")
    shape = F.concat(F.lit('{"type":"'), F.when(many, "Multi").otherwise(""), name, F.lit('","coordinates":'), coordinates, F.lit("}"))
    own = F.to_json(F.struct(*attributes), {"ignoreNullFields": "false"}) if attributes else F.lit("{}")
    return df.select(F.concat(F.lit('{"type":"Feature","properties":'), own, F.lit(',"geometry":'), F.coalesce(F.when(F.size("parts") > 0, shape), F.lit("null")), F.lit("}")).alias("value"))


def write_geojson(df: DataFrame, path: str) -> None:
    geojson(df).write.mode("overwrite").text(path)


def cached_layer(spark: SparkSession, folder: str, version: str, make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The layer that is kept under a version token, and whether it was there; else what make gives, which is kept.

    A version is whole once Spark has written its _SUCCESS file; what a lost run left is written anew.
    """
    path = f"{folder}/version={hashlib.sha256(version.encode()).hexdigest()}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)
    if not there:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), there


def write_report(df: DataFrame, folder: str, order: list[str]) -> None:
    """A summary table, which is small, in order as CSV, JSON lines and a Markdown table, in folders of these names."""
    rows = df.orderBy(*order).coalesce(1)
    rows.write.mode("overwrite").csv(f"{folder}/csv", header=True)
    rows.write.mode("overwrite").json(f"{folder}/json")
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = df.sparkSession.createDataFrame([("| " + " | ".join(df.columns) + " |",), ("|" + "-|" * len(df.columns),)], "value string").coalesce(1)
    own = rows.select(line([F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]).alias("value"))
    head.union(own).coalesce(1).write.mode("overwrite").text(f"{folder}/md")


def append_events(df: DataFrame, path: str) -> None:
    """JSON lines of an event log."""
    df.write.mode("append").json(path)


def write_layer(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Parquet, by partition if named; a partition is replaced whole, so that a tile can be run again."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
