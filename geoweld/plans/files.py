"""Layers, catalogs and logs written to the cluster's shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweld.operators.components import shared_folder
from geoweld.plans.derived import SQL, base_boxes
from geoweld.plans.registry import query, table
from geoweld.sources import vectors as V


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query("""WITH k AS (SELECT s_suppkey AS id, s_name AS name, s_suppkey % 5 AS k, s_nationkey::DOUBLE AS x, (s_suppkey % 50)::DOUBLE AS y FROM supplier)
SELECT id, name, CASE WHEN k = 0 THEN 'point' WHEN k = 1 THEN 'line' ELSE 'polygon' END AS kind, CASE WHEN k IN (0, 1, 2) THEN 1 WHEN k = 3 THEN 2 ELSE 3 END AS n_parts, CASE WHEN k = 4 THEN 2 ELSE 1 END AS n_members,
  x AS minx, y AS miny, CASE k WHEN 0 THEN x WHEN 4 THEN x + 30 ELSE x + 9 END AS maxx, CASE k WHEN 0 THEN y WHEN 4 THEN y + 30 ELSE y + 9 END AS maxy FROM k""")
def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points, lines, polygons with and without a hole and multipolygons through GeoJSON lines."""
    k, x, y = F.col("s_suppkey") % 5, F.col("s_nationkey").cast("double"), (F.col("s_suppkey") % 50).cast("double")
    point = lambda a: F.struct((x + a).alias("x"), (y + a).alias("y"))
    ring = lambda a, b: F.array(point(a), F.struct((x + b).alias("x"), (y + a).alias("y")), point(b), point(a))
    parts = F.when(k == 0, F.array(F.array(point(0)))).when(k == 1, F.array(F.array(point(0), point(9)))).when(k == 2, F.array(ring(0, 9))).when(k == 3, F.array(ring(0, 9), ring(2, 3))).otherwise(F.array(ring(0, 9), ring(2, 3), ring(20, 30)))
    members = F.when(k == 4, F.array(F.lit(0), F.lit(0), F.lit(1))).when(k == 3, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))
    kind = F.when(k == 0, "point").when(k == 1, "line").otherwise("polygon")
    folder = _folder(spark)
    V.write_geojson(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), kind.alias("kind"), parts.alias("parts"), members.alias("members")), folder)
    made = V.read_geojson_lines(spark, folder, "id long, name string")
    return made.select("id", "name", "kind", F.size("parts").alias("n_parts"), F.size(F.array_distinct("members")).alias("n_members"), "minx", "miny", "maxx", "maxy")


@query("SELECT s_suppkey AS id, s_nationkey::DOUBLE AS minx, (s_suppkey % 50)::DOUBLE AS miny, (s_nationkey + 4.5)::DOUBLE AS maxx, (s_suppkey % 50 + 3)::DOUBLE AS maxy FROM supplier WHERE s_suppkey % 7 <> 0")
def wkt_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons of a CSV file with WKT; points are left out."""
    x, y = F.col("s_nationkey"), F.col("s_suppkey") % 50
    at = lambda a, b: F.concat_ws(" ", x + a, y + b)
    wkt = F.when(F.col("s_suppkey") % 7 == 0, F.concat(F.lit("POINT("), at(0, 0), F.lit(")"))).otherwise(F.concat(F.lit("POLYGON(("), F.concat_ws(", ", at(0, 0), at(4.5, 0), at(4.5, 3), at(0, 0)), F.lit("))")))
    folder = _folder(spark)
    table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), wkt.alias("geometry")).write.csv(folder, header=True)
    return V.read_csv_wkt(spark, folder).select(F.col("id").cast("long").alias("id"), "minx", "miny", "maxx", "maxy")


@query("SELECT c_custkey AS id, (c_custkey % 180)::DOUBLE AS lon, (c_custkey % 90 + 0.5)::DOUBLE AS lat FROM customer WHERE c_custkey % 10 <> 0")
def tsv_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a tab-separated file; rows without readable coordinates are left out."""
    k, folder = F.col("c_custkey"), _folder(spark)
    lat = F.when(k % 10 == 0, "n/a").otherwise((k % 90 + 0.5).cast("string"))
    table(spark, sf_dir, "customer").select(k.alias("UFI"), lat.alias("LAT"), (k % 180).alias("LONG")).write.csv(folder, header=True, sep="\t")
    return V.read_tsv_points(spark, folder).select(F.col("UFI").cast("long").alias("id"), F.col("minx").alias("lon"), F.col("miny").alias("lat"))


@query("SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'")
def catalog_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a CSV catalog by a value in other case and with outer spaces."""
    folder = _folder(spark)
    table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(" "), F.initcap("c_mktsegment")).alias("segment")).write.csv(folder, header=True, ignoreLeadingWhiteSpace=False)
    return V.read_csv_where(spark, folder, "segment", "building ").select(F.col("c_custkey").cast("long").alias("id"))


@query("SELECT s_nationkey AS run_id, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier GROUP BY 1")
def run_state_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON document for each run, with broken ones beside them."""
    folder = _folder(spark)
    runs = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("run_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))
    whole = runs.select("run_id", F.to_json(F.struct("run_id", "n", "total")).alias("value"))
    broken = runs.select((F.col("run_id") + 1000).alias("run_id"), F.lit("{broken").alias("value"))
    whole.union(broken).withColumnRenamed("run_id", "run").write.partitionBy("run").text(folder)
    return V.read_states(spark, f"{folder}/*/", "run_id long, n long, total double")


@query(f"WITH {SQL['a']} SELECT id, minx, miny, maxx, maxy FROM a WHERE minx <= 300 AND maxx >= 100 AND miny <= 900 AND maxy >= 200")
def layer_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer's rows within a window, of it the columns that exist."""
    folder = _folder(spark)
    V.write_layer(base_boxes(spark, sf_dir), folder)
    return V.read_layer(spark, folder, ["ID", "absent"], (100.0, 200.0, 300.0, 900.0))


@query(f"WITH {SQL['a']} SELECT count(*) AS n, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM a")
def layer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    V.write_layer(base_boxes(spark, sf_dir), folder)
    return V.layer_metadata(V.read_layer(spark, folder))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to a log in two runs."""
    folder, events = _folder(spark), table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    V.append_events(events.where("event_type = 'view'"), folder)
    V.append_events(events.where("event_type <> 'view'"), folder)
    log = spark.read.schema("event_id long, event_type string, value double").json(folder)
    return log.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(f"WITH {SQL['a']} SELECT id % 4 AS tile, count(*) AS n, round(sum(CASE WHEN id % 4 = 2 THEN 1 ELSE height END), 2) AS total FROM a GROUP BY 1")
def tile_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partitioned layer of which one tile is run again: its rows take the place of the old ones, others stay."""
    folder = _folder(spark)
    layer = base_boxes(spark, sf_dir).withColumn("tile", F.col("id") % 4)
    V.write_layer(layer, folder, "tile")
    V.write_layer(layer.where("tile = 2").withColumn("height", F.lit(1.0)), folder, "tile")
    return spark.read.parquet(folder).groupBy(F.col("tile").cast("long").alias("tile")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("height"), 2).alias("total"))


@query("""SELECT c_mktsegment AS segment, v AS version, v = 'a2' AS reused, CASE WHEN v = 'b' THEN count(*) * 2 ELSE count(*) END AS n FROM customer, (VALUES ('a1'), ('a2'), ('b')) t(v) GROUP BY 1, 2""")
def cached_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source kept under its version: read again as it is, made anew for another version."""
    folder, customers = _folder(spark), table(spark, sf_dir, "customer").select("c_mktsegment")
    out = None
    for name, token, make in (("a1", "a", lambda: customers), ("a2", "a", lambda: customers.limit(0)), ("b", "b", lambda: customers.union(customers))):
        layer, reused = V.cached_layer(spark, folder, token, make)
        one = layer.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n")).select("segment", F.lit(name).alias("version"), F.lit(reused).alias("reused"), "n")
        out = one if out is None else out.union(one)
    return out


@query("""WITH s AS (SELECT o_orderstatus AS status, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1)
SELECT f AS "format", status, n, mean FROM s, (VALUES ('csv'), ('json'), ('md')) v(f)""")
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary as CSV, JSON and Markdown, read back from each."""
    folder = _folder(spark)
    V.write_report(table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean")), folder, ["status"])
    kind = "status string, n long, mean double"
    cells = F.split("value", r"\s*\|\s*")
    lines = spark.read.text(f"{folder}/md").where("value LIKE '| %' AND value NOT LIKE '| status %'")
    md = lines.select(cells[1].alias("status"), cells[2].cast("long").alias("n"), cells[3].cast("double").alias("mean"))
    found = {"csv": spark.read.schema(kind).csv(f"{folder}/csv", header=True), "json": spark.read.schema(kind).json(f"{folder}/json"), "md": md}
    one, *rest = (df.select(F.lit(f).alias("format"), "*") for f, df in found.items())
    for df in rest:
        one = one.union(df)
    return one
