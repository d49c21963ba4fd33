import gzip
import json

import pytest
from pyspark.sql import functions as F

from geoweld.functions import polygons as P
from geoweld.sources import vectors as V

SQUARE = "POLYGON((0 0, 4 0, 4 3, 0 3, 0 0))"


def test_geojson_round_trip(spark, tmp_path):
    square = {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 3], [0, 3], [0, 0]]]}
    lines = [{"properties": {"id": "a", "height": 2.5}, "geometry": square}, {"properties": {"id": "b"}, "geometry": None}, {"properties": {"id": "c"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]
    with gzip.open(tmp_path / "f.json.gz", "wt") as f:
        f.write("\n".join(map(json.dumps, lines)) + "\n\n{broken\n")
    got = V.read_geojson_lines(spark, str(tmp_path / "f.json.gz"), "id string, height double")
    assert sorted((r.id, r.kind, r.maxx, r.maxy) for r in got.collect()) == [("a", "polygon", 4.0, 3.0), ("c", "point", 1.0, 2.0)]
    assert V.read_geojson_lines(spark, str(tmp_path / "f.json.gz"), "id string", True).count() == 1
    V.write_geojson(got, str(tmp_path / "out"))
    again = V.read_geojson_lines(spark, str(tmp_path / "out"), "id string, height double")
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))


def test_multi_geometries_round_trip(spark, tmp_path):
    ring = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    shapes = [
        {"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]}, {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]},
        {"type": "MultiPolygon", "coordinates": [[ring(0, 9), ring(2, 3)], [ring(20, 22)]]}, {"type": "Polygon", "coordinates": [ring(0, 9), ring(2, 3)]},
        {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}, {"type": "Point", "coordinates": [1, 2]},
    ]
    (tmp_path / "in").write_text("\n".join(json.dumps({"properties": {"id": i}, "geometry": g}) for i, g in enumerate(shapes)))
    got = V.read_geojson_lines(spark, str(tmp_path / "in"), "id long")
    V.write_geojson(got, str(tmp_path / "out"))
    told = {json.loads(r.value)["properties"]["id"]: json.loads(r.value)["geometry"] for r in spark.read.text(str(tmp_path / "out")).collect()}
    assert told == dict(enumerate(shapes))
    (tmp_path / "w.csv").write_text('id,geometry\n0,"MULTIPOLYGON(((0 0,9 0,9 9,0 0),(2 2,3 2,3 3,2 2)),((20 20,22 20,22 22,20 20)))"\n1,"POLYGON((0 0,9 0,9 9,0 0),(2 2,3 2,3 3,2 2))"\n')
    assert {r.id: r.members for r in V.read_csv_wkt(spark, str(tmp_path / "w.csv")).collect()} == {"0": [0, 0, 1], "1": [0, 0]}
    assert json.loads(V.geojson(got.withColumn("parts", F.lit(None).cast(V.PARTS))).first().value)["geometry"] is None


def test_update_mode_keeps_rows_of_earlier_batches(spark, tmp_path):
    from geoweld.streaming import events as E

    for i, rows in enumerate(['{"k":1,"v":1}\n{"k":2,"v":1}', '{"k":1,"v":5}']):
        (tmp_path / f"{i}.json").write_text(rows)
    stream = spark.readStream.schema("k long, v long").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    plan = lambda s: s.groupBy("k").agg(F.sum("v").alias("v"))
    for mode in ("update", "complete"):
        assert sorted(map(tuple, E.run_available(spark, stream, plan, mode, ["k"]).collect())) == [(1, 6), (2, 1)]


def test_tables(spark, tmp_path):
    (tmp_path / "w.csv").write_text(f'name,geometry\nx,"{SQUARE}"\ny,POINT(1 1)\n')
    assert [(r.name, r.maxx) for r in V.read_csv_wkt(spark, str(tmp_path / "w.csv")).collect()] == [("x", 4.0)]
    with pytest.raises(ValueError):
        V.read_csv_wkt(spark, str(tmp_path / "w.csv"), "shape")
    (tmp_path / "t.tsv").write_text("UFI\tLAT\tLONG\n1\t2.5\t3\n2\tx\t3\n")
    assert [(r.UFI, r.minx, r.miny) for r in V.read_tsv_points(spark, str(tmp_path / "t.tsv")).collect()] == [("1", 3.0, 2.5)]
    assert V.read_csv_where(spark, str(tmp_path / "w.csv"), "name", " X ").count() == 1
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.json").write_text('{"run_id": "r", "phase": "x"}')
    (tmp_path / "s" / "b.json").write_text("{nope")
    assert [r.run_id for r in V.read_states(spark, str(tmp_path / "s"), "run_id string, phase string").collect()] == ["r"]


def test_layer_pushdown(spark, tmp_path):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 5).alias("tile"), *(F.col("id").cast("double").alias(c) for c in ("minx", "miny", "maxx", "maxy")))
    V.write_layer(df, str(tmp_path / "l"), "tile")
    V.write_layer(df.where("tile = 1"), str(tmp_path / "l"), "tile")
    found = V.read_layer(spark, str(tmp_path / "l"), ["ID", "none"], (10.0, 10.0, 12.0, 12.0))
    assert sorted(r.id for r in found.collect()) == [10, 11, 12] and found.columns == ["id", "minx", "miny", "maxx", "maxy"]
    assert "PushedFilters: [IsNotNull" in found._jdf.queryExecution().toString()
    assert V.layer_metadata(V.read_layer(spark, str(tmp_path / "l"))).first().n == 100


def test_polygons(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]
    other = [(2.0, 1.0), (9.0, 1.0), (9.0, 9.0), (2.0, 9.0)]
    df = spark.createDataFrame([(ring, other, 1.0, 1.0), (None, None, 1.0, 1.0), ([], ring, 5.0, 5.0)], "a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>, x double, y double")
    got = df.select(
        P.ring_area(F.col("a")).alias("area"), P.ring_centroid(F.col("a")).alias("c"), P.contains_point(F.col("a"), F.col("x"), F.col("y")).alias("inside"), P.line_length(P.closed(F.col("a"))).alias("len"), P.shared_polygon_area("a", "b").alias("shared"), P.oriented_rectangle("a").alias("r"), P.bounds(F.col("a")).alias("b")
    ).collect()
    one = got[0]
    assert (one.area, one.c.x, one.c.y, one.inside, one.len, one.shared) == (12.0, 2.0, 1.5, True, 14.0, 4.0)
    assert (one.r.long_side, one.r.short_side, one.r.direction) == (4.0, 3.0, 0.0) and one.b.maxy == 3.0
    assert got[1].area is None and got[1].shared == 0.0 and got[2].area == 0.0 and not got[2].inside
