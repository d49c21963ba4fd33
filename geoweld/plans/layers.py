"""Queries of nearest neighbours, displacement, projection and quarantining intake."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweld.functions import geometry as G
from geoweld.functions.overlay import shapes_area
from geoweld.operators import records as R
from geoweld.operators import summaries as Y
from geoweld.operators import tile_jobs as J
from geoweld.operators.components import shared_folder
from geoweld.operators.grid_join import best_per, grid_join
from geoweld.operators.matching import similar_boxes
from geoweld.operators.nearest import nearest_rows
from geoweld.operators.tiling import dealt_to_tiles, partition_bbox
from geoweld.operators.zonal import zonal_statistics
from geoweld.plans.derived import CELL, SQL, _at, base_boxes, base_points, other_boxes, other_points, spread
from geoweld.plans.overlays import _pieces, shaped
from geoweld.plans.registry import query, table
from geoweld.sources.rasters import read_blocks, write_rasters
from geoweld.sources.shapefiles import read_bundles, write_bundles
from geoweld.streaming import events as E

# every ninth customer lies far from all parts
_FAR_X, _FAR_Y = "CASE WHEN id % 9 = 0 THEN x * 50 - 20000 ELSE x END", "CASE WHEN id % 9 = 0 THEN y * 30 + 40000 ELSE y END"


@query(f"""WITH {SQL['pa']}, {SQL['pb']}, q AS (SELECT id, {_FAR_X} AS x, {_FAR_Y} AS y FROM pa),
d AS (SELECT q.id AS a_id, pb.id AS b_id, sqrt((q.x - pb.x) ** 2 + (q.y - pb.y) ** 2) AS d FROM q, pb)
SELECT a_id, b_id, round(d, 6) AS dist, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY d, b_id) AS rank FROM d) WHERE rank <= 3""")
def three_nearest_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three parts nearest to each customer, be they near or far."""
    asked = base_points(spark, sf_dir).selectExpr("id", f"{_FAR_X} AS x", f"{_FAR_Y} AS y")
    parts = other_points(spark, sf_dir).selectExpr("id", "x AS minx", "y AS miny", "x AS maxx", "y AS maxy")
    return nearest_rows(asked, parts, CELL, 3).select("a_id", "b_id", F.round("dist", 6).alias("dist"), "rank")


def _displacement_sql(rounds: int) -> str:
    """CTEs k0 ... of the boxes after each round, and c of the conflicts that are left."""
    over = "(least(a.maxx, b.maxx) - greatest(a.minx, b.minx)) * (least(a.maxy, b.maxy) - greatest(a.miny, b.miny))"
    meet = "a.id < b.id AND a.minx < b.maxx AND b.minx < a.maxx AND a.miny < b.maxy AND b.miny < a.maxy"
    out = [f"""g AS (SELECT DISTINCT CASE WHEN a.area <= b.area THEN a.id ELSE b.id END AS id FROM s a JOIN s b ON {meet} WHERE {over} >= 0.65 * least(a.area, b.area)),
k0 AS MATERIALIZED (SELECT *, FALSE AS moved FROM s WHERE id NOT IN (SELECT id FROM g))"""]
    for i in range(1, rounds + 1):
        mx, my = "(m.minx + m.maxx) / 2 - (o.minx + o.maxx) / 2", "(m.miny + m.maxy) / 2 - (o.miny + o.maxy) / 2"
        out.append(f"""p{i} AS (SELECT CASE WHEN a.area <= b.area THEN a.id ELSE b.id END AS id, CASE WHEN a.area <= b.area THEN b.id ELSE a.id END AS other, {over} AS v
  FROM k{i - 1} a JOIN k{i - 1} b ON {meet} WHERE {over} >= 0.2 AND NOT (a.moved AND b.moved)),
w{i} AS (SELECT p.id, {mx} AS x, {my} AS y FROM (SELECT * FROM p{i} QUALIFY row_number() OVER (PARTITION BY id ORDER BY v DESC, other) = 1) p JOIN k{i - 1} m ON m.id = p.id JOIN k{i - 1} o ON o.id = p.other),
t{i} AS (SELECT id, CASE WHEN x = 0 AND y = 0 THEN {3 * i} ELSE {3 * i} * x / sqrt(x * x + y * y) END AS x, CASE WHEN x = 0 AND y = 0 THEN 0 ELSE {3 * i} * y / sqrt(x * x + y * y) END AS y FROM w{i}),
k{i} AS MATERIALIZED (SELECT k.id, minx + coalesce(t.x, 0) AS minx, miny + coalesce(t.y, 0) AS miny, maxx + coalesce(t.x, 0) AS maxx, maxy + coalesce(t.y, 0) AS maxy, area, moved OR t.id IS NOT NULL AS moved FROM k{i - 1} k LEFT JOIN t{i} t ON t.id = k.id)""")
    out.append(f"c AS (SELECT DISTINCT CASE WHEN a.area <= b.area THEN a.id ELSE b.id END AS id FROM k{rounds} a JOIN k{rounds} b ON {meet} WHERE {over} >= 0.2)")
    return ",\n".join(out)


@query(f"""WITH {SQL['a']}, s AS (SELECT id, minx, miny, maxx, maxy, (maxx - minx) * (maxy - miny) AS area FROM a), {_displacement_sql(6)}
SELECT id, round(minx, 4) AS minx, round(miny, 4) AS miny, moved FROM k6 WHERE id NOT IN (SELECT id FROM c)""")
def displaced_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes pushed apart until none overlaps."""
    made = Y.displaced_boxes(base_boxes(spark, sf_dir).select("id", *G.BOX), CELL)
    return made.select("id", F.round("minx", 4).alias("minx"), F.round("miny", 4).alias("miny"), "moved")


_LON, _LAT = "(c_custkey * 7919 % 3599) / 10.0D - 179.9D", "(c_custkey * 104729 % 1600) / 10.0D - 80.0D"


def _grid_sql(lon: str, lat: str, zone: str) -> tuple[str, str]:
    """Easting and northing as SQL, by the same series, without the southern grid's origin."""
    e = 2 * G._N**0.5 / (1 + G._N)
    t = f"sinh(atanh(sin(radians({lat}))) - {e!r} * atanh({e!r} * sin(radians({lat}))))"
    turn = f"radians({lon} - ({zone} * 6 - 183))"
    xi, eta = f"atan2({t}, cos({turn}))", f"atanh(sin({turn}) / sqrt(1 + {t} * {t}))"
    east = " + ".join([eta, *(f"{c!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, c in enumerate(G.TO_GRID, 1))])
    north = " + ".join([xi, *(f"{c!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, c in enumerate(G.TO_GRID, 1))])
    size = repr(G.SCALE * G.RECTIFYING)
    return f"500000 + {size} * ({east})", f"{size} * ({north})"


_E, _NORTH = _grid_sql("lon", "lat", "zone")


@query(f"""WITH p AS (SELECT c_custkey, {_LON.replace('D', '')} AS lon, {_LAT.replace('D', '')} AS lat FROM customer), z AS (SELECT *, greatest(1, least(60, floor((lon + 180) / 6)::INT + 1)) AS zone FROM p)
SELECT c_custkey, zone::INT AS zone, round({_E}, 3) AS east, round({_NORTH} + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END, 3) AS north, round(lon, 8) AS lon, round(lat, 8) AS lat FROM z""")
def projected_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places on the grids of their zones, and back."""
    p = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_LON} AS lon", f"{_LAT} AS lat")
    z = p.withColumn("zone", G.utm_zone(F.col("lon")))
    south = F.col("lat") < 0
    east, north = G.to_utm(F.col("lon"), F.col("lat"), F.col("zone"), south)
    placed = z.withColumns({"east": east, "north": north, "south": south})
    lon, lat = G.from_utm(F.col("east"), F.col("north"), F.col("zone"), F.col("south"))
    return placed.select("c_custkey", "zone", F.round("east", 3).alias("east"), F.round("north", 3).alias("north"), F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


_WEST, _SOUTH = "(s_suppkey * 53 % 300) / 100.0D + 27.0D", "(s_suppkey * 97 % 500) / 10.0D + 1.0D"


@query(f"""WITH b AS (SELECT s_suppkey, {_WEST.replace('D', '')} AS w, {_SOUTH.replace('D', '')} AS s, 35 AS zone FROM supplier), i AS (SELECT *, unnest(range(21)) AS i FROM b),
p AS (SELECT s_suppkey, zone, w + 1.5 * i / 20 AS lon, s AS lat FROM i UNION ALL SELECT s_suppkey, zone, w + 1.5 * i / 20, s + 2 FROM i UNION ALL SELECT s_suppkey, zone, w, s + 2.0 * i / 20 FROM i UNION ALL SELECT s_suppkey, zone, w + 1.5, s + 2.0 * i / 20 FROM i),
g AS (SELECT s_suppkey, {_E} AS x, {_NORTH} AS y FROM p)
SELECT s_suppkey, round(min(x), 3) AS minx, round(min(y), 3) AS miny, round(max(x), 3) AS maxx, round(max(y), 3) AS maxy FROM g GROUP BY 1""")
def projected_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in degrees as boxes on a zone's grid, by their edges."""
    b = spread(table(spark, sf_dir, "supplier").withColumn("id", F.col("s_suppkey"))).selectExpr("s_suppkey", f"{_WEST} AS w", f"{_SOUTH} AS s")
    project = lambda lon, lat: G.to_utm(lon, lat, F.lit(35), F.lit(False))
    made = G.box_to((F.col("w"), F.col("s"), F.col("w") + 1.5, F.col("s") + 2.0), project)
    return b.select("s_suppkey", *(F.round(c, 3).alias(n) for c, n in zip(made, G.BOX, strict=True)))


_DOCUMENT = """CASE WHEN event_id % 11 = 0 THEN '{"event_id": ' || event_id || ', "kind": ' WHEN event_id % 13 = 0 THEN '{"event_id": ' || event_id || '}'
  ELSE '{"event_id": ' || (event_id - event_id % 5 % 2) || ', "kind": "' || event_type || '", "copy": ' || event_id || '}' END"""


@query(f"""WITH d AS (SELECT event_id, event_type, {_DOCUMENT} AS document FROM events),
r AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN 'unreadable' WHEN event_id % 13 = 0 THEN 'without kind' END AS reason, event_id - event_id % 5 % 2 AS key FROM d),
t AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY document) AS turn FROM r WHERE reason IS NULL)
SELECT CASE WHEN turn = 1 THEN 'taken' ELSE 'repeated' END AS outcome, NULL AS reason, CAST(key AS BIGINT) AS event_id, md5(CASE WHEN turn = 1 THEN event_type ELSE document END) AS content FROM t
UNION ALL SELECT 'refused', reason, NULL, md5(document) FROM r WHERE reason IS NOT NULL
UNION ALL SELECT 'ledger', 'taken', count(*) FILTER (turn = 1), NULL FROM t UNION ALL SELECT 'ledger', 'repeated', count(*) FILTER (turn > 1), NULL FROM t UNION ALL SELECT 'ledger', 'refused', count(*), NULL FROM r WHERE reason IS NOT NULL""")
def quarantined_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of JSON documents, some of them broken or repeated: what is taken, refused with a reason, repeated, and the counts."""
    from geoweld.plans.tables import _stream

    documents = _stream(spark, sf_dir).selectExpr(f"{_DOCUMENT} AS value")
    got = E.intake(spark, documents, f"{shared_folder(spark)}/inbox-{uuid.uuid4().hex}", "event_id long, kind string, copy long", "event_id", ["kind"])
    rows = lambda name, outcome, reason, key, content: got[name].select(F.lit(outcome).alias("outcome"), reason.alias("reason"), key.alias("event_id"), content.alias("content"))
    none, key = F.lit(None).cast("string"), F.col("event_id")
    made = rows("taken", "taken", none, key, F.md5("kind")).union(rows("repeated", "repeated", none, key, F.md5("document")))
    made = made.union(rows("refused", "refused", F.col("reason"), F.lit(None).cast("long"), F.md5("document")))
    totals = got["ledger"].agg(*(F.sum(c).alias(c) for c in ("taken", "repeated", "refused")))
    counts = totals.select(F.explode(F.array(*(F.struct(F.lit(c).alias("reason"), F.col(c).alias("n")) for c in ("taken", "repeated", "refused")))).alias("c"))
    return made.union(counts.select(F.lit("ledger"), "c.reason", "c.n", none))


@query(f"WITH {SQL['a']}, w AS (SELECT id, maxx - minx + id % 7 AS w, maxy - miny - id % 3 AS h FROM a) SELECT id, CASE WHEN least(w, h) > 0 THEN round(greatest(w, h) / least(w, h), 6) END AS ratio FROM w")
def aspect_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long by short side of boxes."""
    made = base_boxes(spark, sf_dir).withColumns({"maxx": F.col("maxx") + F.col("id") % 7, "maxy": F.col("maxy") - F.col("id") % 3})
    return made.select("id", F.round(G.aspect_ratio(G.box()), 6).alias("ratio"))


_TILE, _OVERLAP = 100.0, 30.0
_TILE_ROWS = "tile_id string, id long, minx double, miny double, maxx double, maxy double, ref_id long, similarity double"


def _tile_job(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A job over tiles that is broken off after two batches and then goes on: its folder and tiles."""
    a, b = base_boxes(spark, sf_dir), other_boxes(spark, sf_dir)
    top = a.agg(F.max("maxy")).first()[0] or 0.0
    whole = (0.0, 0.0, 500.0, _TILE * math.ceil(top / _TILE))
    tiles = partition_bbox(spark, whole, _TILE, _OVERLAP)

    def build(some: DataFrame) -> DataFrame:
        ends = some.agg(*(f(f"buffered.{c}").alias(c) for f, c in zip((F.min, F.min, F.max, F.max), G.BOX, strict=True))).first()
        near = [x.where(G.boxes_meet(G.box(), tuple(F.lit(ends[c]) for c in G.BOX))) for x in (a, b)]
        # pairs are found once, not in each tile; two boxes that meet each other meet the same tile just where their common box does
        found = similar_boxes(*near, _TILE).where("similarity >= 0.3")
        common = (*(F.greatest(f"a_{c}", f"b_{c}") for c in ("minx", "miny")), *(F.least(f"a_{c}", f"b_{c}") for c in ("maxx", "maxy")))
        pairs = dealt_to_tiles(found, common, whole, _TILE, _OVERLAP).select("row", "col", F.col("a_id").alias("id"), *(F.col(f"a_{c}").alias(c) for c in G.BOX), F.col("b_id").alias("ref_id"), "similarity")
        dealt = pairs.hint(J.JOIN).join(some.select("row", "col", "tile_id"), ["row", "col"])
        return best_per(dealt, ["row", "col", "id"], F.col("similarity").desc(), F.col("ref_id")).select("tile_id", "id", *G.BOX, "ref_id", "similarity")

    folder = f"{shared_folder(spark)}/tiles-{uuid.uuid4().hex}"
    size = max(1, -(-tiles.count() // 4))
    J.run_tiles(tiles, build, folder, size, most_batches=2, order=["row", "col"])
    J.run_tiles(tiles, build, folder, size, order=["row", "col"])
    return folder, tiles


_TILES_SQL = f"""WITH {SQL['a']}, {SQL['b']}, {SQL['pairs']}, s AS (SELECT *, shared / least(area_a, area_b) AS sim FROM pairs WHERE shared / least(area_a, area_b) >= 0.3)"""


@query(f"{_TILES_SQL} SELECT a_id AS id, b_id AS ref_id, round(sim, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY sim DESC, b_id) = 1")
def resumed_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best matches by tiles, of a job that was broken off and went on, put together: as without tiles."""
    folder, tiles = _tile_job(spark, sf_dir)
    whole = J.stitched(J.tile_rows(spark, folder, _TILE_ROWS), tiles, "id")
    return whole.select("id", "ref_id", F.round("similarity", 6).alias("similarity"))


@query(f"""{_TILES_SQL}, t AS (SELECT i, j, greatest(i * 100.0 - 30, 0) AS minx, greatest(j * 100.0 - 30, 0) AS miny, least(i * 100.0 + 130, 500) AS maxx, least(j * 100.0 + 130, top) AS maxy
  FROM range(5) x(i), (SELECT ceil(max(maxy) / 100) * 100 AS top FROM a), range((SELECT ceil(max(maxy) / 100)::BIGINT FROM a)) y(j)),
w AS (SELECT DISTINCT i, j, a_id FROM s JOIN a ON a.id = a_id JOIN b ON b.id = b_id JOIN t ON a.minx <= t.maxx AND t.minx <= a.maxx AND a.miny <= t.maxy AND t.miny <= a.maxy AND b.minx <= t.maxx AND t.minx <= b.maxx AND b.miny <= t.maxy AND t.miny <= b.maxy)
SELECT (SELECT count(*) FROM t) AS tiles, (SELECT least(4, ceil(count(*) / ceil(count(*) / 4.0))) FROM t)::BIGINT AS batches, (SELECT count(*) FROM w) AS rows_in_manifest, (SELECT count(*) FROM w) AS rows_written, (SELECT count(DISTINCT a_id) FROM s) AS rows_stitched""")
def tile_job_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a job over tiles has done, counted from its manifests and from its rows."""
    folder, tiles = _tile_job(spark, sf_dir)
    rows = J.tile_rows(spark, folder, _TILE_ROWS)
    return J.evidence(spark, folder, rows, J.stitched(rows, tiles, "id"))


# a raster of _SIDE x _SIDE pixels for each square of twice that side that orders lie in; a pixel's value goes by its place, and some hold none
_SIDE = 50
# rows of rasters in a file, of five rasters each
_ROWS = 32
_PIXEL = "(o_orderkey * 37 + floor(o_orderkey / 7)) % 9 + 1"


def _pixel_rows() -> list[str]:
    x, y = _at("o_orderkey", 7919, 104729, 401)
    return [f"CAST(floor({x} / 2) AS INT) AS px", f"CAST(floor({y} / 2) AS INT) AS py", f"CAST({_PIXEL} AS DOUBLE) AS value"]


_PIXELS_SQL = f"px AS (SELECT px, py, max(value) AS value FROM (SELECT {', '.join(_pixel_rows())} FROM orders) GROUP BY 1, 2)"


@query(f"""WITH {SQL['a']}, {_PIXELS_SQL}, {_pieces('ap', 'a')},
h AS (SELECT ap.id, px.value, count(*) AS n FROM ap JOIN px ON 2 * px + 1 >= minx AND 2 * px + 1 < maxx AND 2 * py + 1 >= miny AND 2 * py + 1 < maxy GROUP BY 1, 2),
t AS (SELECT id, sum(n)::BIGINT AS n, min(value) AS low, max(value) AS high, round(sum(value * n) / sum(n), 6) AS mean, max_by(value, (n, value)) AS dominant FROM h GROUP BY 1)
SELECT a.id, coalesce(n, 0)::BIGINT AS n, low, high, mean, dominant FROM a LEFT JOIN t USING (id)""")
def raster_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters written from a table and read again by blocks: count, least, greatest, mean and dominant value within each shape."""
    pixels = table(spark, sf_dir, "orders").selectExpr(*_pixel_rows()).groupBy("px", "py").agg(F.max("value").alias("value"))
    corner = [F.floor(F.col(p) / _SIDE).alias(c) for p, c in (("px", "rx"), ("py", "ry"))]
    placed = pixels.select("px", "py", "value", *corner).select(
        F.concat_ws("-", "rx", "ry").alias("raster"), (F.col("px") - F.col("rx") * _SIDE).cast("int").alias("col"), (_SIDE - 1 - (F.col("py") - F.col("ry") * _SIDE)).cast("int").alias("row"), "value",
        (F.col("rx") * 2.0 * _SIDE).alias("left"), ((F.col("ry") + 1) * 2.0 * _SIDE).alias("top"),
        F.floor(F.col("ry") / _ROWS).alias("strip"),
    )
    folder = f"{shared_folder(spark)}/rasters-{uuid.uuid4().hex}"
    write_rasters(placed, folder, "left", "top", _SIDE, 2.0, "i2", 0, 32, "strip").count()
    return zonal_statistics(shaped(base_boxes(spark, sf_dir)), read_blocks(spark, folder), 64.0).select("id", "n", "low", "high", F.round("mean", 6).alias("mean"), "dominant")


@query(f"""WITH {SQL['a']}, {_pieces('ap', 'a')} SELECT a.id, CASE WHEN a.id % 3 = 0 THEN 1 ELSE 2 END AS n_rings, round(area, 6) AS area, round(a.height, 2) AS height
FROM a JOIN ap_area USING (id) WHERE minx <= 300 AND 100 <= maxx AND miny <= 700 AND 50 <= maxy""")
def bundled_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer written as archives of shapefiles, whose names of fields are cut, and read again within a window."""
    a = base_boxes(spark, sf_dir)
    layer = shaped(a).join(a.select(F.col("id"), F.col("height").cast("double").alias("height_of_building")), "id")
    folder = f"{shared_folder(spark)}/bundles-{uuid.uuid4().hex}"
    write_bundles(layer, folder, "polygon", 400).count()
    got = read_bundles(spark, folder, (100.0, 50.0, 300.0, 700.0))
    return got.select(
        F.col("attributes")["id"].cast("long").alias("id"), F.size("parts").alias("n_rings"), F.round(shapes_area("parts"), 6).alias("area"), F.round(F.col("attributes")["height_of_"].cast("double"), 2).alias("height"),
    )


@query("SELECT s_suppkey, s_name, coalesce(s_nationkey, -1) AS s_nationkey, round(s_acctbal, 1) AS s_acctbal FROM (SELECT s_suppkey, s_name, CASE WHEN s_nationkey % 4 = 0 THEN NULL ELSE s_nationkey END AS s_nationkey, s_acctbal FROM supplier)")
def projected_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table without some of its columns, others rounded or filled."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_nationkey") % 4 != 0, F.col("s_nationkey")).alias("s_nationkey"), "s_acctbal", F.lit("x").alias("extra"))
    return R.projected(s, ["EXTRA", "not there"], {"s_acctbal": 1}, {"s_nationkey": -1})
