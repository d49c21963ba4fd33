"""Queries of line, shape and layer kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweld.functions import geometry as G
from geoweld.functions import polygons as P
from geoweld.operators import line_cleanup as L
from geoweld.operators import lines
from geoweld.operators import matching as M
from geoweld.operators import poi
from geoweld.operators.grid_join import corner_join, grid_join
from geoweld.operators.tiling import tiles_for
from geoweld.plans.derived import CELL, SQL, base_boxes, base_points, base_segments, on_globe, other_boxes, other_points, other_segments
from geoweld.plans.more import _covered, _near, _point_to, _sampled
from geoweld.plans.registry import query, table
from geoweld.plans.spatial import _LINES
from geoweld.streaming import events as E


@query(f"""WITH {SQL['sa']}, {SQL['sb']}, {_covered('c10', 12.0, 22.0)}, {_covered('c1', 1.0, 22.0)}, {_sampled('d', 19.0, 22.0, step=30.0)}, u AS (SELECT id, sum(greatest(0, hi - greatest(lo, coalesce(upto, -1)))) AS covered FROM c10_o GROUP BY id),
t AS (SELECT DISTINCT id FROM c1 WHERE hi > lo) SELECT u.id FROM u JOIN t USING (id) JOIN d USING (id) WHERE covered >= 0.82 AND mean <= 6 AND p90 <= 10 AND far <= 18""")
def crossing_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplements that touch a base line of like direction and run along it."""
    return L.crossing_duplicates(other_segments(spark, sf_dir), base_segments(spark, sf_dir), CELL)


def _union_of(name: str, made: str) -> str:
    return f"{name} AS (SELECT id, sum(greatest(0, hi - greatest(lo, coalesce(upto, -1)))) AS covered FROM {made}_o GROUP BY id)"


def _ends(name: str, of: str, r: float, tie: str = "") -> str:
    """CTE of each end of `of` with its nearest points of the base within r."""
    return f"""{name}_f AS (SELECT id, 1 AS k, x1 AS x, y1 AS y FROM {of} UNION ALL SELECT id, 2, x2, y2 FROM {of}),
{name}_g AS (SELECT f.id, f.k, f.x, f.y, b.id AS b_id, b.x1, b.y1, b.x2, b.y2, {_point_to('b')} AS t FROM {name}_f f JOIN {tie or 'sa'} b ON {'f.id <> b.id AND ' if tie else ''}x - {r} <= greatest(b.x1, b.x2) AND least(b.x1, b.x2) <= x + {r} AND y - {r} <= greatest(b.y1, b.y2) AND least(b.y1, b.y2) <= y + {r}),
{name} AS (SELECT *, x1 + t * (x2 - x1) AS px, y1 + t * (y2 - y1) AS py, sqrt((x1 + t * (x2 - x1) - x) ** 2 + (y1 + t * (y2 - y1) - y) ** 2) AS d FROM {name}_g WHERE sqrt((x1 + t * (x2 - x1) - x) ** 2 + (y1 + t * (y2 - y1) - y) ** 2) <= {r})"""


@query(f"""{_LINES}, best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY haus, angle, b_id) = 1), mb AS (SELECT sb.* FROM sb WHERE id IN (SELECT b_id FROM best)), {_covered('r3', 3.0, of='mb')},
gap AS (SELECT id, coalesce(upto, 0) AS lo, lo AS hi FROM r3_o WHERE lo > coalesce(upto, 0) UNION ALL SELECT mb.id, coalesce(max(r3.hi), 0), 1 FROM mb LEFT JOIN r3 USING (id) GROUP BY mb.id HAVING coalesce(max(r3.hi), 0) < 1),
pt AS (SELECT id * 100 + row_number() OVER (PARTITION BY id ORDER BY lo) AS id, x1 + lo * (x2 - x1) AS x1, y1 + lo * (y2 - y1) AS y1, x1 + hi * (x2 - x1) AS x2, y1 + hi * (y2 - y1) AS y2 FROM gap JOIN mb USING (id) WHERE (hi - lo) * sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) >= 5
  UNION ALL SELECT id * 100, x1, y1, x2, y2 FROM sb WHERE id NOT IN (SELECT b_id FROM best)),
{_covered('c8', 8.0, 25.0, 'pt')}, {_covered('c6', 6.0, 18.0, 'pt')}, {_covered('c12', 12.0, of='pt')}, {_covered('c22', 12.0, 22.0, 'pt')}, {_covered('c1', 1.0, 22.0, 'pt')}, {_sampled('d12', 12.0, of='pt')}, {_sampled('d32', 32.0, of='pt')}, {_sampled('d19', 19.0, 22.0, 'pt', 30.0)},
{_union_of('u6', 'c6')}, {_union_of('u12', 'c12')}, {_union_of('u22', 'c22')}, {_ends('h12', 'pt', 12.0)}, hh AS (SELECT id FROM h12 GROUP BY id HAVING count(DISTINCT k) = 2),
gone AS (SELECT id FROM c8 WHERE hi - lo >= 0.92 AND (own <= 1.5 * long OR hi - lo >= 0.98) UNION SELECT u6.id FROM u6 JOIN d12 USING (id) WHERE covered >= 0.9 AND mean <= 4 AND p90 <= 7
  UNION SELECT u12.id FROM u12 JOIN hh USING (id) JOIN d32 USING (id) WHERE covered >= 0.85 AND mean <= 6 AND p90 <= 10 AND far <= 16
  UNION SELECT u22.id FROM u22 JOIN d19 USING (id) WHERE covered >= 0.82 AND mean <= 6 AND p90 <= 10 AND far <= 18 AND u22.id IN (SELECT id FROM c1 WHERE hi > lo)),
kept AS (SELECT * FROM pt WHERE id NOT IN (SELECT id FROM gone)), net AS (SELECT * FROM kept UNION ALL SELECT -1 - id, x1, y1, x2, y2 FROM sa), {_ends('tie', 'kept', 1.0, 'net')}, tied AS (SELECT id, count(DISTINCT k) AS n FROM tie GROUP BY id),
fast AS (SELECT kept.* FROM kept LEFT JOIN tied USING (id) WHERE NOT ((coalesce(n, 0) = 0 AND sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) <= 30) OR (coalesce(n, 0) = 1 AND sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) <= 12))),
{_ends('sn', 'fast', 10.0)}, one AS (SELECT id, k, px, py FROM sn QUALIFY row_number() OVER (PARTITION BY id, k ORDER BY d, b_id) = 1),
mv AS (SELECT f.*, coalesce(p.px, x1) AS u1, coalesce(p.py, y1) AS v1, coalesce(q.px, x2) AS u2, coalesce(q.py, y2) AS v2 FROM fast f LEFT JOIN one p ON f.id = p.id AND p.k = 1 LEFT JOIN one q ON f.id = q.id AND q.k = 2),
ok AS (SELECT *, sqrt((u2 - u1) ** 2 + (v2 - v1) ** 2) >= 1 AND coalesce(degrees(acos(greatest(-1, least(1, ((x2 - x1) * (u2 - u1) + (y2 - y1) * (v2 - v1)) / nullif(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) * sqrt((u2 - u1) ** 2 + (v2 - v1) ** 2), 0))))), 0) <= 35 AS fine FROM mv)
SELECT id AS "of", 0 AS part, 'base' AS role, x1, y1, x2, y2 FROM sa
UNION ALL SELECT id // 100, (id % 100)::INT, CASE WHEN id % 100 = 0 THEN 'supplement' ELSE 'residual' END, round(CASE WHEN fine THEN u1 ELSE x1 END, 4), round(CASE WHEN fine THEN v1 ELSE y1 END, 4), round(CASE WHEN fine THEN u2 ELSE x2 END, 4), round(CASE WHEN fine THEN v2 ELSE y2 END, 4) FROM ok""")
def conflated_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Road conflation from match to snap: the base network and what supplements add to it."""
    made = L.conflated(base_segments(spark, sf_dir), other_segments(spark, sf_dir), CELL)
    return made.select("of", "part", "role", *(F.round(c, 4).alias(c) for c in lines.ENDS))


@query(f"""WITH {SQL['sa']}, {SQL['b']}, i AS (SELECT s.id, greatest(CASE WHEN s.x1 = s.x2 THEN 0 ELSE least((b.minx - s.x1) / (s.x2 - s.x1), (b.maxx - s.x1) / (s.x2 - s.x1)) END, CASE WHEN s.y1 = s.y2 THEN 0 ELSE least((b.miny - s.y1) / (s.y2 - s.y1), (b.maxy - s.y1) / (s.y2 - s.y1)) END, 0) AS lo,
    least(CASE WHEN s.x1 = s.x2 THEN 1 ELSE greatest((b.minx - s.x1) / (s.x2 - s.x1), (b.maxx - s.x1) / (s.x2 - s.x1)) END, CASE WHEN s.y1 = s.y2 THEN 1 ELSE greatest((b.miny - s.y1) / (s.y2 - s.y1), (b.maxy - s.y1) / (s.y2 - s.y1)) END, 1) AS hi
  FROM sa s JOIN b ON least(s.x1, s.x2) <= b.maxx AND b.minx <= greatest(s.x1, s.x2) AND least(s.y1, s.y2) <= b.maxy AND b.miny <= greatest(s.y1, s.y2)),
o AS (SELECT *, max(hi) OVER (PARTITION BY id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM i WHERE lo < hi),
gap AS (SELECT id, coalesce(upto, 0) AS lo, lo AS hi FROM o WHERE lo > coalesce(upto, 0) UNION ALL SELECT sa.id, coalesce(max(o.hi), 0), 1 FROM sa LEFT JOIN o USING (id) GROUP BY sa.id HAVING coalesce(max(o.hi), 0) < 1)
SELECT id, count(*) AS parts, round(sum((hi - lo) * sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)), 4) AS len FROM gap JOIN sa USING (id) WHERE (hi - lo) * sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) >= 1 GROUP BY id""")
def erased_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the lines lies outside the boxes, in parts of 1 or more."""
    rest = lines.erased_by_boxes(base_segments(spark, sf_dir), other_boxes(spark, sf_dir), CELL, 1.0)
    return rest.groupBy("id").agg(F.count(F.lit(1)).alias("parts"), F.round(F.sum(lines.length(lines.segment())), 4).alias("len"))


@query(f"""WITH {SQL['sa']}, n AS (SELECT *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS long FROM sa), k AS (SELECT *, unnest(range(1, greatest(ceil(long / 7), 1)::INT + 1))::INT AS part FROM n),
c AS (SELECT *, (part - 1) * 7 AS lo, least(part * 7, long) AS hi FROM k)
SELECT id, part, round(x1 + (x2 - x1) * lo / long, 6) + 0.0 AS x1, round(y1 + (y2 - y1) * lo / long, 6) + 0.0 AS y1, round(x1 + (x2 - x1) * hi / long, 6) + 0.0 AS x2, round(y1 + (y2 - y1) * hi / long, 6) + 0.0 AS y2 FROM c WHERE hi - lo > 1""")
def lines_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in full lengths of 7 and a rest."""
    return lines.split_by_length(base_segments(spark, sf_dir), 7.0, 1.0).select("id", "part", *((F.round(c, 6) + 0.0).alias(c) for c in lines.ENDS))


_ROUTES = """o AS (SELECT l_orderkey AS id, l_partkey::DOUBLE AS x, l_suppkey::DOUBLE AS y, row_number() OVER w AS i, lag(l_partkey) OVER w AS px, lag(l_suppkey) OVER w AS py, lead(l_partkey) OVER w AS nx, lead(l_suppkey) OVER w AS ny, count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))"""


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polylines through the lines of each order."""
    at = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    grouped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(at)).alias("p"))
    return grouped.select("id", F.transform("p", lambda q: F.struct(q["l_partkey"].cast("double").alias("x"), q["l_suppkey"].cast("double").alias("y"))).alias("points"))


@query(f"""WITH {_ROUTES}, v AS (SELECT *, (px - x) * (nx - x) + (py - y) * (ny - y) AS dot, sqrt((px - x) ** 2 + (py - y) ** 2) * sqrt((nx - x) ** 2 + (ny - y) ** 2) AS len FROM o WHERE n > 1),
c AS (SELECT id, i, n, coalesce(px IS NOT NULL AND nx IS NOT NULL AND len > 0 AND degrees(acos(greatest(-1, least(1, dot / len)))) < 135, FALSE) AS cut FROM v),
s AS (SELECT *, sum(cut::INT) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
p AS (SELECT s.id, part, s.i FROM (SELECT id, i, coalesce(before, 0) AS part FROM s UNION ALL SELECT id, i, coalesce(before, 0) + 1 FROM s WHERE cut) s),
d AS (SELECT p.*, sqrt((o.x - lag(o.x) OVER w) ** 2 + (o.y - lag(o.y) OVER w) ** 2) AS step FROM p JOIN o ON o.id = p.id AND o.i = p.i WINDOW w AS (PARTITION BY p.id, part ORDER BY p.i))
SELECT id, part::INT AS part, count(*)::INT AS n_points FROM d GROUP BY 1, 2 HAVING sum(step) > 25""")
def sharp_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polylines cut where they turn sharply."""
    return lines.split_at_sharp_turns(_routes(spark, sf_dir), least=25.0).select("id", "part", F.size("points").alias("n_points"))


@query(f"""WITH {SQL['sa']}, p AS (SELECT a.id, (a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1) AS w, (b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1) AS tn, (b.x1 - a.x1) * (a.y2 - a.y1) - (b.y1 - a.y1) * (a.x2 - a.x1) AS un
  FROM sa a JOIN sa b ON a.id <> b.id AND {_near('a', 'b', 0)}),
c AS (SELECT DISTINCT id, round(tn / w, 6) AS t FROM p WHERE w <> 0 AND round(tn / w, 6) > 0 AND round(tn / w, 6) < 1 AND round(un / w, 6) BETWEEN 0 AND 1),
e AS (SELECT id, t FROM c UNION ALL SELECT id, 0 FROM sa UNION ALL SELECT id, 1 FROM sa), s AS (SELECT id, t AS lo, lead(t) OVER (PARTITION BY id ORDER BY t) AS hi, row_number() OVER (PARTITION BY id ORDER BY t) - 1 AS part FROM e)
SELECT id, part::INT AS part, round(x1 + (x2 - x1) * lo, 4) AS x1, round(y1 + (y2 - y1) * lo, 4) AS y1, round(x1 + (x2 - x1) * hi, 4) AS x2, round(y1 + (y2 - y1) * hi, 4) AS y2 FROM s JOIN sa USING (id) WHERE hi IS NOT NULL""")
def planarized_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut where they cross."""
    return lines.planarized(base_segments(spark, sf_dir), CELL).select("id", "part", *(F.round(c, 4).alias(c) for c in lines.ENDS))


@query("""WITH k AS (SELECT p_partkey, p_partkey % 4 AS a, (p_partkey // 4) % 4 AS b, (p_partkey // 16) % 4 AS c FROM part), t AS (SELECT p_partkey, (a & 1) * 4 + (b & 1) * 2 + (c & 1) AS x, (a >> 1) * 4 + (b >> 1) * 2 + (c >> 1) AS y FROM k)
SELECT p_partkey, x::INT AS x, y::INT AS y, round(x / 8 * 360 - 180, 6) AS west, round(degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 8)))), 6) AS south, round((x + 1) / 8 * 360 - 180, 6) AS east, round(degrees(atan(sinh(pi() * (1 - 2 * y / 8)))), 6) AS north FROM t""")
def quadkey_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of quadkeys and their bounds."""
    k = F.col("p_partkey")
    digit = lambda n: (F.floor(k / n) % 4).cast("string")
    x, y = G.quadkey_tile(F.concat(digit(1), digit(4), digit(16)))
    made = table(spark, sf_dir, "part").select("p_partkey", x.alias("x"), y.alias("y"))
    bounds = zip(("west", "south", "east", "north"), G.tile_bounds(F.col("x"), F.col("y"), F.lit(3)), strict=True)
    return made.select("p_partkey", "x", "y", *(F.round(b, 6).alias(n) for n, b in bounds))


@query(f"""WITH {SQL['a']}, {SQL['b']}, {SQL['pairs']}, d AS (SELECT p.*, sqrt(((a.minx + a.maxx - b.minx - b.maxx) / 2) ** 2 + ((a.miny + a.maxy - b.miny - b.maxy) / 2) ** 2) AS d FROM pairs p JOIN a ON a.id = a_id JOIN b ON b.id = b_id WHERE shared > 0)
SELECT a_id, b_id, round(1 - d / 70, 6) AS location, round(least(area_a, area_b) / greatest(area_a, area_b), 6) AS area, round(shared / greatest(area_a, area_b), 6) AS overlap, 0.0::DOUBLE AS orientation, 1.0::DOUBLE AS shape FROM d""")
def shape_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of squares that share area: place, area, overlap, direction and shape."""
    pairs = M.similar_boxes(base_boxes(spark, sf_dir), other_boxes(spark, sf_dir), CELL).where("shared > 0")
    side = lambda s: F.col(f"{s}_maxx") - F.col(f"{s}_minx")
    middle = lambda s: [(F.col(f"{s}_min{c}") + F.col(f"{s}_max{c}")) / 2 for c in "xy"]
    shape = lambda s: (side(s) * side(s), side(s), side(s), F.lit(0.0))
    made = P.shape_similarity(shape("a"), shape("b"), G.distance(*middle("a"), *middle("b")), F.col("shared"))
    return pairs.select("a_id", "b_id", *(F.round(c, 6).alias(n) for n, c in made.items()))


@query(f"""WITH {SQL['sa']} SELECT CASE WHEN x1 > x2 OR x1 = x2 AND y1 > y2 THEN x2 ELSE x1 END AS x1, CASE WHEN x1 > x2 OR x1 = x2 AND y1 > y2 THEN y2 ELSE y1 END AS y1, CASE WHEN x1 > x2 OR x1 = x2 AND y1 > y2 THEN x1 ELSE x2 END AS x2, CASE WHEN x1 > x2 OR x1 = x2 AND y1 > y2 THEN y1 ELSE y2 END AS y2, count(*) AS n FROM sa GROUP BY 1, 2, 3, 4""")
def directed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line once, whichever way it is drawn."""
    return lines.directed(base_segments(spark, sf_dir)).groupBy(*lines.ENDS).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SQL['a']}, r AS (SELECT id, 0 AS place, minx AS x1, miny AS y1, maxx AS x2, miny AS y2 FROM a UNION ALL SELECT id, 1, maxx, miny, maxx, maxy FROM a UNION ALL SELECT id, 2, maxx, maxy, minx, miny FROM a) SELECT id, 0 AS part, place, x1, y1, x2, y2 FROM r""")
def ring_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of polygons as lines."""
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(point("minx", "miny"), point("maxx", "miny"), point("maxx", "maxy"), point("minx", "miny"))
    return lines.ring_segments(base_boxes(spark, sf_dir).select("id", F.array(ring).alias("parts")))


@query(f"""WITH RECURSIVE {SQL['sa']}, e AS (SELECT DISTINCT x1 AS x, y1 AS y FROM sa UNION SELECT x2, y2 FROM sa),
l AS (SELECT p.x, p.y, q.x AS u, q.y AS v FROM e p JOIN e q ON abs(p.x - q.x) <= 2 AND abs(p.y - q.y) <= 2 WHERE (p.x - q.x) ** 2 + (p.y - q.y) ** 2 <= 4),
w AS (SELECT x, y, x AS u, y AS v FROM e UNION SELECT w.x, w.y, l.u, l.v FROM w JOIN l ON w.u = l.x AND w.v = l.y),
t AS (SELECT x, y, min((u, v)) AS m FROM w GROUP BY x, y)
SELECT id, p.m[1] AS x1, p.m[2] AS y1, q.m[1] AS x2, q.m[2] AS y2 FROM sa JOIN t p ON x1 = p.x AND y1 = p.y JOIN t q ON x2 = q.x AND y2 = q.y""")
def joined_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of lines that nearly meet, put together."""
    return lines.joined_ends(base_segments(spark, sf_dir), CELL, 2.0)


def _far(p: str, q: str) -> str:
    """How far the vertices of segment p lie from segment q at most, of the pairs' columns."""
    one = lambda k: (
        f"(SELECT sqrt(({p}x{k} - {q}x1 - t * ({q}x2 - {q}x1)) ** 2 + ({p}y{k} - {q}y1 - t * ({q}y2 - {q}y1)) ** 2) FROM (SELECT CASE WHEN {q}x1 = {q}x2 AND {q}y1 = {q}y2 THEN 0 "
        f"ELSE greatest(0, least(1, (({p}x{k} - {q}x1) * ({q}x2 - {q}x1) + ({p}y{k} - {q}y1) * ({q}y2 - {q}y1)) / (({q}x2 - {q}x1) ** 2 + ({q}y2 - {q}y1) ** 2))) END AS t))"
    )
    return f"greatest({one(1)}, {one(2)})"


@query(f"{_LINES}, f AS (SELECT a_id, b_id, greatest({_far('a', 'b')}, {_far('b', 'a')}) AS d FROM p) SELECT a_id, b_id, round(d, 6) AS hausdorff FROM f WHERE d <= 10")
def segment_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of two layers within 10 of each other by the Hausdorff distance from vertices to lines."""
    near = corner_join(lines.boxed(base_segments(spark, sf_dir)), lines.boxed(other_segments(spark, sf_dir)), CELL, 10.0 + lines.SLACK)
    d = G.segment_hausdorff(lines.segment("a_"), lines.segment("b_"))
    return near.withColumn("d", d).where("d <= 10").select("a_id", "b_id", F.round("d", 6).alias("hausdorff"))


@query(f"""WITH {SQL['a']} SELECT id, round((maxx - minx) * sqrt(2), 6) AS long_side, round((maxx - minx) * sqrt(2), 6) AS short_side, round(2 * (maxx - minx) ** 2, 6) AS area, minx AS cx, miny AS cy, 1.0::DOUBLE AS aspect FROM a""")
def shape_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of squares that stand on a corner."""
    half, x, y = F.col("maxx") - F.col("minx"), F.col("minx"), F.col("miny")
    corner = lambda dx, dy: F.struct((x + dx * half).alias("x"), (y + dy * half).alias("y"))
    ring = F.array(corner(1, 0), corner(0, 1), corner(-1, 0), corner(0, -1))
    made = base_boxes(spark, sf_dir).select("id", ring.alias("ring")).withColumn("r", P.oriented_rectangle("ring"))
    c = P.ring_centroid(F.col("ring"))
    aspect = F.round(F.col("r.long_side") / F.col("r.short_side"), 6)
    return made.select("id", F.round("r.long_side", 6).alias("long_side"), F.round("r.short_side", 6).alias("short_side"), F.round(P.ring_area(F.col("ring")), 6).alias("area"), F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"), aspect.alias("aspect"))


@query(f"""WITH {SQL['a']}, {SQL['b']}, {SQL['pairs']}, s AS (SELECT id, minx + 6 AS minx, miny + 6 AS miny, maxx + 6 AS maxx, maxy + 6 AS maxy FROM a),
u AS (SELECT id, 'first' AS source, minx, miny, maxx, maxy FROM a UNION ALL SELECT id, 'second', minx, miny, maxx, maxy FROM b WHERE id NOT IN (SELECT b_id FROM pairs WHERE shared / least(area_a, area_b) >= 0.3))
SELECT source, id FROM u
UNION ALL SELECT 'third', id FROM s WHERE NOT EXISTS (SELECT 1 FROM u WHERE s.minx <= u.maxx AND u.minx <= s.maxx AND s.miny <= u.maxy AND u.miny <= s.maxy
  AND (least(s.maxx, u.maxx) - greatest(s.minx, u.minx)) * (least(s.maxy, u.maxy) - greatest(s.miny, u.miny)) >= 0.3 * least((s.maxx - s.minx) * (s.maxy - s.miny), (u.maxx - u.minx) * (u.maxy - u.miny)))""")
def priority_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three layers by priority: each adds what none before it has."""
    a = base_boxes(spark, sf_dir)
    third = a.withColumns({c: F.col(c) + 6 for c in ("minx", "miny", "maxx", "maxy")})
    fused = M.priority_cascade([("first", a), ("second", other_boxes(spark, sf_dir)), ("third", third)], CELL, 0.3)
    return fused.select("source", "id")


@query(f"""WITH {SQL['pa']}, {SQL['pb']} SELECT pa.id AS a_id, pb.id AS b_id, round(1 - sqrt((pa.x - pb.x) ** 2 + (pa.y - pb.y) ** 2) / 25, 6) AS score FROM pa JOIN pb ON abs(pa.x - pb.x) <= 25 AND abs(pa.y - pb.y) <= 25 WHERE (pa.x - pb.x) ** 2 + (pa.y - pb.y) ** 2 <= 625
QUALIFY row_number() OVER (PARTITION BY pa.id ORDER BY round(1 - sqrt((pa.x - pb.x) ** 2 + (pa.y - pb.y) ** 2) / 25, 6) DESC, pb.id) = 1""")
def poi_match_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By geohash and name, or, as no name is alike here, by distance."""
    from geoweld.operators.grid_join import points

    a, b = base_points(spark, sf_dir), other_points(spark, sf_dir)
    by_hash = poi.geohash_candidates(on_globe(a), on_globe(b), 6, 0.75)
    d = G.distance(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y"))
    by_distance = grid_join(points(a), points(b), 25.0, 25.0).where(d <= 25).select("a_id", "b_id", F.round(1 - d / 25, 6).alias("score"))
    return poi.matched_with_fallback(by_hash, by_distance)


@query("""WITH n AS (SELECT s_nationkey, count(*) * 40000 AS features, (s_nationkey + 1) * 9000.0 AS km2 FROM supplier GROUP BY 1)
SELECT s_nationkey, CASE WHEN features <= 300000 AND km2 <= 50000 THEN 1 ELSE greatest(1, least(64, ceil(km2 * 1e6 / (20000.0 * 20000.0)))) END::INT AS tiles FROM n""")
def tile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg((F.count(F.lit(1)) * 40000).alias("features"))
    return n.select("s_nationkey", tiles_for(F.col("features"), (F.col("s_nationkey") + 1) * 9000.0, 20000.0).alias("tiles"))


@query("SELECT user_id, count(*) AS n, max(ts) AS last FROM events GROUP BY 1")
def superseded_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that later batches of a stream replace."""
    from geoweld.plans.tables import _stream

    plan = lambda s: s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    return E.run_available(spark, _stream(spark, sf_dir), plan, "update", ["user_id"])


@query("SELECT user_id AS run_id, max(ts) AS last_seen FROM events GROUP BY 1 HAVING max(ts) + INTERVAL 4 HOUR < (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 1 HOUR")
def timed_out_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs without a sign of life for four hours, told by timers of a stream."""
    from geoweld.plans.tables import _stream

    runs = _stream(spark, sf_dir).select(F.col("user_id").alias("run_id"), F.col("ts").alias("at"))
    return E.run_available(spark, runs, lambda s: E.timed_out(s, "run_id", "at", 4 * 3600, "1 hour"), "append")
