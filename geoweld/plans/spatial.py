"""Spatial joins and fused layers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweld.functions import geometry as G
from geoweld.functions.text import name_score
from geoweld.operators import matching as M
from geoweld.operators.components import checkpointed
from geoweld.operators.grid_join import best_per, grid_join, nearest_within, points
from geoweld.plans.derived import CELL, SQL, base_boxes, base_points, base_segments, on_globe, other_boxes, other_points, other_segments
from geoweld.operators.relational import exact_quantile
from geoweld.plans.registry import query

_PAIRS = f"WITH {SQL['a']}, {SQL['b']}, {SQL['pairs']}"


@query(f"{_PAIRS} SELECT a_id, b_id, round(shared, 6) AS shared, round(shared / least(area_a, area_b), 6) AS similarity FROM pairs")
def building_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = M.similar_boxes(base_boxes(spark, sf_dir), other_boxes(spark, sf_dir), CELL)
    return pairs.select("a_id", "b_id", F.round("shared", 6).alias("shared"), F.round("similarity", 6).alias("similarity"))


_FUSED = f"""{_PAIRS},
s AS (SELECT *, shared / least(area_a, area_b) AS sim FROM pairs WHERE shared / least(area_a, area_b) >= 0.3),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY sim DESC, b_id) = 1),
m AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY b_id ORDER BY sim DESC, a_id) = 1)"""


@query(f"""{_FUSED}
SELECT a_id AS id, b_id AS ref_id, 'matched' AS src FROM m
UNION ALL SELECT id, NULL, 'base' FROM a WHERE id NOT IN (SELECT a_id FROM m)
UNION ALL SELECT NULL, id, 'other' FROM b WHERE id NOT IN (SELECT b_id FROM m)""")
def building_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which boxes of one source double the other's, and the merged layer."""
    a, b = base_boxes(spark, sf_dir), other_boxes(spark, sf_dir)
    return M.merged_layer(a, b, checkpointed(M.two_pass_matches(M.similar_boxes(a, b, CELL), 0.3).select("a_id", "b_id")))


@query(f"{_PAIRS} SELECT a_id, b_id, round(shared / area_a, 6) AS ratio FROM pairs WHERE shared / area_a >= 0.1 AND shared >= 1")
def water_overlap_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = M.similar_boxes(base_boxes(spark, sf_dir), other_boxes(spark, sf_dir), CELL, "base")
    return pairs.where("similarity >= 0.1 AND shared >= 1").select("a_id", "b_id", F.round("similarity", 6).alias("ratio"))


@query(f"""{_PAIRS}, s AS (SELECT *, shared / area_a AS ratio FROM pairs WHERE shared / area_a >= 0.1),
m AS (SELECT a_id, min_by(b_id, (-ratio, b_id)) AS ref, max(ratio) AS ratio, count(*) AS n FROM s GROUP BY a_id)
SELECT a.id AS osm_id, coalesce(ref, 0) AS ref_id, round(coalesce(ratio, 0), 6) AS ov_ratio, coalesce(n, 0)::BIGINT AS match_cnt, 'OSM' AS src FROM a LEFT JOIN m ON a.id = m.a_id
UNION ALL SELECT 0, id, 0, 0, 'REF' FROM b WHERE id NOT IN (SELECT b_id FROM s)""")
def water_fusion_best_and_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best reference by overlap and how many there are; every reference that overlaps enough is used up."""
    a, b = base_boxes(spark, sf_dir), other_boxes(spark, sf_dir)
    s = checkpointed(M.similar_boxes(a, b, CELL, "base").where("similarity >= 0.1").select("a_id", "b_id", "similarity"))
    best = s.groupBy("a_id").agg(F.min_by("b_id", F.struct(-F.col("similarity"), "b_id")).alias("ref"), F.max("similarity").alias("ratio"), F.count(F.lit(1)).alias("n"))
    base = a.join(best, a.id == best.a_id, "left").select(
        F.col("id").alias("osm_id"), F.coalesce("ref", F.lit(0)).alias("ref_id"), F.round(F.coalesce("ratio", F.lit(0.0)), 6).alias("ov_ratio"), F.coalesce("n", F.lit(0)).alias("match_cnt"), F.lit("OSM").alias("src")
    )
    rest = b.join(s.select(F.col("b_id").alias("id")).distinct(), "id", "left_anti")
    return base.union(rest.select(F.lit(0).cast("long"), "id", F.lit(0.0), F.lit(0).cast("long"), F.lit("REF")))


@query(f"""{_PAIRS} SELECT a_id, string_agg(b_id::VARCHAR, ';' ORDER BY b_id) AS ref_ids, round(max(shared / area_a), 6) AS max_ratio, count(*) AS n
FROM pairs WHERE shared / area_a >= 0.1 GROUP BY a_id""")
def water_attribute_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = M.similar_boxes(base_boxes(spark, sf_dir), other_boxes(spark, sf_dir), CELL, "base").where("similarity >= 0.1")
    return s.groupBy("a_id").agg(F.array_join(F.array_sort(F.collect_list("b_id")).cast("array<string>"), ";").alias("ref_ids"), F.round(F.max("similarity"), 6).alias("max_ratio"), F.count(F.lit(1)).alias("n"))


@query(f"{_PAIRS} SELECT a_id, max_by(b_height, (shared, -b_id)) AS height, max(shared) AS shared FROM pairs GROUP BY a_id")
def best_overlap_source_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height of the box with the largest shared area; touching counts."""
    pairs = M.similar_boxes(base_boxes(spark, sf_dir), other_boxes(spark, sf_dir), CELL)
    return pairs.groupBy("a_id").agg(F.max_by("b_height", F.struct("shared", -F.col("b_id"))).alias("height"), F.max("shared").alias("shared"))


@query(f"{_PAIRS} SELECT id FROM a WHERE id NOT IN (SELECT a_id FROM pairs)")
def non_intersecting_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = base_boxes(spark, sf_dir)
    hit = grid_join(a, other_boxes(spark, sf_dir), CELL).select(F.col("a_id").alias("id")).distinct()
    return a.join(hit, "id", "left_anti").select("id")


@query(f"""WITH {SQL['a']} SELECT x.id AS a_id, y.id AS b_id,
  (least(x.maxx, y.maxx) - greatest(x.minx, y.minx)) * (least(x.maxy, y.maxy) - greatest(x.miny, y.miny)) AS overlap
FROM a x JOIN a y ON x.id < y.id AND x.minx < y.maxx AND y.minx < x.maxx AND x.miny < y.maxy AND y.miny < x.maxy
WHERE (least(x.maxx, y.maxx) - greatest(x.minx, y.minx)) * (least(x.maxy, y.maxy) - greatest(x.miny, y.miny)) >= 0.2""")
def overlapping_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts within one layer."""
    a = base_boxes(spark, sf_dir)
    pairs = grid_join(a, a, CELL, keep=F.col("a_id") < F.col("b_id"))
    return pairs.withColumn("overlap", G.shared_area(G.box("a_"), G.box("b_"))).where("overlap >= 0.2").select("a_id", "b_id", "overlap")


@query(f"""WITH {SQL['a']}, p AS (
  SELECT x.id AS i, (least(x.maxx, y.maxx) - greatest(x.minx, y.minx)) * (least(x.maxy, y.maxy) - greatest(x.miny, y.miny)) AS v
  FROM a x JOIN a y ON x.id < y.id AND x.minx < y.maxx AND y.minx < x.maxx AND x.miny < y.maxy AND y.miny < x.maxy)
SELECT (SELECT count(*) FROM p) AS pairs, (SELECT sum(v) FROM p) AS overlap, round((SELECT sum(v) FROM p) / (SELECT sum((maxx - minx) * (maxy - miny)) FROM a), 6) AS rate""")
def overlap_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = base_boxes(spark, sf_dir)
    pairs = grid_join(a, a, CELL, keep=F.col("a_id") < F.col("b_id")).withColumn("v", G.shared_area(G.box("a_"), G.box("b_"))).where("v > 0")
    whole = a.agg(F.sum(G.box_area(G.box())).alias("whole"))
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.sum("v").alias("overlap")).crossJoin(whole).select("pairs", "overlap", F.round(F.col("overlap") / F.col("whole"), 6).alias("rate"))


@query(f"""{_PAIRS}, w AS (SELECT DISTINCT a_id, b_id FROM pairs WHERE shared > 0),
x AS (SELECT *, count(*) OVER (PARTITION BY a_id) AS n_b, count(*) OVER (PARTITION BY b_id) AS n_a FROM w)
SELECT CASE WHEN n_b = 1 AND n_a = 1 THEN '1:1' WHEN n_b > 1 AND n_a = 1 THEN '1:N' WHEN n_b = 1 THEN 'N:1' ELSE 'M:N' END AS relation,
  count(*) AS n, sum(a_id)::BIGINT AS ids FROM x GROUP BY 1""")
def relation_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = M.similar_boxes(base_boxes(spark, sf_dir), other_boxes(spark, sf_dir), CELL).where("shared > 0").select("a_id", "b_id")
    return M.relation_class(pairs).groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.sum("a_id").alias("ids"))


@query(f"""{_PAIRS}, w AS (SELECT a_id, b_id FROM pairs WHERE shared > 0)
SELECT a_id, string_agg(b_id::VARCHAR, ',' ORDER BY b_id) AS related FROM w GROUP BY a_id""")
def related_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = M.similar_boxes(base_boxes(spark, sf_dir), other_boxes(spark, sf_dir), CELL).where("shared > 0")
    return pairs.groupBy("a_id").agg(F.array_join(F.array_sort(F.collect_set("b_id")).cast("array<string>"), ",").alias("related"))


@query(f"""{_PAIRS}, o AS (SELECT a_id, max_by(b_height, (shared, -b_id)) AS h FROM pairs WHERE shared / area_a >= 0.05 GROUP BY a_id),
n AS (
  SELECT a.id AS a_id, min_by(b.height, (greatest(0, a.minx - b.maxx, b.minx - a.maxx) ** 2 + greatest(0, a.miny - b.maxy, b.miny - a.maxy) ** 2, b.id)) AS h
  FROM a JOIN b ON a.minx - 8 <= b.maxx AND b.minx <= a.maxx + 8 AND a.miny - 8 <= b.maxy AND b.miny <= a.maxy + 8
  WHERE greatest(0, a.minx - b.maxx, b.minx - a.maxx) ** 2 + greatest(0, a.miny - b.maxy, b.miny - a.maxy) ** 2 <= 64 GROUP BY a.id)
SELECT id, round(coalesce(o.h, n.h, (SELECT quantile_cont(height, 0.5) FROM b)), 6) AS height,
  CASE WHEN o.h IS NOT NULL THEN 'overlap' WHEN n.h IS NOT NULL THEN 'nearest' ELSE 'median' END AS source
FROM a LEFT JOIN o ON a.id = o.a_id LEFT JOIN n ON a.id = n.a_id""")
def height_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height by overlap, else of the nearest within 8, else the median of all."""
    a, b = base_boxes(spark, sf_dir), other_boxes(spark, sf_dir)
    p, q = G.box("a_"), G.box("b_")
    gap = lambda i: F.greatest(F.lit(0.0), p[i] - q[i + 2], q[i] - p[i + 2])
    near = grid_join(a, b, CELL, 8.0).withColumn("d", gap(0) * gap(0) + gap(1) * gap(1)).withColumn("s", G.shared_area(p, q)).withColumn("r", F.col("s") / G.box_area(p))
    found = near.where("d <= 64").groupBy("a_id").agg(
        F.max_by(F.when(F.col("r") >= 0.05, F.col("b_height")), F.when(F.col("r") >= 0.05, F.struct("s", -F.col("b_id")))).alias("o"),
        F.min_by("b_height", F.struct("d", "b_id")).alias("n"),
    )
    middle = exact_quantile(b, "height", 0.5).select(F.col("quantile").alias("m"))
    return a.select("id").join(found, F.col("id") == F.col("a_id"), "left").crossJoin(F.broadcast(middle)).select(
        "id", F.round(F.coalesce("o", "n", "m"), 6).alias("height"),
        F.when(F.col("o").isNotNull(), "overlap").when(F.col("n").isNotNull(), "nearest").otherwise("median").alias("source"),
    )


@query(f"""WITH {SQL['a']}, t AS (SELECT i, j, i * 100.0 AS minx, j * 100.0 AS miny, i * 100.0 + 100 AS maxx, j * 100.0 + 100 AS maxy FROM range(5) x(i), range((SELECT ceil(max(maxy) / 100)::BIGINT FROM a)) y(j))
SELECT format('tile_{{:03d}}_{{:03d}}', j, i) AS tile_id, count(*) FILTER ((a.minx + a.maxx) / 2 >= t.minx AND (a.minx + a.maxx) / 2 < t.maxx AND (a.miny + a.maxy) / 2 >= t.miny AND (a.miny + a.maxy) / 2 < t.maxy) AS owned, count(*) AS met
FROM a JOIN t ON a.minx <= t.maxx AND t.minx <= a.maxx AND a.miny <= t.maxy AND t.miny <= a.maxy GROUP BY 1""")
def tile_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each tile by either rule: middle within the tile (half open), or box that meets it."""
    from geoweld.operators.tiling import partition_bbox

    boxes = base_boxes(spark, sf_dir)
    top = boxes.agg(F.max("maxy")).first()[0] or 0.0
    tiles = partition_bbox(spark, (0.0, 0.0, 500.0, 100.0 * math.ceil(top / 100)), 100.0, 0.0)
    met = grid_join(boxes, tiles.drop("buffered"), 100.0)
    cx, cy = (F.col("a_minx") + F.col("a_maxx")) / 2, (F.col("a_miny") + F.col("a_maxy")) / 2
    inside = (cx >= F.col("b_minx")) & (cx < F.col("b_maxx")) & (cy >= F.col("b_miny")) & (cy < F.col("b_maxy"))
    return met.groupBy(F.col("b_tile_id").alias("tile_id")).agg(F.count_if(inside).alias("owned"), F.count(F.lit(1)).alias("met"))


_LINES = f"""WITH {SQL['sa']}, {SQL['sb']}, p AS (
  SELECT sa.id AS a_id, sb.id AS b_id, sa.x1 AS ax1, sa.y1 AS ay1, sa.x2 AS ax2, sa.y2 AS ay2, sb.x1 AS bx1, sb.y1 AS by1, sb.x2 AS bx2, sb.y2 AS by2,
    sqrt((sa.x2 - sa.x1) ** 2 + (sa.y2 - sa.y1) ** 2) AS la, sqrt((sb.x2 - sb.x1) ** 2 + (sb.y2 - sb.y1) ** 2) AS lb
  FROM sa JOIN sb ON least(sa.x1, sa.x2) - 20 <= greatest(sb.x1, sb.x2) AND least(sb.x1, sb.x2) <= greatest(sa.x1, sa.x2) + 20
    AND least(sa.y1, sa.y2) - 20 <= greatest(sb.y1, sb.y2) AND least(sb.y1, sb.y2) <= greatest(sa.y1, sa.y2) + 20),
g AS (SELECT *, ((degrees(atan2(ay2 - ay1, ax2 - ax1)) + 360) % 180) AS ta, ((degrees(atan2(by2 - by1, bx2 - bx1)) + 360) % 180) AS tb,
    sqrt((ax1 - bx1) ** 2 + (ay1 - by1) ** 2) AS d11, sqrt((ax1 - bx2) ** 2 + (ay1 - by2) ** 2) AS d12,
    sqrt((ax2 - bx1) ** 2 + (ay2 - by1) ** 2) AS d21, sqrt((ax2 - bx2) ** 2 + (ay2 - by2) ** 2) AS d22 FROM p),
c AS (SELECT a_id, b_id, least(abs(ta - tb), 180 - abs(ta - tb)) AS angle, CASE WHEN la > 0 AND lb > 0 THEN least(la, lb) / greatest(la, lb) ELSE 0 END AS len,
    greatest(greatest(least(d11, d12), least(d21, d22)), greatest(least(d11, d21), least(d12, d22))) AS haus FROM g),
m AS (SELECT * FROM c WHERE angle <= 45 AND len >= 0.2 AND haus <= 15)"""


def _line_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoweld.operators.lines import line_candidates

    return line_candidates(base_segments(spark, sf_dir), other_segments(spark, sf_dir), CELL)


@query(f"{_LINES} SELECT a_id, b_id, round(haus, 6) AS hausdorff_m, round(angle, 6) AS angle_diff_deg, round(len, 6) AS length_similarity FROM m")
def road_match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_candidates(spark, sf_dir).select("a_id", "b_id", *(F.round(c, 6).alias(c) for c in ("hausdorff_m", "angle_diff_deg", "length_similarity")))


@query(f"""{_LINES}, best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY haus, angle, b_id) = 1)
SELECT id, 'base' AS src FROM sa UNION ALL SELECT id, 'supplement' FROM sb WHERE id NOT IN (SELECT b_id FROM best)""")
def best_line_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base lines and the supplements that are no base line's best candidate."""
    best = best_per(_line_candidates(spark, sf_dir), "a_id", F.col("hausdorff_m"), F.col("angle_diff_deg"), F.col("b_id"))
    rest = other_segments(spark, sf_dir).join(best.select(F.col("b_id").alias("id")).distinct(), "id", "left_anti")
    return base_segments(spark, sf_dir).select("id", F.lit("base").alias("src")).union(rest.select("id", F.lit("supplement")))


@query(f"""WITH {SQL['sa']}, e AS (SELECT id, x1 AS x, y1 AS y FROM sa UNION ALL SELECT id, x2, y2 FROM sa),
d AS (SELECT x, y FROM e GROUP BY x, y HAVING count(*) = 1), n AS (SELECT count(*) AS n FROM d), k AS (SELECT sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)) / 1000 AS km, count(*) FILTER (x1 = x2 AND y1 = y2) AS zero FROM sa)
SELECT zero AS zero_length, n AS dangles, round(km, 6) AS length_km, round(n * 100.0 / km, 6) AS dangles_per_100km FROM n, k""")
def line_topology_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoweld.operators.quality import line_topology

    return line_topology(base_segments(spark, sf_dir))


@query(f"""WITH RECURSIVE {SQL['pa']}, {SQL['pb']}, near AS (
  SELECT pa.id AS a, pb.id AS b, sqrt((pa.x - pb.x) ** 2 + (pa.y - pb.y) ** 2) AS d FROM pa JOIN pb ON abs(pa.x - pb.x) <= 25 AND abs(pa.y - pb.y) <= 25 WHERE (pa.x - pb.x) ** 2 + (pa.y - pb.y) ** 2 <= 625),
w AS (
  SELECT *, bool_or(t) OVER (PARTITION BY a) AS ga, bool_or(t) OVER (PARTITION BY b) AS gb FROM (
    SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) = 1 AND row_number() OVER (PARTITION BY b ORDER BY d, a) = 1 AS t FROM near)
  UNION ALL
  SELECT *, bool_or(t) OVER (PARTITION BY a) AS ga, bool_or(t) OVER (PARTITION BY b) AS gb FROM (
    SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY d, b) = 1 AND row_number() OVER (PARTITION BY b ORDER BY d, a) = 1 AS t FROM w WHERE NOT ga AND NOT gb))
SELECT a AS a_id, b AS b_id, round(d, 6) AS dist FROM w WHERE t""")
def poi_greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one pairs within 25, the nearest first."""
    pairs = grid_join(points(base_points(spark, sf_dir)), points(other_points(spark, sf_dir)), 25.0, 25.0)
    near = pairs.withColumn("dist", G.distance(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y"))).where("dist <= 25")
    return M.greedy_one_to_one(near.select("a_id", "b_id", "dist"), "dist").withColumn("dist", F.round("dist", 6))


@query(f"""WITH {SQL['pa']}, {SQL['pb']} SELECT pa.id AS a_id, pb.id AS b_id, round(sqrt((pa.x - pb.x) ** 2 + (pa.y - pb.y) ** 2), 6) AS dist
FROM pa JOIN pb ON abs(pa.x - pb.x) <= 25 AND abs(pa.y - pb.y) <= 25 WHERE (pa.x - pb.x) ** 2 + (pa.y - pb.y) ** 2 <= 625
QUALIFY row_number() OVER (PARTITION BY pa.id ORDER BY (pa.x - pb.x) ** 2 + (pa.y - pb.y) ** 2, pb.id) = 1""")
def poi_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = G.distance(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y"))
    near = nearest_within(points(base_points(spark, sf_dir)), points(other_points(spark, sf_dir)), 25.0, 25.0, d, F.col("b_id"))
    return near.select("a_id", "b_id", F.round("dist", 6).alias("dist"))


@query()
def poi_geohash_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in the geohash cell and around it whose names score 0.75 or more, or 0."""
    from geoweld.operators.poi import geohash_candidates

    parts = on_globe(other_points(spark, sf_dir))
    return geohash_candidates(parts, parts, 5, 0.75)


@query()
def part_name_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name scores of the distinct part names, of which there are few, that share their first word."""
    from geoweld.plans.registry import table

    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().withColumn("word", F.split("name", " ")[0])
    pairs = names.alias("a").join(names.alias("b"), "word").where("a.name < b.name").select(F.col("a.name").alias("left"), F.col("b.name").alias("right")).distinct()
    return pairs.withColumn("score", F.round(name_score(F.col("left"), F.col("right")), 6))
