"""Queries of lines of several vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweld.functions.polygons import line_length
from geoweld.operators import polylines as L
from geoweld.plans.derived import _at
from geoweld.plans.more import _covered
from geoweld.plans.registry import query, table

CELL = 60.0
RADIUS, FAR, LEAST_PART = 5.0, 4.0, 3.0

_X, _Y = _at("k", 7919, 104729, 401)
#: Vertex n of 1 to 7 of line k, and of another drawing of it that is more or less beside it.
_VERTEX = (f"{_X} + 9 * n + (k * 7 + n * 5) % 4", f"{_Y} + (k * 11 + n * 3) % 7")
_BESIDE = (f"{_X} + 9 * n + (k * 3) % 5 + (k * 7 + n * 5) % 4", f"{_Y} + (k * 11 + n * 3) % 7 + (k % 4) * (n - 1)")


def _lines(spark: SparkSession, sf_dir: str, vertex: tuple[str, str]) -> DataFrame:
    """Lines through the numbered items of each order."""
    items = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS k", "CAST(l_linenumber AS BIGINT) AS n").distinct()
    at = items.selectExpr("k AS id", "n", *(f"CAST({e} AS DOUBLE) AS {c}" for e, c in zip(vertex, "xy", strict=True)))
    rows = at.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "x", "y"))).alias("v"))
    return rows.select("id", F.transform("v", lambda v: F.struct(v["x"], v["y"])).alias("points"))


def _sql_lines(v: str, seg: str, line: str, vertex: tuple[str, str]) -> str:
    """CTEs of vertices, of segments (id is a segment's own, of its line) and of lines with two points or more."""
    return f"""{v} AS (SELECT k AS of, n, CAST({vertex[0]} AS DOUBLE) AS x, CAST({vertex[1]} AS DOUBLE) AS y FROM it),
{seg}_s AS (SELECT of * 8 + n AS id, of, n, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2, sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2) AS len FROM {v} WINDOW w AS (PARTITION BY of ORDER BY n)),
{seg} AS (SELECT *, (sum(len) OVER w - len) / sum(len) OVER (PARTITION BY of) AS lo, sum(len) OVER w / sum(len) OVER (PARTITION BY of) AS hi FROM {seg}_s WHERE len > 0 WINDOW w AS (PARTITION BY of ORDER BY n)),
{line} AS (SELECT {v}.of AS id, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy, any_value(l.long) AS long, (degrees(atan2(max_by(y, n) - min_by(y, n), max_by(x, n) - min_by(x, n))) + 360) % 180 AS way
  FROM {v} JOIN (SELECT of, sum(len) AS long FROM {seg} GROUP BY of) l ON l.of = {v}.of GROUP BY 1)"""


_DISTANCE = "sqrt((px - x1 - t * (x2 - x1)) ** 2 + (py - y1 - t * (y2 - y1)) ** 2)"


def _far(name: str, pairs: str, own: str, v: str, other: str, seg: str) -> str:
    """CTE a_id, b_id, d: how far the vertices of the one line of a pair lie from the other at most."""
    return f"""{name} AS (SELECT a_id, b_id, max(d) AS d FROM (SELECT a_id, b_id, n, min({_DISTANCE}) AS d FROM (
  SELECT a_id, b_id, v.n, v.x AS px, v.y AS py, s.x1, s.y1, s.x2, s.y2, greatest(0, least(1, ((v.x - s.x1) * (s.x2 - s.x1) + (v.y - s.y1) * (s.y2 - s.y1)) / (s.len * s.len))) AS t
  FROM {pairs} JOIN {v} v ON v.of = {own} JOIN {seg} s ON s.of = {other}) GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


_ROADS = f"""WITH it AS (SELECT DISTINCT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS n FROM lineitem), {_sql_lines('av', 'sa', 'al', _VERTEX)}, {_sql_lines('bv', 'so', 'bl', _BESIDE)},
cand AS (SELECT a.id AS a_id, b.id AS b_id, least(abs(a.way - b.way), 180 - abs(a.way - b.way)) AS angle, least(a.long, b.long) / greatest(a.long, b.long) AS similarity
  FROM al a JOIN bl b ON a.minx - {RADIUS} <= b.maxx AND b.minx <= a.maxx + {RADIUS} AND a.miny - {RADIUS} <= b.maxy AND b.miny <= a.maxy + {RADIUS}
  WHERE least(abs(a.way - b.way), 180 - abs(a.way - b.way)) <= 45 AND least(a.long, b.long) / greatest(a.long, b.long) >= 0.05),
{_covered('c', RADIUS, of='so')},
part AS (SELECT sa.of AS a_id, so.of AS b_id, so.lo + c.lo * (so.hi - so.lo) AS lo, so.lo + c.hi * (so.hi - so.lo) AS hi FROM c JOIN so ON so.id = c.id JOIN sa ON sa.id = c.b_id SEMI JOIN cand ON cand.a_id = sa.of AND cand.b_id = so.of),
o AS (SELECT *, max(hi) OVER (PARTITION BY a_id, b_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM part),
u AS (SELECT a_id, b_id, sum(greatest(0, hi - greatest(lo, coalesce(upto, 0)))) AS covered FROM o GROUP BY 1, 2 HAVING sum(greatest(0, hi - greatest(lo, coalesce(upto, 0)))) >= 0.8),
{_far('fa', 'u', 'a_id', 'av', 'b_id', 'so')}, {_far('fb', 'u', 'b_id', 'bv', 'a_id', 'sa')},
m AS (SELECT u.*, cand.angle, cand.similarity, greatest(fa.d, fb.d) AS hausdorff, CASE WHEN greatest(fa.d, fb.d) <= {FAR} THEN 1 ELSE 2 END AS label FROM u JOIN fa USING (a_id, b_id) JOIN fb USING (a_id, b_id) JOIN cand USING (a_id, b_id))"""


@query(f"{_ROADS} SELECT a_id, b_id, round(angle, 6) AS angle, round(similarity, 6) AS similarity, round(covered, 6) AS covered, round(hausdorff, 6) AS hausdorff, label::INT AS label FROM m")
def road_line_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of up to seven vertices of which four fifths run along a base line, labelled by their Hausdorff distance."""
    found = L.matched_lines(_lines(spark, sf_dir, _VERTEX), _lines(spark, sf_dir, _BESIDE), CELL, RADIUS, hausdorff=FAR)
    return found.select("a_id", "b_id", *(F.round(c, 6).alias(c) for c in ("angle", "similarity", "covered", "hausdorff")), "label")


@query(f"""{_ROADS}, lab AS (SELECT a_id AS id, coalesce(string_agg(b_id::VARCHAR, ',' ORDER BY b_id) FILTER (label = 1), '') AS label1, coalesce(string_agg(b_id::VARCHAR, ',' ORDER BY b_id) FILTER (label = 2), '') AS label2 FROM m GROUP BY 1),
len_a AS (SELECT of AS id, coalesce(sum(len), 0) AS long FROM sa_s GROUP BY 1), len_b AS (SELECT of AS id, coalesce(sum(len), 0) AS long FROM so_s GROUP BY 1),
w AS (SELECT part.b_id AS id, lo, hi, max(hi) OVER (PARTITION BY part.b_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM part JOIN m USING (a_id, b_id)),
gap AS (SELECT id, coalesce(upto, 0) AS lo, lo AS hi FROM w WHERE lo > coalesce(upto, 0) UNION ALL SELECT id, max(hi), 1 FROM w GROUP BY id HAVING max(hi) < 1)
SELECT 'base' AS role, id, 0 AS part, coalesce(label1, '') AS label1, coalesce(label2, '') AS label2, round(long, 4) AS length FROM len_a LEFT JOIN lab USING (id)
UNION ALL SELECT 'supplement', id, 0, '', '', round(long, 4) FROM len_b WHERE id NOT IN (SELECT b_id FROM m)
UNION ALL SELECT 'residual', id, (row_number() OVER (PARTITION BY id ORDER BY lo))::INT, '', '', round((hi - lo) * long, 4) FROM gap JOIN len_b USING (id) WHERE (hi - lo) * long > {LEAST_PART}""")
def road_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base lines with their matches by label, the lines that match none, and what of the others lies beyond the lines that they match."""
    fused = L.fused_lines(_lines(spark, sf_dir, _VERTEX), _lines(spark, sf_dir, _BESIDE), CELL, RADIUS, LEAST_PART, hausdorff=FAR)
    return fused.select("role", "id", "part", "label1", "label2", F.round(line_length(F.col("points")), 4).alias("length"))


_VERTICES = "sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)"


@query(f"""{_ROADS}, d AS (SELECT a_id, b_id, p.n AS i, q.n AS j, {_VERTICES} AS d FROM cand JOIN av p ON p.of = a_id JOIN bv q ON q.of = b_id),
h AS (SELECT a_id, b_id, greatest((SELECT 0), max(near)) AS d FROM (SELECT a_id, b_id, min(d) AS near FROM d GROUP BY a_id, b_id, i UNION ALL SELECT a_id, b_id, min(d) FROM d GROUP BY a_id, b_id, j) GROUP BY 1, 2)
SELECT a_id, b_id, round(d, 6) AS hausdorff FROM h WHERE d <= 12""")
def line_vertex_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines within 12 of each other by the discrete Hausdorff distance of their vertices."""
    near = L.lines_within(_lines(spark, sf_dir, _VERTEX), _lines(spark, sf_dir, _BESIDE), CELL, 12.0, RADIUS)
    return near.select("a_id", "b_id", F.round("hausdorff", 6).alias("hausdorff"))


@query(f"""WITH it AS (SELECT DISTINCT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS n FROM lineitem), {_sql_lines('av', 'sa', 'al', _VERTEX)},
k AS (SELECT id, long, unnest(range(0, greatest(ceil(long / 20), 1)::INT))::INT AS part FROM al)
SELECT id, part, round(least((part + 1) * 20, long) - part * 20, 6) AS length FROM k WHERE least((part + 1) * 20, long) - part * 20 > 2""")
def roads_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in full lengths of 20 and a rest, along their vertices; rests of up to 2 go."""
    cut = L.split_by_length(_lines(spark, sf_dir, _VERTEX), 20.0, 2.0)
    # the pieces' lengths along the line add up to it, which their own points tell
    return cut.select("id", "part", F.round(line_length(F.col("points")), 6).alias("length"))
