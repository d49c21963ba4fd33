"""Line clean-up, stitching and alignment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweld.operators import line_cleanup as L
from geoweld.operators import lines
from geoweld.operators import stitching as T
from geoweld.plans.derived import CELL, SQL, base_points, base_segments, other_points, other_segments
from geoweld.plans.registry import query, table


def _near(s: str, b: str, r: float) -> str:
    """That the boxes of two segments meet once one is widened by r."""
    one = lambda c: f"least({s}.{c}1, {s}.{c}2) - {r} <= greatest({b}.{c}1, {b}.{c}2) AND least({b}.{c}1, {b}.{c}2) <= greatest({s}.{c}1, {s}.{c}2) + {r}"
    return f"{one('x')} AND {one('y')}"


def _covered(name: str, r: float, angle: float = 90.0, of: str = "sb") -> str:
    """CTEs that end in `name`: id, b_id, lo, hi of where along each supplement a base segment of like direction lies within r."""
    turn = "((degrees(atan2({0}y2 - {0}y1, {0}x2 - {0}x1)) + 360) % 180)"
    s, b = turn.format("s."), turn.format("b.")
    return f"""{name}_p AS (SELECT s.id, b.id AS b_id, s.x1, s.y1, s.x2 - s.x1 AS dx, s.y2 - s.y1 AS dy, b.x1 AS wx, b.y1 AS wy, b.x2 AS cx, b.y2 AS cy, b.x2 - b.x1 AS ux, b.y2 - b.y1 AS uy,
    sqrt((s.x2 - s.x1) ** 2 + (s.y2 - s.y1) ** 2) AS own, sqrt((b.x2 - b.x1) ** 2 + (b.y2 - b.y1) ** 2) AS long
  FROM {of} s JOIN sa b ON {_near('s', 'b', r)} WHERE least(abs({s} - {b}), 180 - abs({s} - {b})) <= {angle}),
{name}_c AS (SELECT *, nullif(dx * dx + dy * dy, 0) AS sq, ((x1 - wx) * ux + (y1 - wy) * uy) / nullif(long, 0) AS p0, (dx * ux + dy * uy) / nullif(long, 0) AS dp,
    ((y1 - wy) * ux - (x1 - wx) * uy) / nullif(long, 0) AS q0, (dy * ux - dx * uy) / nullif(long, 0) AS dq FROM {name}_p),
{name}_r AS (SELECT *, ((x1 - wx) * dx + (y1 - wy) * dy) / sq AS h0, ((x1 - cx) * dx + (y1 - cy) * dy) / sq AS h1, ((x1 - wx) ** 2 + (y1 - wy) ** 2 - {r} ** 2) / sq AS e0, ((x1 - cx) ** 2 + (y1 - cy) ** 2 - {r} ** 2) / sq AS e1,
    CASE WHEN dp <> 0 THEN least(-p0 / dp, (long - p0) / dp) WHEN p0 BETWEEN 0 AND long THEN 0 END AS pa, CASE WHEN dp <> 0 THEN greatest(-p0 / dp, (long - p0) / dp) WHEN p0 BETWEEN 0 AND long THEN 1 END AS pb,
    CASE WHEN dq <> 0 THEN least((-{r} - q0) / dq, ({r} - q0) / dq) WHEN q0 BETWEEN -{r} AND {r} THEN 0 END AS qa, CASE WHEN dq <> 0 THEN greatest((-{r} - q0) / dq, ({r} - q0) / dq) WHEN q0 BETWEEN -{r} AND {r} THEN 1 END AS qb FROM {name}_c),
{name}_i AS (SELECT id, b_id, own, long, 0 AS k, -h0 - sqrt(greatest(h0 * h0 - e0, 0)) AS lo, -h0 + sqrt(greatest(h0 * h0 - e0, 0)) AS hi, h0 * h0 - e0 >= 0 AS there FROM {name}_r
  UNION ALL SELECT id, b_id, own, long, 1, -h1 - sqrt(greatest(h1 * h1 - e1, 0)), -h1 + sqrt(greatest(h1 * h1 - e1, 0)), h1 * h1 - e1 >= 0 FROM {name}_r
  UNION ALL SELECT id, b_id, own, long, 2, greatest(pa, qa), least(pb, qb), pa IS NOT NULL AND qa IS NOT NULL AND greatest(pa, qa, 0) <= least(pb, qb, 1) FROM {name}_r),
{name} AS (SELECT id, b_id, any_value(own) AS own, any_value(long) AS long, min(greatest(lo, 0)) AS lo, max(least(hi, 1)) AS hi FROM {name}_i WHERE there AND hi >= 0 AND lo <= 1 GROUP BY id, b_id),
{name}_o AS (SELECT *, max(hi) OVER (PARTITION BY id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM {name})"""


def _point_to(b: str) -> str:
    """The share of segment b at which it is nearest to (x, y)."""
    d = f"(({b}.x2 - {b}.x1) ** 2 + ({b}.y2 - {b}.y1) ** 2)"
    return f"CASE WHEN {d} > 0 THEN greatest(0, least(1, ((x - {b}.x1) * ({b}.x2 - {b}.x1) + (y - {b}.y1) * ({b}.y2 - {b}.y1)) / {d})) ELSE 0 END"


def _sampled(name: str, r: float, angle: float = 90.0, of: str = "sb", step: float = 5.0) -> str:
    """CTEs that end in `name`: id, mean, p90, far of the distances of samples of each supplement to the base."""
    beside = f"b.x1 + t * (b.x2 - b.x1) - x AS ox, b.y1 + t * (b.y2 - b.y1) - y AS oy"
    return f"""{name}_n AS (SELECT *, greatest(ceil(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) / {step}) + 1, 3)::INT AS n FROM {of}),
{name}_s AS (SELECT id, i, (degrees(atan2(y2 - y1, x2 - x1)) + 360) % 180 AS way, x1 + i / (n - 1) * (x2 - x1) AS x, y1 + i / (n - 1) * (y2 - y1) AS y FROM (SELECT *, unnest(range(n)) AS i FROM {name}_n)),
{name}_d AS (SELECT id, i, min(sqrt(ox ** 2 + oy ** 2)) AS d FROM (SELECT o.id, i, {beside} FROM (SELECT s.id, s.i, s.x, s.y, b.id AS b_id, {_point_to('b')} AS t
    FROM {name}_s s JOIN sa b ON x - {r} <= greatest(b.x1, b.x2) AND least(b.x1, b.x2) <= x + {r} AND y - {r} <= greatest(b.y1, b.y2) AND least(b.y1, b.y2) <= y + {r}
      AND least(abs(way - (degrees(atan2(b.y2 - b.y1, b.x2 - b.x1)) + 360) % 180), 180 - abs(way - (degrees(atan2(b.y2 - b.y1, b.x2 - b.x1)) + 360) % 180)) <= {angle}) o JOIN sa b ON b.id = o.b_id) GROUP BY id, i),
{name} AS (SELECT id, avg(e) AS mean, quantile_cont(e, 0.9) AS p90, max(e) AS far FROM (SELECT s.id, CASE WHEN d <= {r} THEN d ELSE 'inf'::DOUBLE END AS e FROM {name}_s s LEFT JOIN {name}_d d ON s.id = d.id AND s.i = d.i) GROUP BY id)"""


@query(f"""WITH {SQL['sa']}, e AS (SELECT id, 1 AS k, x1 AS x, y1 AS y FROM sa UNION ALL SELECT id, 2, x2, y2 FROM sa),
m AS (SELECT e.id, e.k, e.x - s.x1 AS px, e.y - s.y1 AS py, s.x2 - s.x1 AS dx, s.y2 - s.y1 AS dy FROM e JOIN sa s ON e.id <> s.id
  AND e.x - 1 <= greatest(s.x1, s.x2) AND e.x + 1 >= least(s.x1, s.x2) AND e.y - 1 <= greatest(s.y1, s.y2) AND e.y + 1 >= least(s.y1, s.y2)),
h AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0, least(1, (px * dx + py * dy) / (dx * dx + dy * dy))) ELSE 0 END AS t FROM m),
c AS (SELECT id, count(DISTINCT k) AS tied FROM h WHERE sqrt((px - t * dx) ** 2 + (py - t * dy) ** 2) <= 1 GROUP BY id)
SELECT sa.id FROM sa LEFT JOIN c USING (id) WHERE (coalesce(tied, 0) = 0 AND sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) <= 30) OR (tied = 1 AND sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) <= 12)""")
def dangling_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.dangling(base_segments(spark, sf_dir), CELL)


@query(f"""WITH {SQL['sa']}, {SQL['sb']}, {_covered('c8', 8.0, 25.0)}, {_covered('c6', 6.0, 18.0)}, {_covered('c12', 12.0)}, {_sampled('d12', 12.0)}, {_sampled('d32', 32.0)},
u6 AS (SELECT id, sum(greatest(0, hi - greatest(lo, coalesce(upto, -1)))) AS covered FROM c6_o GROUP BY id), u12 AS (SELECT id, sum(greatest(0, hi - greatest(lo, coalesce(upto, -1)))) AS covered FROM c12_o GROUP BY id),
f AS (SELECT id, 1 AS k, x1 AS x, y1 AS y FROM sb UNION ALL SELECT id, 2, x2, y2 FROM sb),
g AS (SELECT f.id, f.k, f.x, f.y, b.x1, b.y1, b.x2, b.y2, {_point_to('b')} AS t FROM f JOIN sa b ON x - 12 <= greatest(b.x1, b.x2) AND least(b.x1, b.x2) <= x + 12 AND y - 12 <= greatest(b.y1, b.y2) AND least(b.y1, b.y2) <= y + 12),
h AS (SELECT id FROM g WHERE sqrt((x1 + t * (x2 - x1) - x) ** 2 + (y1 + t * (y2 - y1) - y) ** 2) <= 12 GROUP BY id HAVING count(DISTINCT k) = 2)
SELECT DISTINCT id, 'pair' AS rule FROM c8 WHERE hi - lo >= 0.92 AND (own <= 1.5 * long OR hi - lo >= 0.98)
UNION ALL SELECT u6.id, 'group' FROM u6 JOIN d12 USING (id) WHERE covered >= 0.9 AND mean <= 4 AND p90 <= 7
UNION ALL SELECT u12.id, 'return' FROM u12 JOIN h USING (id) JOIN d32 USING (id) WHERE covered >= 0.85 AND mean <= 6 AND p90 <= 10 AND far <= 16""")
def line_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplements that one base line, several, or a corridor along the base double."""
    s, b = other_segments(spark, sf_dir), base_segments(spark, sf_dir)
    near = L.near_pairs(s, b, CELL)
    return (
        lines.duplicate_supplements(s, b, CELL, pairs=near).select("id", F.lit("pair").alias("rule"))
        .union(L.group_duplicates(s, b, CELL, pairs=near).select("id", F.lit("group")))
        .union(L.near_base_returns(s, b, CELL, pairs=near).select("id", F.lit("return")))
    )


@query(f"""WITH {SQL['sa']}, {SQL['sb']}, {_covered('c', 3.0)},
gap AS (SELECT id, coalesce(upto, 0) AS lo, lo AS hi FROM c_o WHERE lo > coalesce(upto, 0) UNION ALL SELECT sb.id, coalesce(max(c.hi), 0), 1 FROM sb LEFT JOIN c USING (id) GROUP BY sb.id HAVING coalesce(max(c.hi), 0) < 1),
k AS (SELECT sb.*, lo, hi FROM gap JOIN sb USING (id) WHERE (hi - lo) * sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) >= 5)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY lo)::INT AS part, round(x1 + lo * (x2 - x1), 4) AS x1, round(y1 + lo * (y2 - y1), 4) AS y1, round(x1 + hi * (x2 - x1), 4) AS x2, round(y1 + hi * (y2 - y1), 4) AS y2 FROM k""")
def line_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the supplements lies beyond 3 of the base, from a length of 5."""
    rest = lines.residuals(other_segments(spark, sf_dir), base_segments(spark, sf_dir), CELL, 3.0, 5.0)
    return rest.select("id", "part", *(F.round(c, 4).alias(c) for c in lines.ENDS))


@query(f"""WITH {SQL['sa']}, {SQL['sb']}, f AS (SELECT id, 1 AS k, x1 AS x, y1 AS y FROM sb UNION ALL SELECT id, 2, x2, y2 FROM sb),
g AS (SELECT f.id, f.k, f.x, f.y, b.id AS b_id, b.x1, b.y1, b.x2, b.y2, {_point_to('b')} AS t FROM f JOIN sa b ON x - 10 <= greatest(b.x1, b.x2) AND least(b.x1, b.x2) <= x + 10 AND y - 10 <= greatest(b.y1, b.y2) AND least(b.y1, b.y2) <= y + 10),
h AS (SELECT *, x1 + t * (x2 - x1) AS px, y1 + t * (y2 - y1) AS py FROM g),
n AS (SELECT id, k, px, py FROM h WHERE sqrt((px - x) ** 2 + (py - y) ** 2) <= 10 QUALIFY row_number() OVER (PARTITION BY id, k ORDER BY sqrt((px - x) ** 2 + (py - y) ** 2), b_id) = 1)
SELECT f.id, f.k AS "end", round(coalesce(px, x), 4) AS x, round(coalesce(py, y), 4) AS y, px IS NOT NULL AS snapped FROM f LEFT JOIN n ON f.id = n.id AND f.k = n.k""")
def snapped_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lines.snapped_endpoints(other_segments(spark, sf_dir), base_segments(spark, sf_dir), CELL)
    return made.select("id", "end", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "snapped")


@query("""WITH r AS (SELECT o_orderkey, o_custkey % 50 AS tile, CASE WHEN o_orderstatus = 'F' AND o_custkey % 50 > 10 THEN 1 WHEN o_orderstatus = 'O' AND o_custkey % 50 > 3 THEN 2 ELSE 3 END AS priority FROM orders)
SELECT o_orderkey, tile, priority FROM r QUALIFY priority = min(priority) OVER (PARTITION BY tile)""")
def bounded_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tile takes the first source that has anything for it."""
    status, tile = F.col("o_orderstatus"), F.col("o_custkey") % 50
    priority = F.when((status == "F") & (tile > 10), 1).when((status == "O") & (tile > 3), 2).otherwise(3)
    o = table(spark, sf_dir, "orders")
    return T.first_source_per_tile(o.select("o_orderkey", tile.alias("tile"), priority.alias("priority")), "tile", "priority")


@query("""WITH r AS (SELECT l_orderkey AS k, l_returnflag AS source, CASE WHEN l_orderkey % 5 = 0 THEN 'None' ELSE (l_orderkey % 700)::VARCHAR END AS own, l_partkey::VARCHAR AS shape, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey AS o FROM lineitem),
n AS (SELECT *, CASE WHEN own = 'None' THEN 'shape~' || shape ELSE 'id~' || source || '~' || own END AS name FROM r) SELECT count(*) AS n, sum(k)::BIGINT AS keys FROM (SELECT name, min(o), min_by(k, o) AS k FROM n GROUP BY name)""")
def stitched_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles put together: one row for each source and id, or shape where the id says nothing."""
    own = F.when(F.col("l_orderkey") % 5 == 0, "None").otherwise((F.col("l_orderkey") % 700).cast("string"))
    o = F.col("l_orderkey") * 100000000 + F.col("l_linenumber").cast("long") * 10000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("source"), own.alias("own"), F.col("l_partkey").cast("string").alias("shape"), o.alias("o"))
    return T.stitched(rows, "source", "own", F.col("shape"), "o").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


@query("""WITH j AS (SELECT 's' || (user_id % 3) || ':' || user_id || ':' || event_type AS job_key, event_type AS status, ts, event_id FROM events WHERE event_type <> 'view'),
l AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY job_key ORDER BY ts DESC) = 1)
SELECT job_key, make_timestamp((epoch(date_trunc('second', ts))::BIGINT + 300) * 1000000) AS next_retry, ts + INTERVAL 24 HOUR AS window_ends FROM l""")
def retry_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A retry for every source that wasn't available."""
    status = F.when(F.col("event_type") == "view", "available").otherwise(F.col("event_type"))
    attempts = table(spark, sf_dir, "events").select(F.concat(F.lit("s"), F.col("user_id") % 3).alias("scenario"), F.col("user_id").cast("string").alias("run"), F.col("event_type").alias("source"), status.alias("status"), F.col("ts").alias("at"))
    return T.retry_jobs(attempts, F.lit(300)).select("job_key", "next_retry", "window_ends")


@query(f"""WITH {SQL['pa']}, {SQL['pb']}, a AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'K' || id ELSE ' nan' END AS key, x, y FROM pa), b AS (SELECT id, 'K' || (id * 2) AS key, x, y FROM pb),
k AS (SELECT a.id AS a_id, b.id AS b_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist FROM a JOIN b ON a.key = b.key QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY dist, b.id) = 1),
n AS (SELECT a.id AS a_id, b.id AS b_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist FROM a JOIN b ON abs(a.x - b.x) <= 25 AND abs(a.y - b.y) <= 25 WHERE a.id NOT IN (SELECT a_id FROM k) AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 625
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY dist, b.id) = 1)
SELECT a_id, b_id, 'key' AS how, round(dist, 6) AS dist FROM k UNION ALL SELECT a_id, b_id, 'nearest', round(dist, 6) FROM n""")
def feature_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same key first, else the nearest within 25."""
    a = base_points(spark, sf_dir).withColumn("key", F.when(F.col("id") % 3 == 0, F.concat(F.lit("K"), "id")).otherwise(" nan"))
    b = other_points(spark, sf_dir).withColumn("key", F.concat(F.lit("K"), F.col("id") * 2))
    return T.aligned(a.drop("name"), b.drop("name"), 25.0, 25.0).withColumn("dist", F.round("dist", 6))
