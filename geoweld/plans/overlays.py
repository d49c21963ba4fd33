"""Queries of shapes with any rings: matching, clipping, repair, dissolving, and lines put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweld.functions import overlay as O
from geoweld.operators import chains as C
from geoweld.operators import matching as M
from geoweld.operators import shapes as S
from geoweld.operators.components import checkpointed
from geoweld.plans.derived import CELL, SQL, base_boxes, other_boxes, spread
from geoweld.plans.registry import query, table

#: Shares of a box from which shapes are made, by id % 3: an L, a ring with a hole, two members. Each a list of rings of (x, y).
_SHAPES = (
    [[(0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1)]],
    [[(0, 0), (1, 0), (1, 1), (0, 1)], [(0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75)]],
    [[(0, 0), (0.5, 0), (0.5, 0.5), (0, 0.5)], [(0.5, 0.5), (0.5, 1), (1, 1), (1, 0.5)]],
)
#: The same as rectangles (x1, y1, x2, y2) that don't overlap.
_PIECES = (
    [(0, 0, 1, 0.5), (0, 0.5, 0.5, 1)],
    [(0, 0, 1, 0.25), (0, 0.75, 1, 1), (0, 0.25, 0.25, 0.75), (0.75, 0.25, 1, 0.75)],
    [(0, 0, 0.5, 0.5), (0.5, 0.5, 1, 1)],
)


def _rings(rings: list) -> str:
    at = lambda s, c: f"min{c} + {float(s)}D * (max{c} - min{c})"
    return "array(" + ", ".join("array(" + ", ".join(f"struct({at(x, 'x')} AS x, {at(y, 'y')} AS y)" for x, y in r) + ")" for r in rings) + ")"


def shaped(boxes: DataFrame) -> DataFrame:
    """id and parts: a shape in each box."""
    boxes = spread(boxes)
    of = " ".join(f"WHEN {k} THEN {_rings(rings)}" for k, rings in enumerate(_SHAPES))
    return boxes.selectExpr("id", f"CASE CAST(id % 3 AS INT) {of} END AS parts")


def _pieces(name: str, of: str) -> str:
    """CTE `name` of the shapes of `of` as rectangles, with their areas."""
    at = lambda s, c: f"min{c} + {float(s)} * (max{c} - min{c})"
    rows = [
        f"SELECT id, {at(a, 'x')} AS minx, {at(b, 'y')} AS miny, {at(c, 'x')} AS maxx, {at(d, 'y')} AS maxy FROM {of} WHERE id % 3 = {k}"
        for k, pieces in enumerate(_PIECES)
        for a, b, c, d in pieces
    ]
    return f"{name} AS ({' UNION ALL '.join(rows)}), {name}_area AS (SELECT id, sum((maxx - minx) * (maxy - miny)) AS area FROM {name} GROUP BY id)"


def _shared(name: str, a: str, b: str) -> str:
    return f"""{name} AS (SELECT x.id AS a_id, y.id AS b_id, sum((least(x.maxx, y.maxx) - greatest(x.minx, y.minx)) * (least(x.maxy, y.maxy) - greatest(x.miny, y.miny))) AS shared
  FROM {a} x JOIN {b} y ON x.minx < y.maxx AND y.minx < x.maxx AND x.miny < y.maxy AND y.miny < x.maxy GROUP BY 1, 2)"""


_OVERLAPS = f"""WITH {SQL['a']}, {SQL['b']}, {_pieces('ap', 'a')}, {_pieces('bp', 'b')}, {_shared('s', 'ap', 'bp')},
pairs AS (SELECT s.*, x.area AS area_a, y.area AS area_b FROM s JOIN ap_area x ON x.id = a_id JOIN bp_area y ON y.id = b_id)"""


@query(f"{_OVERLAPS} SELECT a_id, b_id, round(shared, 6) AS shared, round(shared / least(area_a, area_b), 6) AS similarity FROM pairs")
def shape_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concave, holed and two-part shapes that share area."""
    pairs = S.similar_shapes(shaped(base_boxes(spark, sf_dir)), shaped(other_boxes(spark, sf_dir)), CELL)
    return pairs.select("a_id", "b_id", F.round("shared", 6).alias("shared"), F.round("similarity", 6).alias("similarity"))


@query(f"""{_OVERLAPS}, s3 AS (SELECT *, round(shared / least(area_a, area_b), 9) AS sim FROM pairs),
f AS (SELECT * FROM s3 WHERE sim >= 0.3 QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY sim DESC, b_id) = 1),
m AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY b_id ORDER BY sim DESC, a_id) = 1)
SELECT a_id AS id, b_id AS ref_id, 'matched' AS src FROM m
UNION ALL SELECT id, NULL, 'base' FROM a WHERE id NOT IN (SELECT a_id FROM m)
UNION ALL SELECT NULL, id, 'other' FROM b WHERE id NOT IN (SELECT b_id FROM m)""")
def shape_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The building join over shapes: two passes, and the merged layer."""
    a, b = shaped(base_boxes(spark, sf_dir)), shaped(other_boxes(spark, sf_dir))
    pairs = S.similar_shapes(a, b, CELL).select("a_id", "b_id", F.round("similarity", 9).alias("similarity"))
    return M.merged_layer(a, b, checkpointed(M.two_pass_matches(checkpointed(pairs), 0.3).select("a_id", "b_id")))


@query(f"""{_OVERLAPS}, w AS (SELECT a_id, b_id, round(shared / area_a, 6) AS ratio FROM pairs WHERE round(shared / area_a, 9) >= 0.1)
SELECT a_id, min_by(b_id, (-ratio, b_id)) AS ref_id, max(ratio) AS ov_ratio, count(*) AS match_cnt, string_agg(b_id::VARCHAR, ';' ORDER BY b_id) AS ref_ids FROM w GROUP BY a_id""")
def shape_water_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The water join over shapes: best reference by the share of the base's area, how many and which."""
    pairs = S.similar_shapes(shaped(base_boxes(spark, sf_dir)), shaped(other_boxes(spark, sf_dir)), CELL, "base")
    near = pairs.where(F.round("similarity", 9) >= 0.1).select("a_id", "b_id", F.round("similarity", 6).alias("ratio"))
    return near.groupBy("a_id").agg(
        F.min_by("b_id", F.struct(-F.col("ratio"), "b_id")).alias("ref_id"), F.max("ratio").alias("ov_ratio"), F.count(F.lit(1)).alias("match_cnt"),
        F.array_join(F.array_sort(F.collect_list("b_id")).cast("array<string>"), ";").alias("ref_ids"),
    )


_MASK_BOX = "s_suppkey AS id, CAST((s_suppkey * 67) % 401 AS DOUBLE) AS minx, CAST((s_suppkey * 131) % 401 + 401 * floor(s_suppkey / 40) AS DOUBLE) AS miny"


@query(f"""WITH {SQL['a']}, {_pieces('ap', 'a')}, mb AS (SELECT *, minx + 60 AS maxx, miny + 60 AS maxy FROM (SELECT {_MASK_BOX} FROM supplier)), {_pieces('mp', 'mb')}, {_shared('s', 'ap', 'mp')}
SELECT a_id AS id, b_id AS mask, round(shared, 6) AS area FROM s""")
def clipped_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes cut to the boundaries of areas, which are concave, holed or in two parts themselves."""
    masks = table(spark, sf_dir, "supplier").selectExpr(*_MASK_BOX.split(", ")).withColumns({"maxx": F.col("minx") + 60, "maxy": F.col("miny") + 60})
    cut = S.clipped(shaped(base_boxes(spark, sf_dir)), shaped(masks), CELL, "area")
    return cut.select("id", "mask", F.round("area", 6).alias("area"))


#: Broken shapes in a box by id % 3: a bow tie, a box with a spike, a box about another drawn the same way.
_BROKEN = (
    [[(0, 0), (1, 1), (1, 0), (0, 1)]],
    [[(0, 0), (1, 0), (1, 1), (0.5, 1), (0.5, 1.5), (0.5, 1), (0, 1)]],
    [[(0, 0), (1, 0), (1, 1), (0, 1)], [(0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75)]],
)


@query(f"""WITH {SQL['a']} SELECT id, CASE WHEN id % 3 = 1 THEN 1 ELSE 2 END::INT AS n_rings, round((maxx - minx) * (maxy - miny) * CASE id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1 ELSE 0.75 END, 6) AS area,
  id % 3 = 2 AS sound, TRUE AS repaired FROM a""")
def repaired_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bow ties, spikes and holes drawn the wrong way, made sound."""
    of = " ".join(f"WHEN {k} THEN {_rings(rings)}" for k, rings in enumerate(_BROKEN))
    broken = spread(base_boxes(spark, sf_dir)).selectExpr("id", f"CASE CAST(id % 3 AS INT) {of} END AS parts")
    made = S.repaired_and_checked(broken)
    return made.select("id", F.size("parts").alias("n_rings"), F.round("area", 6).alias("area"), "sound", "repaired")


@query(f"""WITH {SQL['a']}, c AS (SELECT DISTINCT id % 3 AS layer, x, y FROM (SELECT id, y, unnest(range(minx::BIGINT, maxx::BIGINT)) AS x, miny, maxy FROM (SELECT *, unnest(range(miny::BIGINT, maxy::BIGINT)) AS y FROM a))),
e AS (SELECT layer, x, y, 0 AS side FROM c UNION ALL SELECT layer, x + 1, y, 0 FROM c UNION ALL SELECT layer, x, y, 1 FROM c UNION ALL SELECT layer, x, y + 1, 1 FROM c),
l AS (SELECT layer, count(*) AS length FROM (SELECT layer, x, y, side FROM e GROUP BY ALL HAVING count(*) = 1) GROUP BY layer)
SELECT layer, count(*)::DOUBLE AS area, any_value(length)::DOUBLE AS length FROM c JOIN l USING (layer) GROUP BY layer""")
def dissolved_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area and boundary of the union of all boxes of each of three layers."""
    boxes = spread(base_boxes(spark, sf_dir)).selectExpr("id", f"{_rings(_SHAPES[1][:1])} AS parts", "id % 3 AS layer")
    made = S.dissolved_measures(S.dissolved_boundary(boxes, CELL, ["layer"]), ["layer"])
    return made.select("layer", F.round("area", 6).alias("area"), F.round("length", 6).alias("length"))


# a maze for each 400 orders: from each place of 20 x 20 a step to the right or up
_I = "(o_orderkey % 400)"
_MAZE = ["CAST(floor(o_orderkey / 400) AS BIGINT) AS maze", f"CAST({_I} % 20 AS DOUBLE) AS x1", f"CAST(floor({_I} / 20) AS DOUBLE) AS y1", f"CAST({_I} % 20 + (o_orderkey * 7 + floor({_I} / 20)) % 3 % 2 AS DOUBLE) AS x2",
         f"CAST(floor({_I} / 20) + 1 - (o_orderkey * 7 + floor({_I} / 20)) % 3 % 2 AS DOUBLE) AS y2"]


@query(f"""WITH RECURSIVE s AS (SELECT row_number() OVER () AS n, {', '.join(_MAZE)} FROM orders),
e AS (SELECT n, maze, x1 AS x, y1 AS y FROM s UNION ALL SELECT n, maze, x2, y2 FROM s),
two AS (SELECT maze, x, y, min(n) AS p, max(n) AS q FROM e GROUP BY ALL HAVING count(*) = 2),
l AS (SELECT p, q FROM two UNION SELECT q, p FROM two),
w AS (SELECT n AS a, n AS b FROM s UNION SELECT w.a, l.q FROM w JOIN l ON w.b = l.p),
c AS (SELECT a AS n, min(b) AS chain FROM w GROUP BY a),
f AS (SELECT chain, maze, x, y FROM e JOIN c USING (n) JOIN s USING (n, maze) GROUP BY ALL HAVING count(*) = 1),
d AS (SELECT chain, min((x, y)) AS p, max((x, y)) AS q FROM f GROUP BY chain)
SELECT maze, count(*) AS n_segments, any_value(p)[1] AS x1, any_value(p)[2] AS y1, any_value(q)[1] AS x2, any_value(q)[2] AS y2 FROM s JOIN c USING (n) JOIN d USING (chain) GROUP BY chain, maze""")
def merged_mazes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps put together where just two meet: each line's steps and ends."""
    steps = table(spark, sf_dir, "orders").selectExpr(*_MAZE)
    lines = C.chains(steps, ["maze"]).groupBy("maze", "chain").agg(
        F.count(F.lit(1)).alias("n_segments"), F.min_by(F.struct("x1", "y1"), "place").alias("p"), F.max_by(F.struct("x2", "y2"), "place").alias("q")
    )
    return lines.select("maze", "n_segments", "p.x1", "p.y1", F.col("q.x2").alias("x2"), F.col("q.y2").alias("y2"))
