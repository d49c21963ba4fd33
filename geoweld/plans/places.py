"""Queries of attribute assignment, catalogs of areas, contexts and tiled jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweld.functions.text import decay_weight
from geoweld.operators import assignment as A
from geoweld.operators import catalog as C
from geoweld.operators import matching as M
from geoweld.operators import ranking as K
from geoweld.operators.components import checkpointed
from geoweld.operators.naming import first_rows
from geoweld.plans.derived import CELL, SQL, base_boxes, base_segments, other_boxes, other_segments
from geoweld.plans.more import _covered
from geoweld.plans.registry import query, table
from geoweld.plans.spatial import _FUSED, _LINES


@query(f"""WITH {SQL['sa']}, {SQL['sb']}, {_covered('c', 2.0)}, m AS (SELECT id, max_by(b_id, (hi - lo, -b_id)) AS original, max(hi - lo) AS share FROM c GROUP BY id)
SELECT sb.id, CASE WHEN share > 0 THEN original END AS original, CASE WHEN share > 0 THEN (original % 7)::VARCHAR ELSE 'new' END AS class, round(greatest(share, 0) + 0.0, 6) AS share FROM sb LEFT JOIN m USING (id)""")
def carried_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplement with the attribute of the base line that lies along most of it."""
    base = base_segments(spark, sf_dir).withColumn("class", (F.col("id") % 7).cast("string"))
    return A.carried_attributes(other_segments(spark, sf_dir), base, CELL, 2.0, "class").withColumn("share", F.round("share", 6))


@query(f"""{_LINES} SELECT a_id, b_id, CASE WHEN haus <= 15 THEN 1 ELSE 2 END AS label FROM c WHERE haus <= 15 OR (len > 0.2 AND angle < 45)""")
def labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by the older two-step rule."""
    return A.labelled_pairs(base_segments(spark, sf_dir), other_segments(spark, sf_dir), CELL)


@query(f"""WITH {SQL['sa']}, {SQL['sb']}, {_covered('c', 6.0)} SELECT DISTINCT id FROM c WHERE hi - lo >= 1 - 1e-9 AND own < long""")
def contained_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.contained_duplicates(other_segments(spark, sf_dir), base_segments(spark, sf_dir), CELL, 6.0)


@query(f"""WITH {SQL['a']}, {SQL['b']}, w AS (SELECT id, minx + 1 AS minx, miny + 1 AS miny, maxx - 3 AS maxx, maxy - 3 AS maxy FROM b WHERE maxx - minx > 4)
SELECT w.id, min_by(a.id, ((a.maxx - a.minx) * (a.maxy - a.miny), a.id)) AS area_id, min((a.maxx - a.minx) * (a.maxy - a.miny)) AS size FROM w JOIN a ON a.minx <= w.minx AND a.miny <= w.miny AND a.maxx >= w.maxx AND a.maxy >= w.maxy GROUP BY w.id""")
def least_covering_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest area of a catalog that covers each window."""
    w = other_boxes(spark, sf_dir).where("maxx - minx > 4").withColumns({"minx": F.col("minx") + 1, "miny": F.col("miny") + 1, "maxx": F.col("maxx") - 3, "maxy": F.col("maxy") - 3})
    return A.least_covering(base_boxes(spark, sf_dir), w.select("id", "minx", "miny", "maxx", "maxy"), CELL)


@query(f"WITH {SQL['a']} SELECT count(*) AS n, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM a WHERE minx <= 150 AND maxx >= 50 AND miny <= 250 AND maxy >= 150")
def dissolved_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.dissolved_bounds(base_boxes(spark, sf_dir), (50.0, 150.0, 150.0, 250.0))


@query("""SELECT 'p' || c_custkey AS place_id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'poi' ELSE lower(c_mktsegment) END AS category, (c_custkey % 180)::DOUBLE AS lon, (c_custkey % 90)::DOUBLE AS lat FROM customer WHERE c_custkey % 5 > 0""")
def places_of_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON records as points."""
    k = F.col("c_custkey")
    where = F.struct((k % 90).cast("double").alias("latitude"), F.when(k % 5 > 0, (k % 180).cast("double")).alias("longitude"))
    types = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lower("c_mktsegment"), F.lit("x")))
    record = F.to_json(F.struct(F.concat(F.lit("p"), k).alias("id"), F.struct(F.col("c_name").alias("text")).alias("displayName"), types.alias("types"), where.alias("location")))
    return A.places_of_json(table(spark, sf_dir, "customer").select(record.alias("record")), "record")


@query("""WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 0 THEN o_orderdate END AS seen FROM orders), d AS (SELECT o_orderkey, seen, greatest(0, (epoch_us(TIMESTAMP '2000-01-01') - epoch_us(seen)) / 86400000000) AS age FROM a)
SELECT o_orderkey, seen AS "at", CASE WHEN seen IS NOT NULL THEN round(age, 6) END AS age_days, CASE WHEN seen IS NOT NULL THEN round(0.5 ** (age / 365), 6) END AS weight FROM d""")
def record_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO times of records, their age and what they weigh by it."""
    text = F.when(F.col("o_orderkey") % 9 > 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon")
    made = A.ages(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), "text", "2000-01-01")
    return made.select("o_orderkey", "at", F.round("age_days", 6).alias("age_days"), F.round(F.when(F.col("at").isNotNull(), decay_weight(F.col("age_days"), 365.0)), 6).alias("weight"))


@query("""WITH r(metric, bound) AS (VALUES ('coverage', 0.8::DOUBLE), ('source_coverage', 0.9::DOUBLE)), l AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'partial_source' ELSE 'external_uncontrollable' END AS level FROM supplier)
SELECT s_suppkey, metric, CASE WHEN metric = 'source_coverage' AND level <> 'none' THEN NULL ELSE bound * CASE level WHEN 'none' THEN 1 WHEN 'partial_source' THEN 0.75 ELSE 0.5 END END AS bound FROM l, r""")
def adapted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules as they hold under each run's degradation."""
    rules = spark.createDataFrame([("coverage", 0.8), ("source_coverage", 0.9)], "metric string, bound double")
    k = F.col("s_suppkey") % 3
    level = F.when(k == 0, "none").when(k == 1, "partial_source").otherwise("external_uncontrollable")
    runs = table(spark, sf_dir, "supplier").select("s_suppkey", level.alias("level")).crossJoin(F.broadcast(rules))
    return runs.select("s_suppkey", "metric", A.adapted_rules(rules, F.col("level"), {"partial_source": 0.75, "external_uncontrollable": 0.5}).alias("bound"))


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS t FROM lineitem), f AS (SELECT DISTINCT o_custkey AS s, o_orderstatus AS t FROM orders)
SELECT 'supplier' AS kind, 'node' AS what, count(*) AS n, count(*) FILTER (s_suppkey IN (SELECT s FROM e)) AS connected FROM supplier
UNION ALL SELECT 'part', 'node', count(*), count(*) FILTER (p_partkey IN (SELECT t FROM e)) FROM part UNION ALL SELECT 'customer', 'node', count(*), count(*) FILTER (c_custkey IN (SELECT s FROM f)) FROM customer
UNION ALL SELECT 'supplies', 'edge', count(*), NULL FROM e UNION ALL SELECT 'orders', 'edge', count(*), NULL FROM f""")
def overview_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges of the tables as a graph, by kind."""
    named = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    supplies = table(spark, sf_dir, "lineitem").select(named("supplier", "l_suppkey").alias("s"), named("part", "l_partkey").alias("t"))
    orders = table(spark, sf_dir, "orders").select(named("customer", "o_custkey").alias("s"), named("status", "o_orderstatus").alias("t"))
    nodes = {"supplier": "s_suppkey", "part": "p_partkey", "customer": "c_custkey"}
    return A.overview_graph({k: (table(spark, sf_dir, k), c) for k, c in nodes.items()}, {"supplies": (supplies, "s", "t"), "orders": (orders, "s", "t")})


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS pattern, l_partkey AS algorithm, l_returnflag AS t FROM lineitem)
SELECT pattern, count(DISTINCT algorithm) AS algorithms, count(DISTINCT t) AS types, round(avg(p_size / 50), 6) AS fit, s_name AS name FROM s JOIN part ON p_partkey = algorithm JOIN supplier ON s_suppkey = pattern GROUP BY pattern, s_name ORDER BY s_acctbal DESC, pattern LIMIT 5""".replace("GROUP BY pattern, s_name ", "GROUP BY pattern, s_name, s_acctbal "))
def pattern_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a planner is told of the best patterns: their algorithms, types and fit."""
    best = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pattern"), F.col("s_name").alias("name"), "s_acctbal")
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("pattern"), F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("t")).distinct()
    top = steps.select("pattern").distinct().join(best, "pattern").orderBy(F.desc("s_acctbal"), "pattern").limit(5)
    joined = steps.join(F.broadcast(top), "pattern").join(table(spark, sf_dir, "part"), "p_partkey")
    return joined.groupBy("pattern", "name").agg(F.count_distinct("p_partkey").alias("algorithms"), F.count_distinct("t").alias("types"), F.round(F.avg(F.col("p_size") / 50), 6).alias("fit"))


@query("""WITH n AS (SELECT 'part' AS kind, 'p' || p_partkey AS key, p_name AS text FROM part UNION SELECT 'brand', 'b' || p_brand, p_brand FROM part UNION SELECT 'customer', 'c' || c_custkey, c_mktsegment || ' ' || c_name FROM customer UNION SELECT 'supplier', 's' || s_suppkey, s_name FROM supplier),
h AS (SELECT kind, key, contains(lower(text), 'furniture')::INT + contains(lower(text), 'cold')::INT + contains(lower(text), '00001')::INT AS hits FROM n) SELECT * FROM h WHERE hits > 0 ORDER BY hits DESC, key LIMIT 25""")
def knowledge_search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of four kinds with the most of a question's words."""
    part, customer, supplier = (table(spark, sf_dir, t) for t in ("part", "customer", "supplier"))
    node = lambda df, kind, letter, key, text: df.select(F.lit(kind).alias("kind"), F.concat(F.lit(letter), F.col(key).cast("string")).alias("key"), text.alias("text"))
    nodes = node(part, "part", "p", "p_partkey", F.col("p_name")).union(node(part, "brand", "b", "p_brand", F.col("p_brand")))
    nodes = nodes.union(node(customer, "customer", "c", "c_custkey", F.concat_ws(" ", "c_mktsegment", "c_name"))).union(node(supplier, "supplier", "s", "s_suppkey", F.col("s_name"))).distinct()
    return C.token_search(nodes, "text", "Furniture cold 00001", "key", 25).select("kind", "key", "hits")


@query("""WITH c AS (SELECT user_id, event_type, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS place, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, '>' ORDER BY place, n DESC, event_type) AS strategies FROM c GROUP BY 1""")
def recovery_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strategies of each run in the order in which they are tried."""
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    placed = F.struct(K.custom_order(F.col("event_type"), ["view", "click"]).alias("place"), (-F.col("n")).alias("least"), "event_type")
    return c.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(placed)), lambda x: x["event_type"]), ">").alias("strategies"))


@query("""SELECT s_nationkey AS region, s_suppkey AS raster FROM supplier WHERE s_acctbal > 2000 QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY contains(s_name, s_nationkey::VARCHAR) DESC, length(s_name), s_name, s_suppkey) = 1""")
def raster_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster of each region: of those there are, one that names the region before others."""
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 2000")
    names_it = F.contains("s_name", F.col("s_nationkey").cast("string"))
    best = first_rows(s, ["s_nationkey"], [names_it.desc(), F.length("s_name"), "s_name", "s_suppkey"])
    return best.select(F.col("s_nationkey").alias("region"), F.col("s_suppkey").alias("raster"))


@query(f"""{_FUSED}, t AS (SELECT id, floor((minx + maxx) / 200)::BIGINT AS tx, floor((miny + maxy) / 200)::BIGINT AS ty FROM a)
SELECT tx, ty, count(*) AS n, count(m.b_id) AS matched FROM t LEFT JOIN m ON m.a_id = t.id GROUP BY 1, 2""")
def tiled_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings and matches of each tile, by a building's middle; the join itself needs no tiles."""
    a = base_boxes(spark, sf_dir)
    matches = checkpointed(M.two_pass_matches(M.similar_boxes(a, other_boxes(spark, sf_dir), CELL), 0.3).select(F.col("a_id").alias("id"), "b_id"))
    tile = lambda low, high: F.floor((F.col(low) + F.col(high)) / 200)
    owned = a.select("id", tile("minx", "maxx").alias("tx"), tile("miny", "maxy").alias("ty"))
    return owned.join(matches, "id", "left").groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"), F.count("b_id").alias("matched"))


@query("""WITH k AS (SELECT p_partkey % 10 AS k FROM part) SELECT count(*) AS n, count(*) FILTER (k < 3) AS invalid, count(*) FILTER (k = 3) AS slivers, round(count(*) FILTER (k < 3) / count(*), 6) AS invalid_rate FROM k""")
def ring_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open, short and empty rings, and slivers."""
    k = F.col("p_partkey") % 10
    point = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    ring = lambda *xy: F.array(F.array(*(point(*p) for p in xy)))
    parts = F.when(k == 0, ring((0, 0), (1, 1), (0, 0))).when(k == 1, ring((0, 0), (4, 0), (4, 4), (0, 4))).when(k == 2, ring((0, 0), (4, 0), (8, 0), (0, 0))).when(k == 3, ring((0, 0), (0.5, 0), (0.5, 0.5), (0, 0))).otherwise(ring((0, 0), (4, 0), (4, 4), (0, 0)))
    return A.ring_faults(table(spark, sf_dir, "part").select(parts.alias("parts")))
