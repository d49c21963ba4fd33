"""Aggregates, windows, rankings, set operations, scalars, catalog and stream queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoweld.functions import geometry as G
from geoweld.functions import text as S
from geoweld.operators import catalog as C
from geoweld.operators import quality as Q
from geoweld.operators import relational as R
from geoweld.operators.relational import exact_quantiles
from geoweld.operators.grid_join import best_per
from geoweld.operators.tiling import partition_bbox
from geoweld.plans.derived import CELL, SQL, base_boxes, base_segments, other_boxes
from geoweld.plans.registry import query, table
from geoweld.streaming import events as E

# --- quality and aggregates ----------------------------------------------------


@query("""WITH f AS (UNPIVOT (SELECT c_name::VARCHAR AS c_name, c_mktsegment::VARCHAR AS c_mktsegment, CASE WHEN c_custkey % 7 = 0 THEN ' None ' ELSE c_name END AS maybe FROM customer) ON c_name, c_mktsegment, maybe INTO NAME field VALUE v)
SELECT field, count(*) AS n_rows, count(x) AS n_filled, round(1 - count(x) / count(*), 6) AS null_rate, count(DISTINCT x) AS n_distinct
FROM (SELECT field, CASE WHEN lower(trim(v)) IN ('', 'nan', 'none', '<na>', 'null') THEN NULL ELSE trim(v) END AS x FROM f) GROUP BY field""")
def field_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("maybe", F.when(F.col("c_custkey") % 7 == 0, " None ").otherwise(F.col("c_name")))
    return Q.field_quality(c, ["c_name", "c_mktsegment", "maybe"])


@query("""WITH n AS (SELECT l_suppkey, count(*) AS v FROM lineitem GROUP BY 1), r AS (SELECT v, row_number() OVER (ORDER BY v) AS i FROM n)
SELECT round(2 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1) / count(*), 6) AS gini FROM r""")
def source_gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.gini(table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("v")), "v")


@query("SELECT round(1 - count(DISTINCT (l_orderkey, l_linenumber)) / count(*), 6) AS rate, count(*) AS n_rows FROM lineitem")
def duplicate_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.duplicate_rate(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query(f"WITH {SQL['a']} SELECT round(sum((maxx - minx) * (maxy - miny)) / 1e6, 6) AS area_km2, count(*) AS n, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM a")
def layer_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, rows and bounds of a layer."""
    return base_boxes(spark, sf_dir).agg(
        F.round(F.sum(G.box_area(G.box())) / 1e6, 6).alias("area_km2"), F.count(F.lit(1)).alias("n"),
        F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"),
    )


@query("""SELECT p_brand, round(quantile_cont(p_retailprice, 0.5), 6) AS p50, round(quantile_cont(p_retailprice, 0.95), 6) AS p95, round(avg(p_size), 6) AS mean_size FROM part GROUP BY p_brand""")
def percentiles_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    sizes = part.groupBy("p_brand").agg(F.round(F.avg("p_size"), 6).alias("mean_size"))
    ranks = exact_quantiles(part, "p_retailprice", (0.5, 0.95), ["p_brand"])
    return sizes.join(ranks, "p_brand").select("p_brand", F.round("q0", 6).alias("p50"), F.round("q1", 6).alias("p95"), "mean_size")


@query("""WITH s AS (SELECT unnest(string_split(p_type || ';' || CASE WHEN p_size % 3 = 0 THEN p_brand ELSE '' END, ';')) AS s FROM part)
SELECT trim(s) AS source, count(*) AS n FROM s WHERE trim(s) <> '' GROUP BY 1""")
def per_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = F.concat("p_type", F.lit(";"), F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(""))
    each = table(spark, sf_dir, "part").select(F.explode(F.split(joined, ";")).alias("source")).select(F.trim("source").alias("source"))
    return each.where("source <> ''").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


_RECORDS = """r AS (SELECT event_type AS entity, ts AS seen, value >= 60 AS success, event_id % 4 = 0 AS repaired, 'code ' || (event_id % 5) AS reason FROM events)"""


@query(f"""WITH {_RECORDS}, n AS (SELECT *, 0.5 ** ((epoch_us(max(seen) OVER (PARTITION BY entity)) - epoch_us(seen)) / 86400000000 / 30) AS w FROM r),
g AS (SELECT entity, count(*) AS runs, count(*) FILTER (success) AS successes, count(*) FILTER (repaired) AS repairs, max(seen) AS last_run,
  max_by(reason, (seen, reason)) FILTER (NOT success) AS last_failure, sum(CASE WHEN success THEN w ELSE 0 END) / sum(w) AS score FROM n GROUP BY entity)
SELECT entity, runs, successes, repairs, last_run, last_failure, round(score, 6) AS score, round(greatest(-0.1, least(0.1, (score - 0.5) * 0.2)), 6) AS adjustment FROM g""")
def learning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of each entity with older runs weighing less."""
    records = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("entity"), F.col("ts").alias("at"), (F.col("value") >= 60).alias("success"), (F.col("event_id") % 4 == 0).alias("repaired"), F.concat(F.lit("code "), F.col("event_id") % 5).alias("reason")
    )
    return R.learning_summary(records, "entity")


_T = "CASE n WHEN 2 THEN 12.706 WHEN 3 THEN 4.303 WHEN 4 THEN 3.182 WHEN 5 THEN 2.776 ELSE 1.96 END"


@query(f"""WITH s AS (SELECT s_nationkey, count(s_acctbal) AS n, avg(s_acctbal) AS mean, coalesce(stddev_samp(s_acctbal), 0) AS sd FROM supplier GROUP BY 1)
SELECT s_nationkey, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(CASE WHEN n > 1 THEN {_T} * sd / sqrt(n) ELSE 0 END, 6) AS half_width FROM s""")
def small_sample_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.sample_summary(table(spark, sf_dir, "supplier"), "s_nationkey", "s_acctbal")


@query("""WITH g AS (SELECT event_type, avg((value > 50)::INT) AS p FROM events GROUP BY 1)
SELECT g.event_type, round(2 * asin(sqrt(g.p)) - 2 * asin(sqrt(b.p)), 6) AS h, round(g.p - b.p, 6) AS delta FROM g, g b WHERE b.event_type = 'view'""")
def effect_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohen's h and the difference of each variant's rate against the baseline's."""
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg((F.col("value") > 50).cast("int")).alias("p"))
    b = g.where("event_type = 'view'").select(F.col("p").alias("q"))
    h = 2 * F.asin(F.sqrt("p")) - 2 * F.asin(F.sqrt("q"))
    return g.crossJoin(F.broadcast(b)).select("event_type", F.round(h, 6).alias("h"), F.round(F.col("p") - F.col("q"), 6).alias("delta"))


@query("""WITH v(variant) AS (VALUES ('click'), ('view'), ('absent')), g AS (SELECT event_type, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1)
SELECT variant, coalesce(n, 0) AS n, round(mean, 6) AS mean, CASE WHEN n IS NULL THEN 'skipped' ELSE 'evaluated' END AS status FROM v LEFT JOIN g ON variant = event_type""")
def ablation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed list of variants; those without a run are told as skipped."""
    variants = spark.createDataFrame([("click",), ("view",), ("absent",)], "variant string")
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    status = F.when(F.col("n").isNull(), "skipped").otherwise("evaluated")
    return variants.join(g, F.col("variant") == F.col("event_type"), "left").select("variant", F.coalesce("n", F.lit(0)).alias("n"), F.round("mean", 6).alias("mean"), status.alias("status"))


@query("""SELECT p_name AS name, count(*) AS n, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS layers, min(p_size) AS low, max(p_size) AS high FROM part GROUP BY 1""")
def name_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("layers"), F.min("p_size").alias("low"), F.max("p_size").alias("high")
    )


@query("""WITH rules(metric, op, bound) AS (VALUES ('n', 'gte', 100.0), ('mean', 'lt', 50.0), ('low', 'eq', 0.01), ('none', 'gt', 1.0)),
m AS (SELECT event_type, count(*)::DOUBLE AS n, avg(value) AS mean, min(value) AS low FROM events GROUP BY 1),
x AS (SELECT event_type, metric, op, bound, CASE metric WHEN 'n' THEN n WHEN 'mean' THEN mean WHEN 'low' THEN low END AS v FROM m, rules)
SELECT event_type, metric, CASE op WHEN 'eq' THEN v IS NOT DISTINCT FROM bound WHEN 'gte' THEN coalesce(v >= bound, FALSE) WHEN 'lt' THEN coalesce(v < bound, FALSE) ELSE coalesce(v > bound, FALSE) END AS passed FROM x""")
def threshold_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each group against a table of rules."""
    m = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"))
    rules = spark.createDataFrame([("n", "gte", 100.0), ("mean", "lt", 50.0), ("low", "eq", 0.01), ("none", "gt", 1.0)], "metric string, op string, bound double")
    v = F.create_map(*(x for c in ("n", "mean", "low") for x in (F.lit(c), F.col(c))))
    x = m.select("event_type", v.alias("v")).crossJoin(F.broadcast(rules))
    return x.select("event_type", "metric", R.compared(F.try_element_at("v", F.col("metric")), F.col("op"), F.col("bound")).alias("passed"))


@query("""WITH e AS (SELECT user_id, list_sort(list_distinct(list(event_type) FILTER (value > 100))) AS found, list_sort(list_distinct(list(event_type) FILTER (event_id % 3 = 0))) AS expected FROM events GROUP BY 1),
n AS (SELECT user_id, coalesce(len(found), 0) AS f, coalesce(len(expected), 0) AS x, coalesce(len(list_intersect(found, expected)), 0) AS h FROM e),
p AS (SELECT user_id, CASE WHEN f > 0 THEN h / f WHEN x = 0 THEN 1 ELSE 0 END AS p, CASE WHEN x > 0 THEN h / x ELSE 1 END AS r FROM n)
SELECT user_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM p""")
def set_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.collect_set(F.when(F.col("value") > 100, F.col("event_type"))).alias("found"), F.collect_set(F.when(F.col("event_id") % 3 == 0, F.col("event_type"))).alias("expected")
    )
    return e.select("user_id", *(c.alias(k) for k, c in R.set_metrics(F.col("expected"), F.col("found")).items()))


@query("""SELECT user_id, count(*) AS calls, count(*) FILTER (value > 5) AS successes, sum(event_id)::BIGINT AS tokens, count(DISTINCT event_type) AS signatures,
  bool_and(value > 5) AND count(DISTINCT event_type) = 1 AS stable FROM events GROUP BY 1""")
def grouped_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("value") > 5
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(ok).alias("successes"), F.sum("event_id").alias("tokens"), F.count_distinct("event_type").alias("signatures"),
        (F.bool_and(ok) & (F.count_distinct("event_type") == 1)).alias("stable"),
    )


@query("""SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, bool_or(event_type = 'purchase') AS bought, round(avg(value), 6) AS mean, round(count(*) FILTER (event_type = 'click') / count(*), 6) AS click_rate,
  max_by(event_type, (ts, event_id)) AS last_type, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY 1""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence, rates and sums of each run's events."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(kind == "error").alias("errors"), F.bool_or(kind == "purchase").alias("bought"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.count_if(kind == "click") / F.count(F.lit(1)), 6).alias("click_rate"),
        F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.sum(F.from_json("props", "k long")["k"]).alias("k"),
    )


@query("""WITH d AS (UNPIVOT (SELECT o_orderstatus, count(*)::DOUBLE AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) ON n, total INTO NAME k VALUE v) SELECT k, round(sum(v), 2) AS v FROM d GROUP BY k""")
def merged_tile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the tiles added up by name."""
    tiles = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).cast("double").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return tiles.unpivot("o_orderstatus", ["n", "total"], "k", "v").groupBy("k").agg(F.round(F.sum("v"), 2).alias("v"))


# --- windows, rankings, sets -----------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) = 1")
def first_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_per(table(spark, sf_dir, "lineitem"), "l_orderkey", F.desc("l_extendedprice"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH o AS (SELECT l_orderkey, l_partkey::DOUBLE AS x, l_suppkey::DOUBLE AS y, row_number() OVER w AS i, lag(l_partkey) OVER w AS px, lag(l_suppkey) OVER w AS py, lead(l_partkey) OVER w AS nx, lead(l_suppkey) OVER w AS ny
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate)),
v AS (SELECT *, (px - x) * (nx - x) + (py - y) * (ny - y) AS dot, sqrt((px - x) ** 2 + (py - y) ** 2) * sqrt((nx - x) ** 2 + (ny - y) ** 2) AS len FROM o WHERE px IS NOT NULL AND nx IS NOT NULL)
SELECT l_orderkey, i::INT AS i, round(CASE WHEN len > 0 THEN degrees(acos(greatest(-1, least(1, dot / len)))) ELSE 180 END, 4) AS angle FROM v""")
def vertex_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn at each inner vertex of a polyline."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    x, y = F.col("l_partkey").cast("double"), F.col("l_suppkey").cast("double")
    at = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(w).alias("i"), x.alias("x"), y.alias("y"), F.lag(x).over(w).alias("px"), F.lag(y).over(w).alias("py"), F.lead(x).over(w).alias("nx"), F.lead(y).over(w).alias("ny"))
    angle = G.turn_angle(*map(F.col, ("px", "py", "x", "y", "nx", "ny")))
    return at.where("px IS NOT NULL AND nx IS NOT NULL").select("l_orderkey", "i", F.round(angle, 4).alias("angle"))


@query("SELECT p_type, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) <= 3")
def top_three_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k(table(spark, sf_dir, "part"), 3, F.desc("p_retailprice"), F.asc("p_partkey"), per=["p_type"]).select("p_type", "p_partkey", "p_retailprice")


_SCORE = "round(greatest(0, least(1, 0.4 * least(1, p_size / 50) + 0.4 * least(1, p_retailprice / 2000) + 0.2 * (p_partkey % 10) / 10 - least(0.3, 0.1 * (p_partkey % 4)))), 6)"


@query(f"SELECT p_partkey, {_SCORE} AS score FROM part ORDER BY score DESC, p_partkey LIMIT 50")
def retrieval_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = R.retrieval_score(F.col("p_size") / 50, F.col("p_retailprice") / 2000, (F.col("p_partkey") % 10) / 10, F.col("p_partkey") % 4)
    return R.top_k(table(spark, sf_dir, "part").select("p_partkey", score.alias("score")), 50, F.desc("score"), F.asc("p_partkey"))


@query("""WITH c AS (SELECT s_nationkey, s_suppkey, round(s_acctbal / 10000, 4) AS confidence FROM supplier),
r AS (SELECT *, row_number() OVER w AS i, lead(confidence) OVER w AS nxt FROM c WINDOW w AS (PARTITION BY s_nationkey ORDER BY confidence DESC, s_suppkey))
SELECT s_nationkey, s_suppkey, confidence, CASE WHEN nxt IS NULL THEN 'single_candidate' WHEN confidence - nxt >= 0.1 THEN 'top_confidence_margin' ELSE 'ambiguous' END AS reason FROM r WHERE i = 1""")
def candidate_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.round(F.col("s_acctbal") / 10000, 4).alias("confidence"))
    return R.with_margin(c, "s_nationkey", "confidence", "s_suppkey")


@query("""SELECT o_custkey AS id, o_orderkey AS version, o_totalprice AS price, o_orderstatus = 'F' AS changed FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""")
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders are the changes to the others; of a customer's the newest stays."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("price"), (F.col("o_orderstatus") == "F").alias("changed"))
    return R.upserted(o.where("NOT changed"), o.where("changed"), "id", "version")


@query("""WITH l AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer), r AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN -c_custkey ELSE c_custkey END AS k, CASE WHEN c_custkey % 3 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS v FROM customer)
SELECT coalesce(l.k, r.k) AS k, l.v AS left_value, r.v AS right_value FROM l FULL JOIN r ON l.k = r.k WHERE l.v IS DISTINCT FROM r.v""")
def run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    changed = c.select(F.when(F.col("k") % 7 == 0, -F.col("k")).otherwise(F.col("k")).alias("k"), F.when(F.col("k") % 3 == 0, "CHANGED").otherwise(F.col("v")).alias("v"))
    return R.keyed_diff(c, changed, "k", "v")


@query("""WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 'x' ELSE (c_custkey * 3)::VARCHAR END AS raw FROM customer), t AS (SELECT *, TRY_CAST(raw AS BIGINT) AS id FROM n)
SELECT c_custkey, id FROM t WHERE id IS NOT NULL UNION ALL SELECT c_custkey, (SELECT max(id) FROM t) + row_number() OVER (ORDER BY c_custkey) FROM t WHERE id IS NULL""")
def minted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    raw = F.when(key % 4 == 0, None).when(key % 4 == 1, "x").otherwise((key * 3).cast("string"))
    return R.with_minted_ids(table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw")), "raw", ["c_custkey"]).select("c_custkey", "id")


# --- scalars -----------------------------------------------------------------------


@query("""SELECT s_suppkey, CASE WHEN s_acctbal IS NULL THEN NULL WHEN h = 3 THEN 3.2 WHEN h < 2.5 THEN 3.0 ELSE round(h, 2) END AS height,
  CASE WHEN d <= 0.05 THEN 'small' WHEN d <= 1.0 THEN 'medium' ELSE 'large' END AS bucket, least(3600.0, 60 * 2.0 ** (s_suppkey % 9)) AS delay,
  greatest(1, least(60, floor((lon + 180) / 6)::INT + 1)) AS zone, CASE WHEN lat >= 0 THEN 'EPSG:326' ELSE 'EPSG:327' END || lpad((greatest(1, least(60, floor((lon + 180) / 6)::INT + 1)))::VARCHAR, 2, '0') AS crs,
  round(radians(lon) * 6378137.0, 4) AS mx, round(ln(tan(radians(lat) / 2 + pi() / 4)) * 6378137.0, 4) AS my
FROM (SELECT *, (s_suppkey % 80) / 10 AS h, (s_suppkey % 30) / 20 AS d, (s_suppkey * 37 % 3600) / 10 - 180 AS lon, (s_suppkey * 53 % 1600) / 10 - 80 AS lat FROM supplier)""")
def scalar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height remap, buckets, retry delays, UTM zones and Mercator coordinates."""
    k = F.col("s_suppkey")
    lon, lat = (k * 37 % 3600) / 10 - 180, (k * 53 % 1600) / 10 - 80
    mx, my = G.to_mercator(lon, lat)
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", S.remapped_height((k % 80) / 10).alias("height"), S.area_bucket((k % 30) / 20).alias("bucket"), S.retry_delay(k % 9 + 1).alias("delay"),
        G.utm_zone(lon).alias("zone"), G.utm_code(lon, lat).alias("crs"), F.round(mx, 4).alias("mx"), F.round(my, 4).alias("my"),
    )


@query(f"""WITH {SQL['sa']}, l AS (SELECT *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS len FROM sa)
SELECT id, round(len, 6) AS len, round((degrees(atan2(y2 - y1, x2 - x1)) + 360) % 180, 6) AS bearing FROM l""")
def segment_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoweld.operators.lines import length, segment

    return base_segments(spark, sf_dir).select("id", F.round(length(segment()), 6).alias("len"), F.round(G.bearing(*segment()), 6).alias("bearing"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'ring|widget') AND p_size < 25 THEN 'drop' WHEN regexp_matches(p_name, 'gear|bolt') THEN 'review' ELSE 'keep' END AS action,
  least(3, greatest(0, CASE WHEN p_size < 10 THEN 3 WHEN p_size < 20 THEN 2 WHEN p_size < 30 THEN 1 ELSE 0 END)) + CASE WHEN p_retailprice > 1500 THEN 2 WHEN p_retailprice > 1000 THEN 1 ELSE 0 END AS points FROM part""")
def cleaning_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered text rules and points by size and price."""
    name, size, price = F.col("p_name"), F.col("p_size"), F.col("p_retailprice")
    action = F.when(name.rlike("ring|widget") & (size < 25), "drop").when(name.rlike("gear|bolt"), "review").otherwise("keep")
    points = F.when(size < 10, 3).when(size < 20, 2).when(size < 30, 1).otherwise(0) + F.when(price > 1500, 2).when(price > 1000, 1).otherwise(0)
    return table(spark, sf_dir, "part").select("p_partkey", action.alias("action"), points.alias("points"))


@query(f"""WITH {SQL['a']}, {SQL['b']}, p AS (SELECT minx AS x, miny AS y, height % 7 AS v FROM b), n AS (SELECT a.id, v, count(*) AS n FROM a JOIN p ON x BETWEEN minx AND maxx AND y BETWEEN miny AND maxy WHERE v > 0 AND v <> 6 GROUP BY 1, 2)
SELECT id, sum(n)::BIGINT AS n, min(v) AS low, max(v) AS high, max_by(v, (n, v)) AS dominant FROM n GROUP BY id""")
def zonal_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels, one at each box's corner, within the boxes of the other layer; 6 means no data."""
    pixels = other_boxes(spark, sf_dir).select(F.col("minx").alias("x"), F.col("miny").alias("y"), (F.col("height") % 7).alias("value"))
    return Q.zonal_statistics(base_boxes(spark, sf_dir), pixels, CELL, 6.0).withColumnRenamed("a_id", "id")


@query(f"""WITH {SQL['a']}, m AS (SELECT min(minx) AS x1, min(miny) AS y1, max(maxx) AS x2, max(maxy) AS y2 FROM a), t AS (SELECT *, unnest(range(ceil((x2 - x1) / 150)::BIGINT)) AS c FROM m), u AS (SELECT *, unnest(range(ceil((y2 - y1) / 150)::BIGINT)) AS r FROM t)
SELECT format('tile_{{:03d}}_{{:03d}}', r, c) AS tile_id, x1 + c * 150 AS minx, least(x1 + c * 150 + 150, x2) AS maxx, y1 + r * 150 AS miny, least(y1 + r * 150 + 150, y2) AS maxy,
  greatest(x1 + c * 150 - 64, x1) AS bminx, least(least(x1 + c * 150 + 150, x2) + 64, x2) AS bmaxx FROM u""")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles of a layer's bounds."""
    m = base_boxes(spark, sf_dir).agg(F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy")).first()
    t = partition_bbox(spark, tuple(m), 150.0)
    return t.select("tile_id", "minx", "maxx", "miny", "maxy", F.col("buffered.minx").alias("bminx"), F.col("buffered.maxx").alias("bmaxx"))


# --- catalog ---------------------------------------------------------------------------


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.concat(F.lit("t"), F.col("p_partkey") % 97).alias("source"), F.concat(F.lit("t"), (F.col("p_partkey") * 7 + F.col("p_size")) % 97).alias("target"))


_EDGES = "e AS (SELECT DISTINCT 't' || (p_partkey % 97) AS source, 't' || ((p_partkey * 7 + p_size) % 97) AS target FROM part)"


@query(f"""WITH RECURSIVE {_EDGES}, w AS (SELECT 0 AS depth, 't1' AS node, ['t1'] AS path UNION ALL SELECT depth + 1, target, list_append(path, target) FROM w JOIN e ON node = source WHERE depth < 3 AND NOT list_contains(path, target))
SELECT depth, array_to_string(path, '>') AS path FROM w WHERE node = 't60' ORDER BY depth, w.path LIMIT 1""")
def transform_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.transform_paths(_edges(spark, sf_dir), "t1", "t60").select("depth", F.array_join("path", ">").alias("path"))


@query(f"""WITH RECURSIVE {_EDGES}, w AS (SELECT 't60' AS node, 0 AS hops UNION SELECT source, hops + 1 FROM w JOIN e ON node = target WHERE hops < 3) SELECT 't60' AS goal, node, min(hops) AS hops FROM w GROUP BY node""")
def upstream_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.upstream(_edges(spark, sf_dir), spark.createDataFrame([("t60",)], "node string"))


@query("""WITH h AS (SELECT p_partkey, contains(lower(p_name), 'red')::INT + contains(lower(p_name), 'widget')::INT + contains(lower(p_name), 'small')::INT AS hits FROM part) SELECT p_partkey, hits FROM h WHERE hits > 0 ORDER BY hits DESC, p_partkey LIMIT 20""")
def knowledge_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.token_search(table(spark, sf_dir, "part"), "p_name", "red widget small", "p_partkey", 20).select("p_partkey", "hits")


# --- streams --------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' file as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = E.run_available(spark, _stream(spark, sf_dir), lambda s: E.windowed(s, "ts", "event_type", "1 day"), "complete")
    return made.select(F.col("window.start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT (epoch_us(ts) // 60000000)::BIGINT AS minute, count(*) AS n FROM (SELECT * FROM events) GROUP BY 1")
def stream_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events taken in once each by their id, though the stream has them twice."""
    source = _stream(spark, sf_dir)
    twice = source.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    taken = E.run_available(spark, twice, lambda s: E.deduplicated(s, "event_id", "ts", "60 days"), "append")
    return taken.groupBy(F.floor(F.unix_micros("ts") / 60_000_000).alias("minute")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH j AS (SELECT event_id, ts + INTERVAL 1 DAY AS window_ends, ts + to_seconds(least(3600.0, 60 * 2.0 ** (event_id % 8))::INT) AS next_retry FROM events WHERE event_type = 'error')
SELECT event_id, CASE WHEN window_ends <= TIMESTAMP '2024-01-15' THEN 'expired' WHEN next_retry <= TIMESTAMP '2024-01-15' THEN 'due' ELSE 'waiting' END AS state FROM j""")
def retry_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    delay = S.retry_delay(F.col("event_id") % 8 + 1).cast("long")
    jobs = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", F.expr("ts + INTERVAL 1 DAY").alias("window_ends"), F.timestamp_micros(F.unix_micros("ts") + delay * 1_000_000).alias("next_retry"))
    return E.due_and_expired(jobs, "2024-01-15").select("event_id", "state")


@query("""WITH r AS (SELECT user_id AS run_id, max(ts) AS last_seen FROM events GROUP BY 1) SELECT run_id, (epoch(TIMESTAMP '2024-01-31') - epoch(date_trunc('second', last_seen)))::BIGINT AS age FROM r WHERE epoch(TIMESTAMP '2024-01-31') - epoch(date_trunc('second', last_seen)) >= 14400""")
def stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.max("ts").alias("last_seen"))
    return E.stale(runs, "2024-01-31", 14400).select("run_id", "age")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS began, count(*) AS n FROM s GROUP BY user_id, s""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = E.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "6 hours")
    return made.select("user_id", F.col("session.start").alias("began"), "n")
