"""Queries of source normalisation, record rules, heights, rankings and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweld.functions import text as S
from geoweld.operators import catalog as C
from geoweld.operators import ranking as K
from geoweld.operators import records as R
from geoweld.operators import relational as B
from geoweld.operators import stitching as T
from geoweld.operators import summaries as Y
from geoweld.plans.derived import CELL, SQL, base_boxes, base_points, other_boxes, other_points
from geoweld.plans.registry import query, table

# --- columns and profiles ------------------------------------------------------------------


@query("SELECT s_suppkey AS osm_id, s_name AS title, TRY_CAST(CASE WHEN s_suppkey % 4 = 0 THEN 'x' ELSE s_acctbal::VARCHAR END AS DOUBLE) AS height, 'building' AS fclass FROM supplier")
def mapped_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields under their canonical names, required ones checked, defaults added, numbers coerced."""
    raw = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 4 == 0, "x").otherwise(F.col("s_acctbal").cast("string")).alias("h"))
    named = R.renamed(raw, {"osm_id": "s_suppkey", "title": "s_name", "height": "h", "name": ""})
    return R.numbers(R.required(named, ["osm_id"], {"fclass": "building"}), ["height", "absent"])


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN ' nan ' ELSE 'F' || p_partkey END AS f, 'O' || p_partkey AS o, CASE WHEN p_size > 25 THEN p_name END AS n, p_type AS t, CASE WHEN p_size % 3 = 0 THEN 'polygon' ELSE 'point' END AS kind FROM part)
SELECT CASE WHEN trim(f) = 'nan' THEN o ELSE f END AS canonical_id, coalesce(n, t) AS name, t AS category, NULL::DOUBLE AS lon, NULL::DOUBLE AS lat, 'parts' AS source_id, kind FROM p WHERE kind = 'point'""")
def profiled_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source of places in its profile's columns."""
    p = table(spark, sf_dir, "part")
    own = F.when(F.col("p_partkey") % 5 == 0, " nan ").otherwise(F.concat(F.lit("F"), "p_partkey"))
    raw = p.select(own.alias("Source_Feature_ID"), F.concat(F.lit("O"), "p_partkey").alias("osm_id"), F.when(F.col("p_size") > 25, F.col("p_name")).alias("name"), F.col("p_type").alias("full_name"), F.col("p_type").alias("fclass"), F.when(F.col("p_size") % 3 == 0, "polygon").otherwise("point").alias("kind"))
    return R.profiled(raw, R.PROFILES["places"], "parts")


@query("""SELECT CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey::VARCHAR END AS canonical_id, s_name AS name, NULL::VARCHAR AS category, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS height, NULL::DOUBLE AS confidence, 'sup' AS source_id FROM supplier""")
def profiled_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source of buildings whose columns a contract of matched fields names."""
    k = F.col("s_suppkey")
    raw = table(spark, sf_dir, "supplier").select(F.when(k % 3 == 0, "None").otherwise(k.cast("string")).alias("own_key"), F.col("s_name").alias("label"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal").cast("string")).otherwise("n/a").alias("levels_h"))
    contract = {**R.PROFILES["buildings"], "text": {"canonical_id": ["own_key"], "name": ["label"], "category": ["use"]}, "number": {"height": ["levels_h"], "confidence": ["confidence"]}}
    return R.profiled(raw, contract, "sup")


@query(f"""WITH {SQL['a']}, {SQL['b']}, u AS (SELECT id, (maxx - minx) * (maxy - miny) AS area, 'osm' AS source_name, 0 AS source_rank FROM a UNION ALL SELECT id, (maxx - minx) * (maxy - miny), 'ref', 1 FROM b)
SELECT source_name, source_rank, count(*) AS n, sum(area) AS area FROM u WHERE area >= 100 GROUP BY 1, 2""")
def sources_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    layers = [(n, df.select("id", area.alias("area"))) for n, df in (("osm", base_boxes(spark, sf_dir)), ("ref", other_boxes(spark, sf_dir)))]
    return R.by_priority(layers, "area", 100.0).groupBy("source_name", "source_rank").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area"))


@query(f"""WITH {SQL['b']}, c AS (SELECT *, TRY_CAST(CASE WHEN id % 9 = 0 THEN 'x' ELSE ((id % 14) / 10.0)::DOUBLE::VARCHAR END AS DOUBLE) AS v FROM b)
SELECT id, CASE WHEN v BETWEEN 0 AND 1 THEN v ELSE 1 END::DOUBLE AS confidence, CASE WHEN id % 4 = 0 THEN 7.5 ELSE (maxx - minx) * (maxy - miny) END::DOUBLE AS area_in_me, (minx + maxx) / 2 AS longitude, (miny + maxy) / 2 AS latitude FROM c""")
def checked_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    raw = other_boxes(spark, sf_dir).withColumns({"confidence": F.when(i % 9 == 0, "x").otherwise(((i % 14) / 10.0).cast("string")), "area_in_me": F.when(i % 4 == 0, 7.5)})
    x, y = (F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2
    made = R.checked_reference(raw, (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")), x, y)
    return made.select("id", "confidence", "area_in_me", "longitude", "latitude")


@query("""SELECT c_custkey::VARCHAR AS osm_id, 'building' AS fclass, c_name AS name, NULL::VARCHAR AS type, CASE WHEN c_custkey % 3 = 0 THEN 'fused' ELSE 'multi_source' END AS fusion_mode, 'not_required' AS retry_status FROM customer""")
def finalized_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deliverable's columns in order, with defaults for what tells how it was made."""
    raw = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("OSM_ID"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 == 0, "fused").alias("fusion_mode"))
    full = R.with_defaults(raw, {"fusion_mode": "multi_source", "retry_status": "not_required", "fclass": "building"})
    return R.laid_out(full, {"osm_id": "string", "fclass": "string", "name": "string", "type": "string", "fusion_mode": "string", "retry_status": "string"})


@query("""SELECT p_partkey AS osm_id, 'pois:' || p_partkey AS canonical_id, CASE WHEN p_size % 4 = 0 THEN 'pois' ELSE p_brand END AS source_id, CASE WHEN p_size % 5 = 0 THEN '  ' ELSE p_name END AS canonical_name, p_type AS canonical_category FROM part WHERE p_size % 5 <> 0""")
def place_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places with the source they come from; those without a name are left out."""
    size = F.col("p_size")
    raw = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("osm_id"), F.when(size % 4 == 0, " ").otherwise(F.col("p_brand")).alias("source_id"), F.when(size % 5 == 0, "  ").otherwise(F.col("p_name")).alias("name"), F.col("p_type").alias("fclass"))
    return R.named_only(R.with_provenance(raw, "pois"), "canonical_name").select("osm_id", "canonical_id", "source_id", "canonical_name", "canonical_category")


@query("""WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'base' ELSE 'supplement' END AS layer, o_orderkey % 2 = 0 AS residual, CASE WHEN o_orderkey % 3 = 0 THEN 'nan' ELSE 'W' || o_custkey END AS own, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 END AS part,
  CASE WHEN o_orderkey % 7 > 3 THEN o_orderpriority END AS fclass, CASE WHEN o_orderkey % 4 = 1 THEN 'None' ELSE 'R' || o_custkey END AS name FROM orders)
SELECT id, CASE WHEN layer = 'base' THEN 'base_road_network' WHEN residual THEN 'supplement_residual' ELSE 'supplement_road' END AS fusion_source, CASE WHEN layer = 'base' THEN 'base' WHEN residual THEN 'supplement_uncovered_residual' ELSE 'supplement_unmatched' END AS match_role,
  CASE WHEN layer = 'base' THEN '' WHEN own = 'nan' THEN 'S' || id WHEN residual THEN own || '_res' || coalesce(part, 1) ELSE own END AS supplement_segment_id, coalesce(fclass, 'road') AS road_class, CASE WHEN name = 'None' THEN '' ELSE name END AS road_name FROM r""")
def road_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(F.col("o_orderstatus") == "F", "base").otherwise("supplement").alias("layer"), (k % 2 == 0).alias("residual"), F.concat(F.lit("S"), k).alias("segment_id"), F.when(k % 3 == 0, "nan").otherwise(F.concat(F.lit("W"), "o_custkey")).alias("original_id"),
        F.when(k % 5 > 0, k % 5).alias("residual_part"), F.when(k % 7 > 3, F.col("o_orderpriority")).alias("fclass"), F.when(k % 4 == 1, "None").otherwise(F.concat(F.lit("R"), "o_custkey")).alias("name"),
    )
    return R.canonical_roads(raw).select("id", "fusion_source", "match_role", "supplement_segment_id", "road_class", "road_name")


_SIMS = "SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE (p_size / 50.0)::DOUBLE END AS sim_area, ((p_partkey % 100) / 100.0)::DOUBLE AS sim_shape, p_retailprice / 2000 AS sim_overlap FROM part"


@query(f"""WITH s AS ({_SIMS}) SELECT p_partkey, 'accepted' AS side, CASE WHEN sim_shape > 0.8 THEN '1' END AS label FROM s WHERE sim_area >= 0.3 AND sim_shape >= 0.3 AND sim_overlap >= 0.5
UNION ALL SELECT p_partkey, 'refused', CASE WHEN sim_shape > 0.8 THEN '1' END FROM s WHERE coalesce(sim_area < 0.3, FALSE) OR sim_shape < 0.3 OR sim_overlap < 0.5""")
def similarity_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches by three thresholds, and the label of very like ones."""
    k = F.col("p_partkey")
    sims = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 11 != 0, F.col("p_size") / 50.0).alias("sim_area"), ((k % 100) / 100.0).alias("sim_shape"), (F.col("p_retailprice") / 2000).alias("sim_overlap"))
    yes, no = R.split_by_similarity(sims, {"sim_area": 0.3, "sim_shape": 0.3, "sim_overlap": 0.5})
    side = lambda df, name: df.select("p_partkey", F.lit(name).alias("side"), R.match_label(F.col("sim_shape"), 0.8).alias("label"))
    return side(yes, "accepted").union(side(no, "refused"))


@query(f"""WITH {SQL['a']}, {SQL['b']}, {SQL['pairs']}, w AS (SELECT *, count(*) OVER (PARTITION BY a_id) AS n_b, count(*) OVER (PARTITION BY b_id) AS n_a FROM pairs WHERE shared > 0),
c AS (SELECT a_id, min_by(CASE WHEN n_b = 1 AND n_a = 1 THEN '1:1' WHEN n_b > 1 AND n_a = 1 THEN '1:N' WHEN n_b = 1 THEN 'N:1' ELSE 'M:N' END, b_id) AS relation, any_value(a_height) AS own, min_by(b_height, b_id) AS first, avg(b_height) AS mean, count(*) AS n FROM w GROUP BY a_id)
SELECT a_id, relation, round(CASE WHEN relation IN ('1:1', 'N:1') THEN coalesce(first, own) WHEN relation = '1:N' THEN coalesce(CASE WHEN n <= 3 THEN mean END, own) ELSE own END, 6) AS height FROM c""")
def carried_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights carried over by the class of a match."""
    from geoweld.operators import matching as M

    pairs = M.similar_boxes(base_boxes(spark, sf_dir), other_boxes(spark, sf_dir), CELL).where("shared > 0")
    known = M.relation_class(pairs.select("a_id", "b_id", "a_height", "b_height"))
    one = known.groupBy("a_id").agg(F.min_by("relation", "b_id").alias("relation"), F.first("a_height").alias("own"), F.min_by("b_height", "b_id").alias("first"), F.avg("b_height").alias("mean"), F.count(F.lit(1)).alias("n"))
    return one.select("a_id", "relation", F.round(R.carried(F.col("relation"), F.col("own"), F.col("first"), F.col("mean"), F.col("n")), 6).alias("height"))


# --- heights ---------------------------------------------------------------------------------


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'height_obm' WHEN s_suppkey % 3 = 1 THEN 'height_google_v' || s_suppkey ELSE 'height_unknown' END AS field,
  CASE WHEN s_suppkey % 4 = 0 THEN 'estimated_height' WHEN s_suppkey % 4 = 1 THEN 'presence_only' WHEN s_suppkey % 4 = 2 THEN 'estimated_height' ELSE 'unknown' END AS semantics FROM supplier""")
def height_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.when(k % 3 == 0, "OpenBuildingMap").when(k % 3 == 1, F.concat(F.lit(" Google--v"), k)).otherwise("--")
    columns = F.when(k % 4 == 0, F.array(F.lit("HEIGHT"))).otherwise(F.array(F.lit("other")))
    band = F.when(k % 4 == 1, "Building presence").when(k % 4 == 2, "building height").otherwise(None)
    return table(spark, sf_dir, "supplier").select("s_suppkey", R.height_column(name).alias("field"), R.height_semantics(F.lit("tiles"), columns, band).alias("semantics"))


@query("""WITH h AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size - 25.0 END AS r, CASE WHEN p_partkey % 4 < 2 THEN p_size / 4 END AS a, CASE WHEN p_partkey % 4 > 0 THEN (p_partkey % 13 - 1)::DOUBLE END AS b FROM part),
v AS (SELECT *, CASE WHEN a > 0 THEN a END AS pa, CASE WHEN b > 0 THEN b END AS pb FROM h)
SELECT p_partkey, CASE WHEN r > 0 THEN r ELSE coalesce(greatest(pa, pb), 0) END::DOUBLE AS height, CASE WHEN r > 0 THEN 'raster' WHEN pa IS NOT NULL AND (pb IS NULL OR pa >= pb) THEN 'height_a' WHEN pb IS NOT NULL THEN 'height_b' ELSE 'fallback' END AS source, 'Height' AS field FROM v""")
def final_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster's height, else the largest of the sources', else the fallback."""
    k, size = F.col("p_partkey"), F.col("p_size")
    raster = F.when(k % 3 == 0, size - 25.0)
    vectors = {"height_a": F.when(k % 4 < 2, size / 4), "height_b": F.when(k % 4 > 0, (k % 13 - 1).cast("double"))}
    field = R.first_height_column(["id", "BLD_H", "Height"])
    return table(spark, sf_dir, "part").select("p_partkey", R.final_height(raster, vectors).alias("h")).select("p_partkey", "h.height", "h.source", F.lit(field).alias("field"))


@query(f"""WITH {SQL['a']}, {SQL['b']}, t AS (SELECT id, minx, miny, maxx, maxy, height FROM b)
SELECT a.id, max_by(t.height, t.id) AS value FROM a LEFT JOIN t ON (a.minx + a.maxx) / 2 BETWEEN t.minx AND t.maxx AND (a.miny + a.maxy) / 2 BETWEEN t.miny AND t.maxy GROUP BY a.id""")
def tile_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last tile over each box's middle holds."""
    tiles = other_boxes(spark, sf_dir).select(F.col("id").alias("place"), F.col("height").alias("value"), "minx", "miny", "maxx", "maxy")
    return Y.sampled_from_tiles(base_boxes(spark, sf_dir), tiles, CELL)


# --- record rules -------------------------------------------------------------------------------


@query("""WITH c AS (SELECT p_partkey, lower(p_name) AS a, CASE p_size % 3 WHEN 0 THEN lower(p_name) WHEN 1 THEN 'x' ELSE '' END AS b, CASE WHEN p_size % 2 = 0 THEN lower(p_type) ELSE '' END AS d, lower(p_type) AS e FROM part)
SELECT p_partkey, (CASE WHEN b <> '' AND a = b THEN 1 ELSE 0 END + CASE WHEN d <> '' THEN 1 ELSE 0 END)::DOUBLE / nullif((b <> '')::INT + (d <> '')::INT, 0) AS agreement FROM c""")
def attribute_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, name = F.col("p_size"), F.col("p_name")
    other = F.when(size % 3 == 0, F.concat(F.lit(" "), F.upper(name))).when(size % 3 == 1, "x").otherwise("None")
    return table(spark, sf_dir, "part").select("p_partkey", R.attribute_agreement([(name, other), (F.col("p_type"), F.when(size % 2 == 0, F.lower("p_type")))]).alias("agreement"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_type WHEN 1 THEN p_brand WHEN 2 THEN 'poi' WHEN 3 THEN 'poi' ELSE '[' || p_brand END AS category FROM part""")
def first_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    text = F.when(k == 0, F.to_json(F.array("p_type", "p_brand"))).when(k == 1, F.concat("p_brand", F.lit(" , x"))).when(k == 2, None).when(k == 3, " <NA>").otherwise(F.concat(F.lit("["), "p_brand", F.lit(",x]")))
    return table(spark, sf_dir, "part").select("p_partkey", R.first_category(text).alias("category"))


@query("""SELECT event_id, event_type AS kind, CASE WHEN event_id % 3 = 0 THEN 'b=c' ELSE 'a' END AS reason, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END + 1 AS n FROM events""")
def failure_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key=value tokens of failure summaries."""
    again = F.when(F.col("event_id") % 3 == 0, "REASON=b=c|code=7").otherwise("")
    summary = F.concat(F.lit(" Kind = "), "event_type", F.lit("|junk|=x|y=|Reason=a|"), again)
    made = table(spark, sf_dir, "events").select("event_id", R.failure_tokens(summary).alias("t"))
    return made.select("event_id", F.col("t")["kind"].alias("kind"), F.col("t")["reason"].alias("reason"), F.size("t").alias("n"))


@query("""WITH c AS (SELECT user_id, event_id, event_type = 'view' OR value > 150 AS fine, event_type = 'error' AS outside, event_type = 'signup' AND value < 2 AS broken FROM events),
g AS (SELECT user_id, count(*) FILTER (NOT fine) AS gone, count(*) FILTER (NOT fine AND outside) AS far, count(*) FILTER (NOT fine AND broken) AS bad, count(*) FILTER (fine) AS there FROM c GROUP BY 1)
SELECT user_id, CASE WHEN gone = 0 THEN 'none' WHEN bad > 0 THEN 'system_failure' WHEN far = gone THEN 'external_uncontrollable' ELSE 'partial_source' END AS level, there::INT AS n_available, gone::INT AS n_missing FROM g""")
def component_degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = R.coverage_status(F.when(kind == "view", F.lit(3)))
    coverage = table(spark, sf_dir, "events").select("user_id", F.col("event_id").cast("string").alias("source"), status.alias("status"), F.when(F.col("value") > 150, 1).otherwise(0).alias("n"), F.when((kind == "signup") & (F.col("value") < 2), " provider_bug").alias("fault"), (kind == "error").alias("outside"))
    made = R.degradation(coverage, "user_id", ["TIMEOUT"], ["PROVIDER_BUG"])
    return made.select("user_id", "level", F.size("available").alias("n_available"), F.size("missing").alias("n_missing"))


@query("""WITH g AS (SELECT user_id, list(DISTINCT event_type) AS have, list(DISTINCT event_type) FILTER (value < 100) AS low FROM events GROUP BY 1),
m AS (SELECT user_id, list_filter(['view', 'purchase', 'refund'], lambda x: NOT list_contains(have, x)) AS missing, coalesce(low, []) || CASE WHEN user_id % 2 = 0 THEN ['refund'] ELSE [] END AS outside FROM g)
SELECT user_id, CASE WHEN len(missing) = 0 THEN 'full_autonomous_closure' WHEN len(list_filter(missing, lambda x: NOT list_contains(outside, x))) = 0 THEN 'degraded_external' ELSE 'system_failure' END AS status FROM m""")
def run_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("have"), F.collect_set(F.when(F.col("value") < 100, F.col("event_type"))).alias("low"))
    needs = F.array(*map(F.lit, ("view", "purchase", "refund")))
    outside = F.concat("low", F.when(F.col("user_id") % 2 == 0, F.array(F.lit("refund"))).otherwise(F.array().cast("array<string>")))
    return g.select("user_id", R.readiness(needs, F.col("have"), outside).alias("status"))


@query("""WITH s(name, low, high, needed) AS (VALUES ('view', 1.0, 5.0, TRUE), ('error', NULL, 300.0, FALSE), ('absent', 0.0, 1.0, TRUE), ('optional', 0.0, 1.0, FALSE)), p AS (SELECT event_type AS name, max(value) AS value FROM events GROUP BY 1),
j AS (SELECT s.name, value, CASE WHEN value IS NULL AND needed THEN 'missing' WHEN value < low THEN 'below' WHEN value > high THEN 'above' END AS problem FROM s LEFT JOIN p USING (name)) SELECT * FROM j WHERE problem IS NOT NULL""")
def parameter_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = spark.createDataFrame([("view", 1.0, 5.0, True), ("error", None, 300.0, False), ("absent", 0.0, 1.0, True), ("optional", 0.0, 1.0, False)], "name string, low double, high double, needed boolean")
    parameters = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.max("value").alias("value"))
    return R.out_of_range(parameters, specs).select("name", "value", "problem")


@query("""WITH x AS (SELECT c_custkey AS context, CASE WHEN c_custkey % 3 = 0 THEN 'small' ELSE 'large' END AS bucket, c_mktsegment AS country FROM customer)
SELECT context, name, CASE name WHEN 'fixed' THEN 9 WHEN 'radius' THEN CASE WHEN bucket = 'small' AND country = 'FURNITURE' THEN 1 WHEN bucket = 'small' THEN 2 ELSE 5 END ELSE CASE WHEN context % 2 = 0 THEN 3 ELSE 7 END END::DOUBLE AS value,
  CASE name WHEN 'fixed' THEN 'durable_learning' WHEN 'radius' THEN CASE WHEN bucket = 'small' THEN 'conditional_default' ELSE 'static_seed' END ELSE CASE WHEN context % 2 = 0 THEN 'conditional_default' ELSE 'static_seed' END END AS origin
FROM x, (VALUES ('radius'), ('cover'), ('fixed')) v(name)""")
def effective_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each context's parameters are: learnt, by the first condition that holds, or the default."""
    specs = spark.createDataFrame([("radius", 5.0), ("cover", 7.0), ("fixed", 0.0)], "name string, value double")
    conditions = spark.createDataFrame([("radius", 1, 1.0, "small", "furniture", None), ("radius", 2, 2.0, "small", None, None), ("radius", 0, 99.0, None, None, None), ("cover", 1, 3.0, None, None, ["osm"])], "name string, place int, value double, bucket string, country string, sources array<string>")
    overrides = spark.createDataFrame([("fixed", 9.0)], "name string, value double")
    k = F.col("c_custkey")
    contexts = table(spark, sf_dir, "customer").select(k.alias("context"), F.when(k % 3 == 0, "small").otherwise("large").alias("bucket"), F.col("c_mktsegment").alias("country"), F.when(k % 2 == 0, F.array(F.lit("osm"), F.lit("x"))).otherwise(F.array(F.lit("x"))).alias("sources"))
    return R.effective_parameters(specs, conditions, overrides, contexts)


@query("""SELECT p_partkey, regexp_matches(lower(p_name), 'widget|bolt') AND NOT regexp_matches(lower(p_name), 'cold') AND p_size / 10 < 2.5 AS refused, lower(p_name) LIKE '%bolt%' OR lower(p_name) LIKE '%cold w%' AS listed FROM part""")
def non_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    refused = R.non_building(F.col("p_name"), F.col("p_size") / 10, "widget|bolt", "cold")
    return table(spark, sf_dir, "part").select("p_partkey", refused.alias("refused"), F.expr(R.like_filter("p_name", ["BOLT", "cold w"])).alias("listed"))


@query("""SELECT s_suppkey, sha256('{"name":"' || s_name || '","nation":' || CASE WHEN s_nationkey % 2 = 0 THEN 'null' ELSE s_nationkey::VARCHAR END || '}') AS content, sha1(printf('%.7f', s_nationkey / 4) || ',' || printf('%.7f', s_suppkey * 1237.5 + 0.125)) AS box FROM supplier""")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.when(F.col("s_nationkey") % 2 != 0, F.col("s_nationkey"))
    box = (F.col("s_nationkey") / 4, F.col("s_suppkey") * 1237.5 + 0.125)
    return table(spark, sf_dir, "supplier").select("s_suppkey", R.semantic_hash([F.col("s_name").alias("name"), nation.alias("nation")]).alias("content"), R.box_hash(box).alias("box"))


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 3 THEN NULL ELSE 'Land ' || chr((65 + n_nationkey)::INT) END AS place FROM nation""")
def request_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place that a request names."""
    k, land = F.col("n_nationkey"), F.concat(F.lit("Land "), F.char(F.lit(65) + F.col("n_nationkey")))
    text = F.when(k % 4 == 0, F.concat(F.lit("fuse the buildings in "), land, F.lit(", now"))).when(k % 4 == 1, F.concat(F.lit("Roads of "), land, F.lit(" please"))).when(k % 4 == 2, F.concat(F.lit("water IN "), land)).otherwise("fuse everything")
    return table(spark, sf_dir, "nation").select("n_nationkey", R.location_of(text).alias("place"))


@query("""WITH r AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' None ' WHEN 1 THEN '' ELSE '  ' || upper(p_name) || ' ' END AS t, CASE WHEN p_partkey % 3 = 0 THEN 'a|b, c;;b' ELSE p_brand END AS ids FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN '' ELSE lower(trim(t)) END AS norm, regexp_replace(trim(lower(t)) || ' cafe', '\\s+', ' ', 'g') AS fold,
  CASE WHEN p_partkey % 3 = 0 THEN 'a|a|b, c;;b|b|c' ELSE ids END AS ids, CASE WHEN p_partkey % 4 < 2 THEN 'spare' ELSE trim(t) END AS first FROM r""")
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null-like texts, folding, id lists and the first text that says something."""
    k = F.col("p_partkey")
    t = F.when(k % 4 == 0, " None ").when(k % 4 == 1, "").otherwise(F.concat(F.lit("  "), F.upper("p_name"), F.lit(" ")))
    ids = F.when(k % 3 == 0, "a|b, c;;b").otherwise(F.col("p_brand"))
    fold = S.folded(F.concat(F.regexp_replace(t, "^ +| +$", ""), F.lit("  CAFÉ")))
    return table(spark, sf_dir, "part").select("p_partkey", S.normalized(t).alias("norm"), F.when(k % 4 == 1, " cafe").otherwise(fold).alias("fold"), F.array_join(F.array_sort(S.id_values(ids)), "|").alias("ids"), S.first_present(t, default=F.lit("spare")).alias("first"))


# --- rankings and catalog ----------------------------------------------------------------------


@query("""WITH c AS (SELECT p_type, p_partkey, 0.3 * (0.6 * coalesce(CASE WHEN p_size % 7 > 0 THEN p_size / 50 END, 0) + 0.4 * (p_partkey % 10) / 10) + 0.2 * p_retailprice / 2000 + 0.1 * coalesce(CASE WHEN p_size % 3 > 0 THEN p_size / 50 END, 0.5) + coalesce(CASE WHEN p_size % 5 = 0 THEN 0.05 END, 0) AS s FROM part)
SELECT p_type, p_partkey, round(s, 6) AS score FROM c QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY round(s, 6) DESC, p_partkey) = 1""")
def weighted_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidate of each type by the policy's weighted score."""
    size = F.col("p_size")
    c = table(spark, sf_dir, "part").select("p_type", "p_partkey", F.when(size % 7 > 0, size / 50).alias("success_rate"), ((F.col("p_partkey") % 10) / 10).alias("accuracy"), (F.col("p_retailprice") / 2000).alias("data_quality"), F.when(size % 3 > 0, size / 50).alias("freshness"), F.when(size % 5 == 0, 0.05).alias("learning"))
    score = F.round(K.weighted_score({"data_quality": 0.2}, {"freshness": 0.1}), 6)
    return B.top_k(c.withColumn("score", score), 1, F.desc("score"), F.asc("p_partkey"), per=["p_type"]).select("p_type", "p_partkey", "score")


_STEPS = """p AS (SELECT DISTINCT l_suppkey AS pattern, (l_suppkey % 10) / 10 AS quality FROM lineitem), s AS (SELECT DISTINCT l_suppkey AS pattern, l_linenumber AS step, l_partkey AS algorithm, l_returnflag AS t FROM lineitem), g AS (SELECT p_partkey AS algorithm, CASE WHEN p_size % 4 > 0 THEN p_size / 50 END AS rate FROM part)"""


@query(f"""WITH {_STEPS}, w AS (SELECT s.pattern, coalesce(g.rate, p.quality) AS fit, (t <> 'N')::INT AS there, t, p.quality FROM s LEFT JOIN g USING (algorithm) JOIN p ON s.pattern = p.pattern),
a AS (SELECT pattern, avg(fit) AS fit, avg(there) AS support, count(DISTINCT CASE WHEN there = 0 THEN t END) AS missing, any_value(quality) AS quality FROM w GROUP BY 1)
SELECT pattern, round(fit, 4) AS fit, round(support, 4) AS support, missing, round(greatest(0, least(1, 0.4 * quality + 0.4 * fit + 0.2 * support - least(0.3, 0.1 * missing))), 4) AS score, pattern = 3 AS preferred FROM a""")
def pattern_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns by how well their steps are served."""
    li = table(spark, sf_dir, "lineitem")
    patterns = li.select(F.col("l_suppkey").alias("pattern")).distinct().withColumn("quality", (F.col("pattern") % 10) / 10)
    steps = li.select(F.col("l_suppkey").alias("pattern"), F.col("l_linenumber").alias("step"), F.col("l_partkey").alias("algorithm"), F.col("l_returnflag").alias("source_type")).distinct()
    algorithms = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("algorithm"), F.when(F.col("p_size") % 4 > 0, F.col("p_size") / 50).alias("rate"))
    made = K.ranked_patterns(patterns, steps, algorithms, spark.createDataFrame([("R",), ("A",)], "source_type string"), 3)
    return made.withColumns({c: F.round(c, 4) for c in ("fit", "support", "score")})


@query("""WITH d AS (SELECT p_brand AS pattern, round(sum(CASE WHEN p_size > 25 THEN 0.2 ELSE -0.15 END), 6) AS delta FROM part GROUP BY 1),
p AS (SELECT p_brand AS pattern, min(p_type) AS kind, avg(p_size) / 50 AS rate, bool_or(p_name LIKE 'cold%') AS f, count(*) % 2 = 0 AS g FROM part GROUP BY 1)
SELECT pattern, round(rate + delta, 6) AS score FROM p JOIN d USING (pattern) WHERE f OR g ORDER BY score DESC, pattern LIMIT 5""")
def served_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best patterns for a disaster, with what their runs have taught."""
    part = table(spark, sf_dir, "part")
    scores = K.feedback_scores(part.select(F.col("p_brand").alias("pattern"), (F.col("p_size") > 25).alias("success")), "pattern", 0.2, 0.15)
    disasters = F.array_compact(F.array(F.when(F.bool_or(F.col("p_name").like("cold%")), "Flood"), F.when(F.count(F.lit(1)) % 2 == 0, "GENERIC")))
    patterns = part.groupBy(F.col("p_brand").alias("pattern")).agg(F.lit("fusion").alias("kind"), (F.avg("p_size") / 50).alias("rate"), disasters.alias("disasters"))
    return K.served_patterns(patterns, "fusion", "flood", scores, 5).select("pattern", "score")


@query("""SELECT t AS type, s_suppkey AS source, score FROM (SELECT s_suppkey, s_acctbal AS score, unnest(['N' || (s_nationkey % 5), 'M' || (s_suppkey % 3)]) AS t FROM supplier) WHERE t IN ('N1', 'N3', 'M0') QUALIFY row_number() OVER (PARTITION BY t ORDER BY score DESC, s_suppkey) <= 3""")
def sources_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = F.array(F.concat(F.lit("N"), F.col("s_nationkey") % 5), F.concat(F.lit("M"), F.col("s_suppkey") % 3))
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"), F.col("s_acctbal").alias("score"), types.alias("types"))
    return K.per_type(sources, spark.createDataFrame([("N1",), ("N3",), ("M0",), ("none",)], "type string"), 3)


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS algorithm, l_partkey AS other FROM lineitem) SELECT algorithm, other, round(p_size / 50 + CASE WHEN other % 2 = 0 THEN 0.15 ELSE 0 END, 6) AS score FROM l JOIN part ON p_partkey = other
QUALIFY row_number() OVER (PARTITION BY algorithm ORDER BY round(p_size / 50 + CASE WHEN other % 2 = 0 THEN 0.15 ELSE 0 END, 6) DESC, other) <= 2""")
def algorithm_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    algorithms = part.select(F.col("p_partkey").alias("algorithm"), (F.col("p_size") / 50).alias("rate"))
    deltas = part.select(F.col("p_partkey").alias("algorithm"), F.when(F.col("p_partkey") % 2 == 0, 0.15).alias("delta"))
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("algorithm"), F.col("l_partkey").alias("other"))
    return K.alternatives(algorithms, links, deltas, 2)


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS pattern, l_linenumber AS step, l_partkey AS algorithm FROM lineitem) SELECT n_nationkey AS pattern, coalesce(string_agg(step || ':' || algorithm, ',' ORDER BY step, algorithm), '') AS steps FROM nation LEFT JOIN s ON pattern = n_nationkey GROUP BY 1""")
def pattern_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pattern with its steps in order."""
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("pattern"), F.col("l_linenumber").alias("step"), F.col("l_partkey").alias("algorithm")).distinct()
    algorithms = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("algorithm"), F.col("p_size").alias("rate"))
    made = C.collected_per_pattern(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("pattern")), steps, algorithms)
    each = F.transform(F.coalesce("steps", F.expr("array()").cast("array<struct<step:int,algorithm:bigint,rate:int>>")), lambda s: F.concat_ws(":", s["step"], s["algorithm"]))
    return made.select("pattern", F.array_join(each, ",").alias("steps"))


@query(f"""WITH {SQL['a']} SELECT id AS artifact, o_orderdate AS created FROM a JOIN orders ON id = o_orderkey WHERE o_orderstatus = 'F' AND minx <= 150 AND maxx >= 152 AND o_orderdate >= TIMESTAMP '1996-01-01' ORDER BY created DESC, artifact LIMIT 7""")
def reusable_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest artifacts of a kind that cover a window."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("artifact"), F.col("o_orderstatus").alias("kind"), F.col("o_orderdate").alias("created"))
    boxes = base_boxes(spark, sf_dir).select(F.col("id").alias("artifact"), "minx", "maxx", F.lit(0.0).alias("miny"), F.lit(9.0).alias("maxy"))
    return K.reusable(o.join(boxes, "artifact"), "F", (150.0, 1.0, 152.0, 2.0), "1996-01-01", 7).select("artifact", "created")


@query("""SELECT path, hits FROM (SELECT DISTINCT p_type || '/' || p_brand || '/' || p_name AS path, contains(lower(p_type || '/' || p_brand || '/' || p_name), 'cold')::INT + contains(lower(p_type || '/' || p_brand || '/' || p_name), 'brand#1')::INT AS hits FROM part) ORDER BY hits DESC, length(path), path LIMIT 15""")
def ranked_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_type", "p_brand", "p_name").alias("path")).distinct()
    return K.ranked_paths(paths, "path", ["COLD", "brand#1"], 15)


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 3 END, o_totalprice DESC, o_orderkey) AS place FROM orders""")
def custom_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows numbered in an order of statuses of our own."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", K.custom_order(F.col("o_orderstatus"), ["P", "F"]).alias("o"))
    return B.with_row_numbers(o, [F.asc("o"), F.desc("o_totalprice"), F.asc("o_orderkey")], "place").select("o_orderkey", "place")


@query("SELECT event_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 100 OFFSET 100")
def second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of runs with a fault, the newest first."""
    return K.page(table(spark, sf_dir, "events").where("event_type = 'error'"), "ts", "event_id", 2, 500).select("event_id", "ts")


@query("SELECT event_id, ts FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id LIMIT 1")
def run_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.one_by_key(table(spark, sf_dir, "events"), "user_id", 7, [F.desc("ts"), F.asc("event_id")]).select("event_id", "ts")


@query("""SELECT s_nationkey AS role, s_suppkey AS id, s_name AS path FROM supplier WHERE s_acctbal > 0 QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 4, s_suppkey) = 1""")
def role_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source of each role: the first available one."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("role"), F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 4).alias("priority"), F.col("s_name").alias("path"), (F.col("s_acctbal") > 0).alias("available"))
    return K.first_available(s, "role")


@query("""WITH h AS (SELECT p_type, p_partkey, contains(lower(p_name), 'cold')::INT + contains(lower(p_name), 'bolt')::INT AS hits FROM part) SELECT p_type, p_partkey, hits FROM h WHERE hits > 0 QUALIFY hits = max(hits) OVER (PARTITION BY p_type)""")
def hinted_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.most_hinted(table(spark, sf_dir, "part").select("p_type", "p_partkey", "p_name"), "p_type", "p_name", ["cold", "Bolt"]).select("p_type", "p_partkey", "hits")


# --- sets ------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id, list_distinct(list(event_type ORDER BY event_type)) AS asked FROM events WHERE value > 200 GROUP BY 1)
SELECT user_id, array_to_string(list_sort(list_filter(asked, lambda x: x IN ('view', 'click'))), ',') AS allowed, array_to_string(list_sort(list_filter(asked, lambda x: x NOT IN ('view', 'click'))), ',') AS refused FROM e""")
def authorizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value > 200").groupBy("user_id").agg(F.collect_set("event_type").alias("asked"))
    yes, no = T.authorized(F.array(F.lit("view"), F.lit("click")), F.col("asked"))
    return e.select("user_id", F.array_join(F.array_sort(yes), ",").alias("allowed"), F.array_join(F.array_sort(no), ",").alias("refused"))


@query("""SELECT lower(c_mktsegment) AS name, c_nationkey AS country, round(c_acctbal / 1000, 1) + 0.0 AS x, max(c_custkey) AS score FROM customer GROUP BY 1, 2, 3""")
def best_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate for each name, country and rounded place, that of the highest score."""
    rows = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("name"), F.col("c_nationkey").cast("string").alias("country"), (F.col("c_acctbal") / 1000).alias("x"), F.col("c_custkey").alias("score"))
    return T.best_candidates(rows, "name", "country", ["x"], "score", 1).select(F.lower("name").alias("name"), F.col("country").cast("int").alias("country"), (F.round("x", 1) + F.lit(0.0)).alias("x"), "score")


@query("""WITH r AS (SELECT o_orderkey, o_orderkey % 3 AS slice, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey END AS own, o_custkey % 40 AS shape, o_orderstatus = 'P' AS line FROM orders)
SELECT 'area' AS what, slice, 'id' || own AS shape FROM r WHERE NOT line AND own IS NOT NULL GROUP BY slice, own
UNION ALL SELECT 'area', slice, 'key' || o_orderkey FROM r WHERE NOT line AND own IS NULL UNION ALL SELECT DISTINCT 'line', NULL, shape::VARCHAR FROM r WHERE line""")
def deduplicated_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles put together: areas once for each id of a slice, lines once for each shape."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select((k % 3).alias("slice"), F.when(k % 4 > 0, F.col("o_custkey")).alias("osm_id"), F.when(F.col("o_orderstatus") == "P", (F.col("o_custkey") % 40).cast("string")).otherwise(F.when(k % 4 > 0, F.concat(F.lit("id"), "o_custkey")).otherwise(F.concat(F.lit("key"), k))).alias("shape"), (F.col("o_orderstatus") == "P").alias("line"))
    made = Y.deduplicated_slices(rows, ["canonical_id", "osm_id"], "shape", F.col("line"))
    return made.select(F.when(F.col("line"), "line").otherwise("area").alias("what"), F.when(~F.col("line"), F.col("slice")).alias("slice"), "shape")


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY first, event_type) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) GROUP BY 1""")
def kinds_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events in the order of their first one."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return e.groupBy("user_id").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"])), ",").alias("kinds"))


@query("""WITH p AS (SELECT l_orderkey AS plan, l_suppkey % 20 < 18 AND l_returnflag IN ('R', 'A') AND l_partkey % 50 < 45 AS fine FROM lineitem) SELECT plan, count(*) AS steps, count(*) FILTER (fine) AS fine, bool_and(fine) AS grounded FROM p GROUP BY 1""")
def plan_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all steps of a plan are among those offered."""
    plan = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plan"), (F.col("l_suppkey") % 20).alias("pattern"), (F.col("l_partkey") % 50).alias("algorithm"), F.col("l_returnflag").alias("type"))
    return Y.grounding(plan, spark.range(18).toDF("pattern"), spark.range(45).toDF("algorithm"), spark.createDataFrame([("R",), ("A",)], "type string"))


@query("""SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def compatible_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a contract admits."""
    admitted = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, sf_dir, "customer").join(admitted, "c_nationkey", "left_semi").select("c_custkey")


@query("SELECT name FROM (SELECT DISTINCT p_type AS name FROM part UNION SELECT DISTINCT p_brand FROM part UNION SELECT c_mktsegment FROM customer)")
def known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of four kinds of nodes, each once."""
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_type").alias("name")).union(part.select("p_brand")).union(table(spark, sf_dir, "customer").select("c_mktsegment")).distinct()


# --- summaries ----------------------------------------------------------------------------------


@query("""WITH n AS (SELECT * FROM events ORDER BY ts DESC LIMIT 100), d AS (SELECT 'kind' AS dimension, event_type AS value, value > 50 AS s, ts FROM n UNION ALL SELECT 'user', user_id::VARCHAR, value > 50, ts FROM n),
c AS (SELECT dimension, value, count(*) AS n, count(*) FILTER (s) AS successes, max(ts) AS last FROM d GROUP BY 1, 2) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) <= 3""")
def learning_by_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("user"), (F.col("value") > 50).alias("success"), "ts")
    return Y.by_dimensions(e, ["kind", "user"], "ts", 3)


@query("""WITH m AS (SELECT user_id, 'failed' AS name, bool_or(event_type = 'error') AS flag, NULL::DOUBLE AS number, NULL::VARCHAR AS text FROM events GROUP BY 1 UNION ALL SELECT user_id, 'value', NULL, round(avg(value), 6), NULL FROM events GROUP BY 1
UNION ALL SELECT user_id, 'last', NULL, NULL, max_by(event_type, (ts, event_type)) FROM events GROUP BY 1) SELECT * FROM m""")
def merged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of child runs merged: any, mean or last."""
    e, none = table(spark, sf_dir, "events"), F.lit(None)
    row = lambda name, kind, flag, number, text: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), flag.cast("boolean").alias("flag"), number.cast("double").alias("number"), text.cast("string").alias("text"))
    each = F.array(row("failed", "flag", F.col("event_type") == "error", none, none), row("value", "number", none, F.col("value"), none), row("last", "text", none, none, F.col("event_type")))
    return Y.merged_metrics(e.select("user_id", F.col("ts").alias("at"), F.explode(each).alias("r")).select("user_id", "at", "r.*"), "user_id")


@query("""WITH a AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1), b AS (SELECT p_type, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1) SELECT p_type, a.n AS n_before, coalesce(b.n, 0) AS n_after, coalesce(b.n, 0) - a.n AS change FROM a LEFT JOIN b USING (p_type)""")
def postprocess_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return Y.layer_changes(part, part.where("p_size > 10"), "p_type")


@query("""WITH e AS (SELECT 'status' AS field, o_orderstatus AS value FROM orders UNION ALL SELECT 'priority', o_orderpriority FROM orders WHERE o_orderkey % 6 <> 0) SELECT field, value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY field), 6) AS share FROM e GROUP BY 1, 2""")
def value_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderpriority")).alias("priority"))
    return Y.value_counts(o, ["status", "priority"])


@query("""SELECT s_suppkey, s_suppkey % 3 = 0 AS bytes_equal, s_suppkey % 3 < 2 AS semantic_equal, CASE WHEN s_suppkey % 3 = 2 THEN 'balance' ELSE '' END AS paths FROM supplier""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots compared by bytes and by what isn't volatile."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    state = lambda at, balance: F.to_json(F.struct(F.col("s_name").alias("name"), balance.alias("balance"), at.alias("saved_at")))
    left = s.select("s_suppkey", state(F.lit(1), F.col("s_acctbal")).alias("json"))
    right = s.select("s_suppkey", state(F.when(k % 3 == 0, 1).otherwise(2), F.when(k % 3 == 2, -1.5).otherwise(F.col("s_acctbal"))).alias("json"))
    return Y.snapshot_diff(left, right, "s_suppkey", "json", ["saved_at"])


@query("""SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS modes, bool_or(value > 190) AS cached FROM events GROUP BY 1""")
def download_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.download_summary(table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("mode"), (F.col("value") > 190).alias("cache_hit")), "user_id")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def active_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.active_counts(table(spark, sf_dir, "events"), "event_type", ["view", "click", "none"])


@query("SELECT user_id, max(n) AS largest FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def largest_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m")).select("user_id", Y.largest_component(F.col("m")).alias("largest"))


@query("SELECT user_id, count(DISTINCT event_type) AS kinds, count(*) AS n_events, sum(length(props)) AS bytes, round(sum(value), 4) AS seconds, max_by(event_type, (value, event_type)) AS slowest FROM events GROUP BY 1")
def run_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("kind"), F.length("props").alias("size"), F.col("value").alias("took"))
    return Y.telemetry(e, "user_id", "size", "took").withColumn("bytes", F.col("bytes").cast("long"))


@query(f"""WITH {SQL['a']}, {SQL['b']}, s AS (SELECT *, (minx + maxx) / 2 AS x, (miny + maxy) / 2 AS y FROM a ORDER BY id LIMIT 30),
d AS (SELECT s.id, min(sqrt(greatest(0, b.minx - x, x - b.maxx) ** 2 + greatest(0, b.miny - y, y - b.maxy) ** 2)) AS dist, max(greatest(0, least(s.maxx, b.maxx) - greatest(s.minx, b.minx)) * greatest(0, least(s.maxy, b.maxy) - greatest(s.miny, b.miny)) / ((s.maxx - s.minx) * (s.maxy - s.miny))) AS covered FROM s, b GROUP BY s.id)
SELECT id, round(dist, 6) AS dist, round(covered, 6) AS covered FROM d""")
def sample_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thirty boxes against the other layer."""
    return Y.sample_audit(base_boxes(spark, sf_dir), other_boxes(spark, sf_dir), CELL)


@query(f"""WITH {SQL['a']} SELECT DISTINCT CASE WHEN (x.maxx - x.minx) <= (y.maxx - y.minx) THEN x.id ELSE y.id END AS id FROM a x JOIN a y ON x.id < y.id AND x.minx < y.maxx AND y.minx < x.maxx AND x.miny < y.maxy AND y.miny < x.maxy
WHERE (least(x.maxx, y.maxx) - greatest(x.minx, y.minx)) * (least(x.maxy, y.maxy) - greatest(x.miny, y.miny)) >= 0.4 * least((x.maxx - x.minx) * (x.maxy - x.miny), (y.maxx - y.minx) * (y.maxy - y.miny))""")
def covered_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a layer that go as a larger one covers much of them."""
    return Y.separated_boxes(base_boxes(spark, sf_dir), CELL, 0.4)


@query(f"WITH {SQL['a']} SELECT id, greatest(minx, 100) AS minx, greatest(miny, 50) AS miny, least(maxx, 300) AS maxx, least(maxy, 700) AS maxy FROM a WHERE minx < 300 AND maxx > 100 AND miny < 700 AND maxy > 50")
def clipped_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.clipped_boxes(base_boxes(spark, sf_dir), (100.0, 50.0, 300.0, 700.0)).select("id", "minx", "miny", "maxx", "maxy")


@query(f"""WITH {SQL['pa']}, {SQL['pb']}, m AS (SELECT pa.id AS a_id, pb.id AS b_id, sqrt((pa.x - pb.x) ** 2 + (pa.y - pb.y) ** 2) AS dist FROM pa JOIN pb ON abs(pa.x - pb.x) <= 25 AND abs(pa.y - pb.y) <= 25 WHERE (pa.x - pb.x) ** 2 + (pa.y - pb.y) ** 2 <= 625
  QUALIFY row_number() OVER (PARTITION BY pa.id ORDER BY (pa.x - pb.x) ** 2 + (pa.y - pb.y) ** 2, pb.id) = 1)
SELECT round(count(DISTINCT a_id) / (SELECT count(*) FROM pa), 6) AS recall, round(count(DISTINCT b_id) / (SELECT count(*) FROM pb), 6) AS precision, round(quantile_cont(dist, 0.5), 6) AS p50, round(quantile_cont(dist, 0.95), 6) AS p95 FROM m""")
def alignment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoweld.plans.spatial import poi_nearest

    return T.alignment_summary(poi_nearest(spark, sf_dir), base_points(spark, sf_dir).count(), other_points(spark, sf_dir).count())
