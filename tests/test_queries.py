"""Every registered query with SQL against DuckDB on the smallest tables."""

import difflib
import math
import os

import duckdb
import pytest

from geoweld.plans import ORACLE_SQL, QUERIES
from geoweld.plans.derived import on_globe

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.5f}"
    return "~" if value is None else str(value)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DIR):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(canonical(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(canonical(r[names.index(c)]) for c in columns) for r in found.fetchall())


def ratio(a, b):
    a, b = a.strip().lower(), b.strip().lower()
    return 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()


def test_queries_without_sql_equal_brute_force(spark):
    assert {q for q in QUERIES if q not in ORACLE_SQL} == {"poi_geohash_match", "part_name_scores"}
    parts = [(r.p_partkey, r.p_name) for r in spark.read.parquet(f"{DIR}/part.parquet").collect()]
    names = {n for _, n in parts}
    want = {(a, b): round(ratio(a, b), 6) for a in names for b in names if a < b and a.split()[0] == b.split()[0]}
    got = QUERIES["part_name_scores"](spark, DIR).collect()
    assert {(r.left, r.right): r.score for r in got} == want and len(got) == len(want) > 0
    cell = lambda k: (math.floor((k * 6101 % 1009 / 1000 + 180) / 360 * 2**13), math.floor(((k * 90001 % 1009 + 1009 * (k // 1009)) / 1000 + 90) / 180 * 2**12))
    near = {(a, b): round(ratio(m, n), 6) for a, m in parts for b, n in parts if max(abs(p - q) for p, q in zip(cell(a), cell(b), strict=True)) <= 1}
    got = QUERIES["poi_geohash_match"](spark, DIR).collect()
    assert {(r.a_id, r.b_id): r.score for r in got} == {k: s for k, s in near.items() if s >= 0.75 or s == 0} and len(got) > len(parts)


def test_points_of_any_key_lie_on_the_globe(spark):
    points = spark.range(0, 7_200_000, 977).selectExpr("id", "CAST(id * 6101 % 1009 AS DOUBLE) AS x", "CAST(id * 90001 % 1009 + 1009 * floor(id / 1009) AS DOUBLE) AS y")
    got = on_globe(points)
    assert got.where("abs(lat) > 89 OR lon < -180 OR lon >= 180").count() == 0
    # within a strip as before, and no two points at one place
    assert got.where("y < 80000 AND (lon <> x / 1000 OR lat <> y / 1000)").where("abs(lon - x / 1000) > 1e-9 OR lat <> y / 1000").count() == 0
    assert got.selectExpr("round(lon, 6) AS a", "round(lat, 6) AS b").distinct().count() == points.count()


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_projected_boxes_are_dealt_over_the_cores(spark):
    assert QUERIES["projected_boxes"](spark, DIR).rdd.getNumPartitions() > 4


def test_steps_of_patterns_are_not_shuffled_by_their_kind_of_source(spark):
    plan = QUERIES["pattern_scores"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(source_type" not in plan.split("BroadcastExchange")[0] and "BroadcastHashJoin [source_type" in plan
