"""Spatial layers derived from whole tables of the driver's by arithmetic that Spark and SQL share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoweld.plans.registry import table

#: Cell of the grid joins over these layers: about a box and twice the radius.
CELL = 40.0



def _at(k: str, x: int, y: int, side: int) -> tuple[str, str]:
    """Where key k lies: `side` keys are spread over a square of that side, the next ones over the square above it, so density is the same at any scale."""
    return f"(({k} * {x}) % {side})", f"(({k} * {y}) % {side} + {side} * floor({k} / {side}))"


def _doubles(**columns: str) -> list[str]:
    return [f"CAST({e} AS DOUBLE) AS {name}" for name, e in columns.items()]


_AX, _AY = _at("o_orderkey", 7919, 104729, 401)
_AS = "(5 + (o_orderkey * 31) % 20)"
BASE = ["o_orderkey AS id", *_doubles(minx=_AX, miny=_AY, maxx=f"{_AX} + {_AS}", maxy=f"{_AY} + {_AS}"), "o_totalprice AS height"]
_KX, _KY = _at("k", 7919, 104729, 401)
_OX, _OY, _OS = f"({_KX} + n * 3)", f"({_KY} + n * 2)", "(4 + (k * 17 + n * 7) % 20)"
OTHER = ["k * 8 + n AS id", *_doubles(minx=_OX, miny=_OY, maxx=f"{_OX} + {_OS}", maxy=f"{_OY} + {_OS}", height="(k * 13 + n * 5) % 50")]
_SX, _SY = "(o_orderkey * 31) % 41 - 20", "(o_orderkey * 37) % 41 - 20"
SEGMENT_A = ["o_orderkey AS id", *_doubles(x1=_AX, y1=_AY, x2=f"{_AX} + {_SX}", y2=f"{_AY} + {_SY}")]
# some lie along their base line, some a little beside it and some far off
_BX, _BY = f"({_AX} + (o_orderkey * 3) % 9 + 11 * (o_orderkey % 4))", f"({_AY} + (o_orderkey * 5) % 9)"
SEGMENT_B = ["o_orderkey AS id", *_doubles(x1=_BX, y1=_BY, x2=f"{_BX} + {_SX} + (o_orderkey * 7) % 9 + 0.37", y2=f"{_BY} + {_SY} + 2")]
_CX, _CY = _at("c_custkey", 7919, 104729, 1009)
POINT_A = ["c_custkey AS id", *_doubles(x=_CX, y=_CY), "c_name AS name"]
_PX, _PY = _at("p_partkey", 6101, 90001, 1009)
POINT_B = ["p_partkey AS id", *_doubles(x=_PX, y=_PY), "p_name AS name"]

_S = ", ".join
SQL = {
    "a": f"a AS (SELECT {_S(BASE)} FROM orders)",
    "b": f"b AS (SELECT {_S(OTHER)} FROM (SELECT DISTINCT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS n FROM lineitem))",
    "sa": f"sa AS (SELECT {_S(SEGMENT_A)} FROM orders)",
    "sb": f"sb AS (SELECT {_S(SEGMENT_B)} FROM orders)",
    "pa": f"pa AS (SELECT {_S(POINT_A)} FROM customer)",
    "pb": f"pb AS (SELECT {_S(POINT_B)} FROM part)",
    # pairs of boxes that meet, with their shared and own areas
    "pairs": """pairs AS (
  SELECT a.id AS a_id, b.id AS b_id, a.height AS a_height, b.height AS b_height,
         (least(a.maxx, b.maxx) - greatest(a.minx, b.minx)) * (least(a.maxy, b.maxy) - greatest(a.miny, b.miny)) AS shared,
         (a.maxx - a.minx) * (a.maxy - a.miny) AS area_a, (b.maxx - b.minx) * (b.maxy - b.miny) AS area_b
  FROM a JOIN b ON a.minx <= b.maxx AND b.minx <= a.maxx AND a.miny <= b.maxy AND b.miny <= a.maxy)""",
}


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt over all cores by id: tables are small files, whose rows make far more work than their bytes tell."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "id")


def base_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*BASE)


def other_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS k", "CAST(l_linenumber AS BIGINT) AS n").distinct()
    return keys.selectExpr(*OTHER)


#: Latitudes that a strip of points takes up.
_STRIP = 80


def on_globe(points: DataFrame) -> DataFrame:
    """points spread, with lon and lat, a thousandth of x and y, in strips of _STRIP degrees beside each other, so that none lies beyond a pole, where all cells are one."""
    strip = f"floor(y / {_STRIP * 1000})"
    return spread(points).selectExpr("*", f"pmod(x / 1000 + 2 * {strip} + 180, 360) - 180 AS lon", f"(y - {_STRIP * 1000} * {strip}) / 1000 AS lat")


def base_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*SEGMENT_A)


def other_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*SEGMENT_B)


def base_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*POINT_A)


def other_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*POINT_B)
