"""Points of interest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweld.functions.geometry import geohash, geohash_ring
from geoweld.functions.text import name_score
from geoweld.operators.grid_join import best_per, prefixed


def geohash_candidates(base: DataFrame, other: DataFrame, precision: int = 8, least: float = 0.75) -> DataFrame:
    """a_id, b_id, score of points (id, name, lon, lat) in one geohash cell or neighbouring ones.

    Kept are scores of `least` or more and of exactly 0, which a missing name gives.
    """
    lon, lat = F.col("lon"), F.col("lat")
    ring = prefixed(base.withColumn("cell", F.explode(geohash_ring(lon, lat, precision))), "a_")
    own = prefixed(other.withColumn("cell", geohash(lon, lat, precision)), "b_")
    # points are few bytes in their files, and of the nine cells of each Spark's sizes tell nothing, so it would broadcast them all through the driver
    pairs = ring.hint("merge").join(own, F.col("a_cell") == F.col("b_cell")).select("a_id", "b_id", F.round(name_score("a_name", "b_name"), 6).alias("score"))
    return pairs.where((F.col("score") >= least) | (F.col("score") == 0))


def best_candidates(pairs: DataFrame) -> DataFrame:
    return best_per(pairs, "a_id", F.col("score").desc(), F.col("b_id"))


def matched_with_fallback(by_hash: DataFrame, by_distance: DataFrame) -> DataFrame:
    """The hash's pairs if there is any at all, else those by distance; both (a_id, b_id, score)."""
    none = by_hash.limit(1).agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(True))
    return best_candidates(by_hash.unionByName(by_distance.crossJoin(F.broadcast(none)).select(by_hash.columns)))
