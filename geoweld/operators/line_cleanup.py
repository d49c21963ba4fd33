"""Cleaning up supplementary lines against a base network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweld.functions import geometry as G
from geoweld.operators.components import checkpointed
from geoweld.operators.grid_join import best_per, grid_join, points
from geoweld.operators.lines import ENDS, SLACK, boxed, duplicate_supplements, length, line_candidates, residuals, segment, snapped_segments, union_length, with_covered_interval


def sampled_distances(supplement: DataFrame, base: DataFrame, cell: float, radius: float, step: float = 5.0, angle: float = 90.0) -> DataFrame:
    """id, mean, p90, far: distances of evenly spaced samples of each segment to the nearest base segment, of those that differ by no more than angle in direction.

    A segment has ceil(length / step) + 1 samples, three at least; samples
    without a base segment within radius count as infinitely far.
    """
    n = F.greatest(F.ceil(length(segment()) / step) + 1, F.lit(3)).cast("int")
    at = supplement.select("id", *segment(), n.alias("n"), G.bearing(*segment()).alias("way")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = F.col("i") / (F.col("n") - 1)
    placed = at.select("id", "i", "way", (F.col("x1") + t * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + t * (F.col("y2") - F.col("y1"))).alias("y"))
    d = G.point_segment_distance(F.col("b_x"), F.col("b_y"), *segment("a_"))
    like = None if angle >= 90 else G.angle_difference(F.col("b_way"), G.bearing(*segment("a_"))) <= angle
    # the base is widened, not the samples, which are several times as many, so that each of these lies in one cell
    near = grid_join(boxed(base.select(*segment())), points(placed), cell, radius + SLACK, like).groupBy(F.col("b_id").alias("id"), F.col("b_i").alias("i")).agg(F.min(d).alias("d"))
    each = placed.join(near, ["id", "i"], "left").withColumn("d", F.when(F.col("d") <= radius, F.col("d")).otherwise(float("inf")))
    return each.groupBy("id").agg(F.avg("d").alias("mean"), F.percentile("d", 0.9).alias("p90"), F.max("d").alias("far"))


#: The widest corridor of the rules below.
CORRIDOR = 12.0


def near_pairs(supplement: DataFrame, base: DataFrame, cell: float, radius: float = CORRIDOR) -> DataFrame:
    """Pairs of segments (ids and ends) whose boxes lie within radius, kept, so that the rules that go by narrower corridors share one join."""
    sides = [boxed(x.select("id", *segment())) for x in (supplement, base)]
    return checkpointed(grid_join(*sides, cell, radius).select(*(f"{k}_{c}" for k in "ab" for c in ("id", *ENDS))))


def corridor_coverage(supplement: DataFrame, base: DataFrame, cell: float, radius: float, keep: Column, pairs: DataFrame | None = None) -> DataFrame:
    """id, covered: share of each supplement segment within radius of those base segments that keep admits.

    pairs, if given, are all pairs of them within radius or more.
    """
    near = grid_join(boxed(supplement), boxed(base), cell, radius, keep) if pairs is None else pairs.where(keep)
    parts = with_covered_interval(near, radius)
    return parts.groupBy(F.col("a_id").alias("id")).agg(union_length(F.collect_list("part")).alias("covered"))


def _turned(most: float) -> Column:
    return G.angle_difference(G.bearing(*segment("a_")), G.bearing(*segment("b_"))) <= most


def group_duplicates(supplement: DataFrame, base: DataFrame, cell: float, radius: float = 6.0, angle: float = 18.0, least: float = 0.90, mean: float = 4.0, p90: float = 7.0, pairs: DataFrame | None = None) -> DataFrame:
    """id of segments that several base segments of like direction double together."""
    covered = corridor_coverage(supplement, base, cell, radius, _turned(angle), pairs).where(F.col("covered") >= least)
    some = supplement.join(covered.select("id"), "id", "left_semi")
    near = sampled_distances(some, base, cell, 2 * radius)
    return near.where((F.col("mean") <= mean) & (F.col("p90") <= p90)).select("id")


def near_base_returns(supplement: DataFrame, base: DataFrame, cell: float, radius: float = 12.0, least: float = 0.85, mean: float = 6.0, p90: float = 10.0, far: float = 16.0, pairs: DataFrame | None = None) -> DataFrame:
    """id of segments with both ends near the base that run along it."""
    pairs = near_pairs(supplement, base, cell, radius) if pairs is None else pairs
    d = [G.point_segment_distance(F.col(f"a_x{k}"), F.col(f"a_y{k}"), *segment("b_")) for k in (1, 2)]
    both = pairs.groupBy(F.col("a_id").alias("id")).agg(*(F.min(x).alias(f"d{k}") for k, x in enumerate(d, 1))).where((F.col("d1") <= radius) & (F.col("d2") <= radius)).select("id")
    along = corridor_coverage(supplement, base, cell, radius, F.lit(True), pairs).where(F.col("covered") >= least).select("id")
    near = sampled_distances(supplement.join(both, "id", "left_semi").join(along, "id", "left_semi"), base, cell, 2 * far)
    return near.where((F.col("mean") <= mean) & (F.col("p90") <= p90) & (F.col("far") <= far)).select("id")


def crossing_duplicates(supplement: DataFrame, base: DataFrame, cell: float, corridor: float = 12.0, touch: float = 1.0, angle: float = 22.0, least: float = 0.82, mean: float = 6.0, p90: float = 10.0, far: float = 18.0, step: float = 30.0, pairs: DataFrame | None = None) -> DataFrame:
    """id of segments that touch or cross base segments of like direction and run along these: one road drawn twice, a little off."""
    pairs = near_pairs(supplement, base, cell, corridor) if pairs is None else pairs
    along = corridor_coverage(supplement, base, cell, corridor, _turned(angle), pairs).where(F.col("covered") >= least).select("id")
    touching = corridor_coverage(supplement, base, cell, touch, _turned(angle), pairs).where("covered > 0").select("id")
    some = supplement.join(along, "id", "left_semi").join(touching, "id", "left_semi")
    near = sampled_distances(some, base, cell, far + 1, step, angle)
    return near.where((F.col("mean") <= mean) & (F.col("p90") <= p90) & (F.col("far") <= far)).select("id")


def dangling(lines: DataFrame, cell: float, radius: float = 1.0, one_free: float = 12.0, both_free: float = 30.0) -> DataFrame:
    """id of short segments that hang loose: up to both_free long with no end at another line, up to one_free with one."""
    ends = lines.select("id", F.explode(F.array(*(F.struct(F.lit(k).alias("end"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (1, 2)))).alias("e")).select("id", "e.*")
    d = G.point_segment_distance(F.col("a_x"), F.col("a_y"), *segment("b_"))
    met = grid_join(points(ends), boxed(lines), cell, radius, F.col("a_id") != F.col("b_id")).where(d <= radius)
    tied = met.select(F.col("a_id").alias("id"), F.col("a_end").alias("end")).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("tied"))
    counted = lines.join(tied, "id", "left").withColumn("tied", F.coalesce("tied", F.lit(0)))
    long = length(segment())
    return counted.where(((F.col("tied") == 0) & (long <= both_free)) | ((F.col("tied") == 1) & (long <= one_free))).select("id")


def conflated(base: DataFrame, supplement: DataFrame, cell: float, radius: float = 3.0, least: float = 5.0) -> DataFrame:
    """of, part, role, x1, y1, x2, y2: the base network with what supplements add to it; `of` is the line's id.

    A supplement that is some base line's best match adds only its parts beyond radius of the base (part from 1, role residual), any other one
    the whole of it (part 0, role supplement). Of these the ones go that one base line, several, a corridor along the
    base or a crossing of it double, then the short ones that hang loose in the network. The ends of the rest are moved
    to the base where that doesn't bend them. Base lines have part 0 and role base.
    """
    best = best_per(line_candidates(base, supplement, cell), "a_id", F.col("hausdorff_m"), F.col("angle_diff_deg"), F.col("b_id"))
    matched = checkpointed(best.select(F.col("b_id").alias("id")).distinct())
    ends = [F.col(c) for c in ENDS]
    named = lambda part, base: F.struct(F.lit(base).alias("base"), F.col("id").alias("of"), part.cast("int").alias("part")).alias("id")
    whole = supplement.join(matched, "id", "left_anti").select(named(F.lit(0), False), *ends)
    rest = residuals(supplement.join(matched, "id", "left_semi"), base, cell, radius, least).select(named(F.col("part"), False), *ends)
    parts = checkpointed(whole.union(rest))
    pairs = near_pairs(parts, base, cell)
    doubles = [rule(parts, base, cell, pairs=pairs) for rule in (duplicate_supplements, group_duplicates, near_base_returns, crossing_duplicates)]
    gone = doubles[0]
    for df in doubles[1:]:
        gone = gone.union(df)
    left = checkpointed(parts.join(gone.distinct(), "id", "left_anti"))
    network = left.union(base.select(named(F.lit(0), True), *ends))
    tied = left.join(dangling(network, cell), "id", "left_anti")
    snapped = snapped_segments(tied, base, cell)
    added = snapped.select("id.of", "id.part", F.when(F.col("id.part") == 0, "supplement").otherwise("residual").alias("role"), *ends)
    return base.select(F.col("id").alias("of"), F.lit(0).alias("part"), F.lit("base").alias("role"), *ends).union(added)
