"""Attributes and labels that lines, places and runs take from what they meet."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweld.functions import geometry as G
from geoweld.operators.grid_join import grid_join
from geoweld.operators.lines import LONG, WAY, boxed, length, measured, segment, with_covered_interval


def carried_attributes(segments: DataFrame, originals: DataFrame, cell: float, radius: float, attribute: str, new: str = "new") -> DataFrame:
    """id, original, attribute, share: of each segment the original that lies along most of it, within radius; `new` where none does."""
    near = grid_join(boxed(segments), boxed(originals), cell, radius)
    along = with_covered_interval(near, radius).withColumn("along", F.col("part.hi") - F.col("part.lo"))
    best = along.groupBy(F.col("a_id").alias("id")).agg(F.max_by(F.struct(F.col("b_id").alias("original"), F.col(f"b_{attribute}").alias("value")), F.struct("along", -F.col("b_id"))).alias("o"), F.max("along").alias("share"))
    met = F.col("share") > 0
    return segments.select("id").join(best, "id", "left").select(
        "id", F.when(met, F.col("o.original")).alias("original"), F.when(met, F.col("o.value")).otherwise(new).alias(attribute), F.greatest("share", F.lit(0.0)).alias("share")
    )


def labelled_pairs(base: DataFrame, other: DataFrame, cell: float, radius: float = 20.0, hausdorff: float = 15.0, similar: float = 0.2, angle: float = 45.0) -> DataFrame:
    """a_id, b_id, label of lines near each other: 1 within the Hausdorff distance, else 2 if of like length and direction."""
    a, b = segment("a_"), segment("b_")
    near = grid_join(measured(base.select("id", *segment())), measured(other.select("id", *segment())), cell, radius)
    like = (G.length_similarity(F.col(f"a_{LONG}"), F.col(f"b_{LONG}")) > similar) & (G.angle_difference(F.col(f"a_{WAY}"), F.col(f"b_{WAY}")) < angle)
    label = F.when(G.vertex_hausdorff(a, b) <= hausdorff, 1).when(like, 2)
    return near.select("a_id", "b_id", label.alias("label")).where("label IS NOT NULL")


def contained_duplicates(supplement: DataFrame, base: DataFrame, cell: float, radius: float) -> DataFrame:
    """id of supplements that lie whole within radius of one longer base line."""
    near = with_covered_interval(grid_join(boxed(supplement), boxed(base), cell, radius), radius)
    inside = (F.col("part.hi") - F.col("part.lo") >= 1 - 1e-9) & (length(segment("a_")) < length(segment("b_")))
    return near.groupBy(F.col("a_id").alias("id")).agg(F.bool_or(inside).alias("inside")).where("inside").select("id")


def least_covering(areas: DataFrame, windows: DataFrame, cell: float) -> DataFrame:
    """id (a window's), area_id, size: the smallest area that covers each window; of equals the smaller id."""
    a, b = G.box("a_"), G.box("b_")
    covers = (b[0] <= a[0]) & (b[1] <= a[1]) & (b[2] >= a[2]) & (b[3] >= a[3])
    pairs = grid_join(windows, areas, cell, keep=covers)
    best = pairs.groupBy(F.col("a_id").alias("id")).agg(F.min(F.struct(G.box_area(b).alias("size"), F.col("b_id").alias("area_id"))).alias("m"))
    return best.select("id", "m.area_id", "m.size")


def dissolved_bounds(rows: DataFrame, window: tuple[float, float, float, float]) -> DataFrame:
    """n and the bounds of all rows that the window meets, one row."""
    x1, y1, x2, y2 = window
    met = rows.where((F.col("minx") <= x2) & (F.col("maxx") >= x1) & (F.col("miny") <= y2) & (F.col("maxy") >= y1))
    return met.agg(F.count(F.lit(1)).alias("n"), F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


def places_of_json(rows: DataFrame, column: str) -> DataFrame:
    """place_id, name, category, lon, lat of nested place records in JSON; rows without a place or without coordinates are left out."""
    kind = "id string, displayName struct<text:string>, types array<string>, location struct<latitude:double,longitude:double>"
    p = rows.select(F.from_json(column, kind).alias("p")).select("p.*")
    return p.where("id IS NOT NULL AND location.latitude IS NOT NULL AND location.longitude IS NOT NULL").select(
        F.col("id").alias("place_id"), F.col("displayName.text").alias("name"), F.coalesce(F.get("types", F.lit(0)), F.lit("poi")).alias("category"), F.col("location.longitude").alias("lon"), F.col("location.latitude").alias("lat")
    )


def ages(rows: DataFrame, column: str, now: str) -> DataFrame:
    """rows with `at`, the ISO text as a timestamp, and age_days up to now, 0 at least; null where the text is none."""
    at = F.try_to_timestamp(column)
    days = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(at)) / 86_400_000_000
    return rows.withColumns({"at": at, "age_days": F.when(at.isNotNull(), F.greatest(days, F.lit(0.0)))})


def adapted_rules(rules: DataFrame, level: Column, factors: Mapping[str, float], waived: str = "source_coverage") -> Column:
    """A rule's bound under a degradation: times the level's factor, none for the rule that degradation waives. rules: metric, bound."""
    by_level = F.coalesce(*(F.when(level == k, F.lit(v)) for k, v in factors.items()), F.lit(1.0))
    return F.when((F.col("metric") == waived) & (level != "none"), F.lit(None).cast("double")).otherwise(F.col("bound") * by_level)


def overview_graph(tables: Mapping[str, tuple[DataFrame, str]], links: Mapping[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """kind, what, n, connected: nodes by kind with how many an edge touches, and edges by kind; tables: kind to (table, key), links: kind to (table, source, target)."""
    nodes = [df.select(F.lit(k).alias("kind"), F.concat(F.lit(f"{k}:"), F.col(key).cast("string")).alias("node")).distinct() for k, (df, key) in tables.items()]
    edges = [df.select(F.lit(k).alias("kind"), F.col(a).alias("source"), F.col(b).alias("target")).distinct() for k, (df, a, b) in links.items()]
    every, between = nodes[0], edges[0]
    for df in nodes[1:]:
        every = every.union(df)
    for df in edges[1:]:
        between = between.union(df)
    touched = between.select(F.col("source").alias("node")).union(between.select("target")).distinct().withColumn("touched", F.lit(True))
    counted = every.join(touched, "node", "left").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("touched").alias("connected"))
    return counted.select("kind", F.lit("node").alias("what"), "n", "connected").union(between.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select("kind", F.lit("edge"), "n", F.lit(None).cast("long")))


def ring_faults(layer: DataFrame, parts: str = "parts", least_area: float = 1.0) -> DataFrame:
    """n, invalid (a ring with fewer than four points, or open, or without area), slivers (a first ring of less than least_area) and their rates, one row."""
    from geoweld.functions.polygons import ring_area

    ring_bad = lambda r: (F.size(r) < 4) | (F.get(r, F.lit(0)) != F.element_at(r, -1))
    area = ring_area(F.get(F.col(parts), F.lit(0)))
    invalid = F.exists(parts, ring_bad) | (area == 0)
    n = F.count(F.lit(1))
    counted = layer.agg(n.alias("n"), F.count_if(invalid).alias("invalid"), F.count_if(~invalid & (area < least_area)).alias("slivers"))
    return counted.withColumn("invalid_rate", F.round(F.col("invalid") / F.greatest(F.col("n"), F.lit(1)), 6))
