"""Summaries of runs, samples, snapshots and tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweld.functions import geometry as G
from geoweld.operators.components import checkpointed
from geoweld.operators.grid_join import grid_join, points
from geoweld.operators.naming import first_rows, row_digest
from geoweld.operators.nearest import nearest_rows
from geoweld.operators.relational import top_k


def by_dimensions(records: DataFrame, dimensions: Sequence[str], at: str, k: int) -> DataFrame:
    """dimension, value, n, successes, last of the k most seen values of each dimension, over the newest max(20 k, 100) records of all."""
    newest = top_k(records, max(20 * k, 100), F.desc(at), row_digest(records))
    each = newest.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions))).alias("d"), "success", F.col(at).alias("at"))
    counted = each.where("d.value IS NOT NULL").groupBy("d.dimension", "d.value").agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("successes"), F.max("at").alias("last"))
    return first_rows(counted, ["dimension"], [F.desc("n"), "value"], k)


def merged_metrics(children: DataFrame, per: str) -> DataFrame:
    """Metrics of child runs (name, kind, flag, number, text, at) in one row each: any of flags, mean of numbers, the last of other values."""
    return children.groupBy(per, "name").agg(
        F.bool_or(F.when(F.col("kind") == "flag", F.col("flag"))).alias("flag"), F.round(F.avg(F.when(F.col("kind") == "number", F.col("number"))), 6).alias("number"),
        F.max_by(F.when(F.col("kind") == "text", F.col("text")), F.when(F.col("kind") == "text", F.struct("at", "text"))).alias("text"),
    )


def layer_changes(before: DataFrame, after: DataFrame, per: str) -> DataFrame:
    """per, n_before, n_after, change: rows of each layer before and after a step."""
    a, b = (df.groupBy(per).agg(F.count(F.lit(1)).alias(n)) for df, n in ((before, "n_before"), (after, "n_after")))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return a.join(b, per, "full_outer").select(per, none("n_before"), none("n_after")).withColumn("change", F.col("n_after") - F.col("n_before"))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """field, value, n and share of the rows that aren't null."""
    each = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))).alias("f")).select("f.*").where("value IS NOT NULL")
    counted = each.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    total = counted.groupBy("field").agg(F.sum("n").alias("all"))
    return counted.join(F.broadcast(total), "field").select("field", "value", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


def snapshot_diff(left: DataFrame, right: DataFrame, key: str, json: str, volatile: Sequence[str]) -> DataFrame:
    """key, bytes_equal, semantic_equal and the paths that differ of two snapshots of JSON objects; volatile names are looked at in bytes only."""
    kind = "map<string,string>"
    fields = lambda c: F.map_filter(F.from_json(c, kind), lambda k, v: ~k.isin(*volatile))
    a, b = left.select(key, F.col(json).alias("a")), right.select(key, F.col(json).alias("b"))
    both = a.join(b, key, "full_outer").withColumns({"m": F.coalesce(fields(F.col("a")), F.from_json(F.lit("{}"), kind)), "n": F.coalesce(fields(F.col("b")), F.from_json(F.lit("{}"), kind))})
    names = F.array_sort(F.array_union(F.map_keys("m"), F.map_keys("n")))
    differ = F.filter(names, lambda k: ~F.try_element_at("m", k).eqNullSafe(F.try_element_at("n", k)))
    same = F.col("a").isNotNull() & F.col("b").isNotNull()
    return both.select(key, F.col("a").eqNullSafe(F.col("b")).alias("bytes_equal"), (same & (F.size(differ) == 0)).alias("semantic_equal"), F.array_join(differ, ",").alias("paths"))


def download_summary(downloads: DataFrame, per: str) -> DataFrame:
    """per, modes (sorted, distinct) and whether any came from a cache."""
    return downloads.groupBy(per).agg(F.array_join(F.array_sort(F.collect_set("mode")), ",").alias("modes"), F.coalesce(F.bool_or("cache_hit"), F.lit(False)).alias("cached"))


def active_counts(runs: DataFrame, phase: str, active: Sequence[str]) -> DataFrame:
    return runs.where(F.col(phase).isin(*active)).groupBy(phase).agg(F.count(F.lit(1)).alias("n"))


def largest_component(coverage: Column) -> Column:
    """The largest count of a map of components; 0 for none."""
    return F.coalesce(F.array_max(F.map_values(coverage)), F.lit(0))


def telemetry(events: DataFrame, per: str, size: str, duration: str) -> DataFrame:
    """per, kinds, n_events, bytes, seconds, slowest of each run's events."""
    return events.groupBy(per).agg(F.count_distinct("kind").alias("kinds"), F.count(F.lit(1)).alias("n_events"), F.sum(size).alias("bytes"), F.round(F.sum(duration), 4).alias("seconds"), F.max_by("kind", F.struct(duration, "kind")).alias("slowest"))


def sample_audit(rows: DataFrame, other: DataFrame, cell: float, k: int = 30) -> DataFrame:
    """id, dist, covered of the first k boxes: how far their middle is from the other layer (null if that is empty), and the largest share of their area that one of its boxes covers."""
    some = top_k(rows, k, F.asc("id"))
    cx, cy = (F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2
    near = nearest_rows(some.select("id", cx.alias("x"), cy.alias("y")), other, cell).select(F.col("a_id").alias("id"), "dist")
    a, b = G.box("a_"), G.box("b_")
    met = grid_join(some, other, cell).groupBy(F.col("a_id").alias("id")).agg(F.max(G.shared_area(a, b) / G.box_area(a)).alias("covered"))
    return some.select("id").join(near, "id", "left").join(met, "id", "left").select("id", F.round("dist", 6).alias("dist"), F.round(F.coalesce("covered", F.lit(0.0)), 6).alias("covered"))


def sampled_from_tiles(boxes: DataFrame, tiles: DataFrame, cell: float) -> DataFrame:
    """id, value: what the tile with a box's middle holds, of several the last; tiles: place (their order), value and bounds."""
    cx, cy = (F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2
    placed = points(boxes.select("id", cx.alias("x"), cy.alias("y")))
    hit = grid_join(placed, tiles, cell).groupBy(F.col("a_id").alias("id")).agg(F.max_by("b_value", "b_place").alias("value"))
    return boxes.select("id").join(hit, "id", "left")


def grounding(plan: DataFrame, patterns: DataFrame, algorithms: DataFrame, types: DataFrame) -> DataFrame:
    """plan, steps, grounded: whether each step's pattern, algorithm and type are among those offered, and so for the whole plan."""
    known = lambda df, c: df.select(c, F.lit(True).alias(f"{c} known")).distinct()
    each = plan.join(known(patterns, "pattern"), "pattern", "left").join(known(algorithms, "algorithm"), "algorithm", "left").join(known(types, "type"), "type", "left")
    fine = F.col("pattern known").isNotNull() & F.col("algorithm known").isNotNull() & F.col("type known").isNotNull()
    return each.groupBy("plan").agg(F.count(F.lit(1)).alias("steps"), F.count_if(fine).alias("fine"), F.bool_and(fine).alias("grounded"))


def deduplicated_slices(rows: DataFrame, ids: Sequence[str], shape: str, line: Column) -> DataFrame:
    """rows of tiles put together: others than lines once for each of their ids within a slice, then all once for each shape within a slice, lines once for each shape.

    ids are the columns to take an id from; the first that the table has counts. The row of the smallest digest stays.
    """
    known = {c.lower(): c for c in rows.columns}
    own = next((F.col(known[c.lower()]).cast("string") for c in ids if c.lower() in known), F.lit(None).cast("string"))
    digest = row_digest(rows)
    areas = rows.where(~line)
    with_id = first_rows(areas.where(own.isNotNull()), ["slice", own], [digest])
    whole = with_id.unionByName(areas.where(own.isNull()))
    return first_rows(whole, ["slice", F.col(shape)], [digest]).unionByName(first_rows(rows.where(line), [F.col(shape)], [digest]))


def separated_boxes(boxes: DataFrame, cell: float, delete_share: float = 0.65) -> DataFrame:
    """id of the boxes that go because a larger one, or of equals the one with the larger id, covers most of them."""
    pairs = grid_join(boxes, boxes, cell, keep=F.col("a_id") < F.col("b_id"))
    a, b = G.box("a_"), G.box("b_")
    left = G.box_area(a) <= G.box_area(b)
    small, area = F.when(left, F.col("a_id")).otherwise(F.col("b_id")), F.least(G.box_area(a), G.box_area(b))
    return pairs.where((area > 0) & (G.shared_area(a, b) >= delete_share * area)).select(small.alias("id")).distinct()


def displaced_boxes(boxes: DataFrame, cell: float, delete_share: float = 0.65, step: float = 3.0, rounds: int = 6, least: float = 0.2) -> DataFrame:
    """id, the box, dx, dy, moved of the boxes that stay once overlaps of `least` area or more are mended.

    Boxes mostly covered by a larger one go first (see separated_boxes). In round i of all pairs that still overlap, but for those of two boxes moved
    before, the smaller box (of equals the one with the smaller id) moves by i times step away from the
    middle of the one it overlaps most, all at once. Of pairs left after the rounds the smaller one goes, so none overlaps. Sizes never change.
    """
    sized = boxes.withColumns({"area": G.box_area(G.box()), "dx": F.lit(0.0), "dy": F.lit(0.0), "moved": F.lit(False)})
    left = checkpointed(sized.join(separated_boxes(boxes, cell, delete_share), "id", "left_anti"))

    def conflicts() -> DataFrame:
        pairs = grid_join(left, left, cell, keep=F.col("a_id") < F.col("b_id"))
        return pairs.withColumn("overlap", G.shared_area(G.box("a_"), G.box("b_"))).where(F.col("overlap") >= least)

    first = F.col("a_area") <= F.col("b_area")
    pick = lambda c, own: F.when(first, F.col(f"{'a' if own else 'b'}_{c}")).otherwise(F.col(f"{'b' if own else 'a'}_{c}"))
    middle = lambda c, own: (pick(f"min{c}", own) + pick(f"max{c}", own)) / 2
    for i in range(1, rounds + 1):
        way = F.struct((middle("x", True) - middle("x", False)).alias("x"), (middle("y", True) - middle("y", False)).alias("y"))
        told = conflicts().where(~(F.col("a_moved") & F.col("b_moved"))).select(pick("id", True).alias("id"), way.alias("way"), F.struct("overlap", (-pick("id", False)).alias("other")).alias("by"))
        moves = checkpointed(told.groupBy("id").agg(F.max_by("way", "by").alias("way")))
        if moves.isEmpty():
            break
        x, y = F.col("way.x"), F.col("way.y")
        far = F.sqrt(x * x + y * y)
        go = [F.when(F.col("way").isNull(), 0.0).when(far > 0, i * step * v / far).otherwise(alone) for v, alone in ((x, i * step), (y, 0.0))]
        shifted = left.join(moves, "id", "left").withColumns({"goes x": go[0], "goes y": go[1]})
        new = {f"{end}{c}": F.col(f"{end}{c}") + F.col(f"goes {c}") for end in ("min", "max", "d") for c in "xy"}
        left = checkpointed(shifted.withColumns({**new, "moved": F.col("moved") | F.col("way").isNotNull()}).drop("way", "goes x", "goes y"))
    return left.join(conflicts().select(pick("id", True).alias("id")).distinct(), "id", "left_anti").drop("area")


def clipped_boxes(boxes: DataFrame, window: tuple[float, float, float, float]) -> DataFrame:
    """The boxes that share area with the window, cut to it."""
    x1, y1, x2, y2 = map(F.lit, window)
    cut = boxes.withColumns({"minx": F.greatest("minx", x1), "miny": F.greatest("miny", y1), "maxx": F.least("maxx", x2), "maxy": F.least("maxy", y2)})
    return cut.where("minx < maxx AND miny < maxy")
