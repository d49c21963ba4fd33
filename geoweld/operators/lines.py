"""Line operators. A segment is (id, x1, y1, x2, y2); a polyline is an array of points (x, y)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweld.functions import geometry as G
from geoweld.functions.polygons import line_length
from geoweld.operators.components import checkpointed, connected_components
from geoweld.operators.grid_join import corner_join, grid_join

ENDS = ("x1", "y1", "x2", "y2")
#: Direction and length of segments, under names that no layer has.
WAY, LONG = "way of the line", "length of the line"
#: What rounding may add to a distance, where boxes rule out pairs that are looked at more closely later.
SLACK = 1e-6


def segment(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(prefix + c) for c in ENDS)


def boxed(segments: DataFrame) -> DataFrame:
    x1, y1, x2, y2 = segment()
    return segments.withColumns({"minx": F.least(x1, x2), "miny": F.least(y1, y2), "maxx": F.greatest(x1, x2), "maxy": F.greatest(y1, y2)})


def length(s: tuple[Column, ...]) -> Column:
    return G.distance(*s)


def measured(segments: DataFrame) -> DataFrame:
    """segments boxed, with direction and length, which a join would work out for each pair otherwise."""
    return boxed(segments).withColumns({WAY: G.bearing(*segment()), LONG: length(segment())})


def line_candidates(base: DataFrame, other: DataFrame, cell: float, radius: float = 20.0, angle: float = 45.0, similar: float = 0.2, hausdorff: float = 15.0) -> DataFrame:
    """Pairs near each other, of like direction and length; the dearest test comes last."""
    a, b = segment("a_"), segment("b_")
    p, q = G.box("a_"), G.box("b_")
    meet = G.boxes_meet((p[0] - radius, p[1] - radius, p[2] + radius, p[3] + radius), q)
    near = corner_join(measured(base), measured(other), cell, hausdorff + SLACK, meet).withColumns({
        "angle_diff_deg": G.angle_difference(F.col(f"a_{WAY}"), F.col(f"b_{WAY}")), "length_similarity": G.length_similarity(F.col(f"a_{LONG}"), F.col(f"b_{LONG}")),
    }).drop(*(f"{k}_{c}" for k in "ab" for c in (WAY, LONG)))
    alike = near.where((F.col("angle_diff_deg") <= angle) & (F.col("length_similarity") >= similar))
    return alike.withColumn("hausdorff_m", G.vertex_hausdorff(a, b)).where(F.col("hausdorff_m") <= hausdorff)


def with_covered_interval(pairs: DataFrame, radius: float) -> DataFrame:
    """pairs with `part`: where along segment a_ (0 to 1) the distance to segment b_ is at most radius, as (lo, hi); null if nowhere.

    Within the radius of a segment is a convex set, so a line meets it in one
    interval: the hull of those in which it meets the two end circles and the strip
    between. Steps are columns of their own, so that none is worked out twice; a filter on part would be pushed down
    and undo that, so leave nulls to an aggregate.
    """
    c = F.col
    sx1, sy1, sx2, sy2 = segment("a_")
    bx1, by1, bx2, by2 = segment("b_")
    made = pairs.withColumns({"_dx": sx2 - sx1, "_dy": sy2 - sy1, "_ux": bx2 - bx1, "_uy": by2 - by1})
    made = made.withColumns({"_sq": c("_dx") * c("_dx") + c("_dy") * c("_dy"), "_long": F.sqrt(c("_ux") * c("_ux") + c("_uy") * c("_uy"))})
    unit = F.when(c("_long") > 0, c("_long"))
    per = F.when(c("_sq") > 0, c("_sq"))
    step = {
        "_p0": ((sx1 - bx1) * c("_ux") + (sy1 - by1) * c("_uy")) / unit, "_p1": ((sx2 - bx1) * c("_ux") + (sy2 - by1) * c("_uy")) / unit,
        "_q0": ((sy1 - by1) * c("_ux") - (sx1 - bx1) * c("_uy")) / unit, "_q1": ((sy2 - by1) * c("_ux") - (sx2 - bx1) * c("_uy")) / unit,
    }
    for k, (px, py) in enumerate(((bx1, by1), (bx2, by2))):
        fx, fy = sx1 - px, sy1 - py
        step |= {f"_half{k}": (fx * c("_dx") + fy * c("_dy")) / per, f"_rest{k}": (fx * fx + fy * fy - radius * radius) / per}
    made = made.withColumns(step)
    made = made.withColumns({f"_root{k}": c(f"_half{k}") * c(f"_half{k}") - c(f"_rest{k}") for k in (0, 1)} | {"_dp": c("_p1") - c("_p0"), "_dq": c("_q1") - c("_q0")})
    step = {}
    for k in (0, 1):  # roots of the circles; null where the line misses one
        root = F.sqrt(F.when(c(f"_root{k}") >= 0, c(f"_root{k}")))
        step |= {f"_lo{k}": -c(f"_half{k}") - root, f"_hi{k}": -c(f"_half{k}") + root}
    for v, d, low, high in (("_p0", "_dp", F.lit(0.0), c("_long")), ("_q0", "_dq", F.lit(-radius), F.lit(radius))):
        slope = F.when(c(d) != 0, c(d))
        level = F.when((c(d) == 0) & c(v).between(low, high), 1.0)
        step |= {f"{d}a": F.coalesce((low - c(v)) / slope, level - 1.0), f"{d}b": F.coalesce((high - c(v)) / slope, level)}
    made = made.withColumns(step)
    zero, one = F.lit(0.0), F.lit(1.0)
    step = {}
    for k in (0, 1):
        real = (c(f"_hi{k}") >= 0) & (c(f"_lo{k}") <= 1)
        step |= {f"_a{k}": F.when(real, F.greatest(c(f"_lo{k}"), zero)), f"_b{k}": F.when(real, F.least(c(f"_hi{k}"), one))}
    known = c("_dpa").isNotNull() & c("_dqa").isNotNull()
    step |= {
        "_a2": F.when(known, F.greatest(F.least("_dpa", "_dpb"), F.least("_dqa", "_dqb"), zero)),
        "_b2": F.when(known, F.least(F.greatest("_dpa", "_dpb"), F.greatest("_dqa", "_dqb"), one)),
    }
    made = made.withColumns(step)
    strip = c("_a2") <= c("_b2")
    low, high = F.least("_a0", "_a1", F.when(strip, c("_a2"))), F.greatest("_b0", "_b1", F.when(strip, c("_b2")))
    return made.withColumn("part", F.when(low.isNotNull(), F.struct(low.alias("lo"), high.alias("hi")))).select(*pairs.columns, "part")


def union_length(intervals: Column) -> Column:
    """Measure of the union of an array of (lo, hi)."""
    start = F.struct(F.lit(0.0).alias("total"), F.lit(-1.0).alias("upto"))
    step = lambda acc, x: F.struct(
        (acc["total"] + F.greatest(F.lit(0.0), x["hi"] - F.greatest(x["lo"], acc["upto"]))).alias("total"),
        F.greatest(acc["upto"], x["hi"]).alias("upto"),
    )
    return F.aggregate(F.array_sort(intervals), start, step, lambda acc: acc["total"])


def coverage(supplement: DataFrame, base: DataFrame, cell: float, radius: float) -> DataFrame:
    """a_id, covered: the share of each supplement segment within radius of the base's segments, 0 where none is near."""
    near = grid_join(boxed(supplement), boxed(base), cell, radius)
    parts = with_covered_interval(near, radius)
    found = parts.groupBy("a_id").agg(union_length(F.collect_list("part")).alias("covered"))
    every = supplement.select(F.col("id").alias("a_id"))
    return every.join(found, "a_id", "left").select("a_id", F.coalesce("covered", F.lit(0.0)).alias("covered"))


def residuals(supplement: DataFrame, base: DataFrame, cell: float, radius: float, least: float = 10.0) -> DataFrame:
    """id, part, x1, y1, x2, y2: what of each supplement segment lies beyond radius of the base, parts of `least` length or more."""
    near = grid_join(boxed(supplement), boxed(base), cell, radius)
    return beyond(supplement, with_covered_interval(near, radius), least)


def erased_by_boxes(segments: DataFrame, boxes: DataFrame, cell: float, least: float = 0.0) -> DataFrame:
    """id, part, x1, y1, x2, y2: what of each segment lies outside all boxes, parts longer than `least`."""
    x1, y1, x2, y2 = segment("a_")
    near = grid_join(boxed(segments), boxes, cell)

    def span(a: Column, b: Column, low: str, high: str) -> tuple[Column, Column]:
        d = F.when(a != b, b - a)
        ends = (F.col(low) - a) / d, (F.col(high) - a) / d
        flat = F.when((a == b) & a.between(F.col(low), F.col(high)), F.lit(1.0))
        return F.coalesce(F.least(*ends), flat - 1.0), F.coalesce(F.greatest(*ends), flat)

    (p, q), (r, s) = span(x1, x2, "b_minx", "b_maxx"), span(y1, y2, "b_miny", "b_maxy")
    cut = near.withColumns({"from x": p, "to x": q, "from y": r, "to y": s})
    lo, hi = F.greatest(F.col("from x"), F.col("from y"), F.lit(0.0)), F.least(F.col("to x"), F.col("to y"), F.lit(1.0))
    both = F.col("from x").isNotNull() & F.col("from y").isNotNull() & (lo < hi)
    return beyond(segments, cut.select("a_id", F.when(both, F.struct(lo.alias("lo"), hi.alias("hi"))).alias("part")), least)


def beyond(supplement: DataFrame, parts: DataFrame, least: float) -> DataFrame:
    """id, part, x1, y1, x2, y2: the segments without the intervals (a_id, part) of them, parts of `least` length or more."""
    found = parts.groupBy("a_id").agg(F.array_sort(F.collect_list("part")).alias("covered"))
    rows = supplement.join(found, F.col("id") == F.col("a_id"), "left")
    empty = F.array().cast("array<struct<lo:double,hi:double>>")
    start = F.struct(empty.alias("gaps"), F.lit(0.0).alias("upto"))
    step = lambda acc, x: F.struct(
        F.when(x["lo"] > acc["upto"], F.concat(acc["gaps"], F.array(F.struct(acc["upto"].alias("lo"), x["lo"].alias("hi"))))).otherwise(acc["gaps"]).alias("gaps"),
        F.greatest(acc["upto"], x["hi"]).alias("upto"),
    )
    close = lambda acc: F.when(acc["upto"] < 1, F.concat(acc["gaps"], F.array(F.struct(acc["upto"].alias("lo"), F.lit(1.0).alias("hi"))))).otherwise(acc["gaps"])
    gaps = F.aggregate(F.coalesce("covered", empty), start, step, close)
    x1, y1, x2, y2 = segment()
    long = length((x1, y1, x2, y2))
    kept = rows.withColumn("gap", F.explode(F.filter(gaps, lambda g: (g["hi"] - g["lo"]) * long >= least)))
    at = lambda t: (x1 + t * (x2 - x1), y1 + t * (y2 - y1))
    (p, q), (r, s) = at(F.col("gap.lo")), at(F.col("gap.hi"))
    made = kept.select("id", F.col("gap.lo").alias("lo"), p.alias("x1"), q.alias("y1"), r.alias("x2"), s.alias("y2"))
    from pyspark.sql import Window

    return made.withColumn("part", F.row_number().over(Window.partitionBy("id").orderBy("lo"))).drop("lo")


def snapped_endpoints(supplement: DataFrame, base: DataFrame, cell: float, radius: float = 10.0) -> DataFrame:
    """id, end (1 or 2), x, y, snapped: each end moved to the nearest point of a base segment within radius."""
    ends = supplement.select("id", F.explode(F.array(*(F.struct(F.lit(k).alias("end"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (1, 2)))).alias("e")).select("id", "e.*")
    placed = ends.withColumns({"minx": F.col("x"), "miny": F.col("y"), "maxx": F.col("x"), "maxy": F.col("y")})
    b = segment("b_")
    near = grid_join(placed, boxed(base), cell, radius).withColumn("d", G.point_segment_distance(F.col("a_x"), F.col("a_y"), *b)).where(F.col("d") <= radius)
    dx, dy = b[2] - b[0], b[3] - b[1]
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(((F.col("a_x") - b[0]) * dx + (F.col("a_y") - b[1]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))))
    point = F.struct((b[0] + t * dx).alias("px"), (b[1] + t * dy).alias("py"))
    best = near.groupBy(F.col("a_id").alias("id"), F.col("a_end").alias("end")).agg(F.min_by(point, F.struct("d", "b_id")).alias("to"))
    return ends.join(best, ["id", "end"], "left").select("id", "end", F.coalesce("to.px", "x").alias("x"), F.coalesce("to.py", "y").alias("y"), F.col("to").isNotNull().alias("snapped"))


def snapped_segments(supplement: DataFrame, base: DataFrame, cell: float, radius: float = 10.0, bend: float = 35.0, least: float = 1.0) -> DataFrame:
    """Segments (id, x1, y1, x2, y2) with their ends at the base's nearest points within radius; one that would turn by more than bend, or be shorter than least, stays as it is."""
    to = snapped_endpoints(supplement, base, cell, radius).groupBy("id").agg(*(F.max(F.when(F.col("end") == k, F.col(c))).alias(f"to {c}{k}") for k in (1, 2) for c in "xy"))
    moved = supplement.select("id", *segment()).join(to, "id")
    new = tuple(F.col(f"to {c}") for c in ENDS)
    old = segment()
    dot = (old[2] - old[0]) * (new[2] - new[0]) + (old[3] - old[1]) * (new[3] - new[1])
    turned = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / F.nullif(length(old) * length(new), F.lit(0.0))))))
    fine = (length(new) >= least) & (F.coalesce(turned, F.lit(0.0)) <= bend)
    return moved.select("id", *(F.when(fine, n).otherwise(o).alias(c) for c, n, o in zip(ENDS, new, old, strict=True)))


def duplicate_supplements(supplement: DataFrame, base: DataFrame, cell: float, angle: float = 25.0, near: float = 8.0, least: float = 0.92, longest: float = 1.5, whole: float = 0.98, pairs: DataFrame | None = None) -> DataFrame:
    """id of the supplement segments that one base segment doubles. pairs, if given, are all pairs of them within near or more."""
    a, b = segment("a_"), segment("b_")
    pairs = grid_join(boxed(supplement), boxed(base), cell, near) if pairs is None else pairs
    like = with_covered_interval(pairs.where(G.angle_difference(G.bearing(*a), G.bearing(*b)) <= angle), near)
    like = like.withColumn("covered", F.coalesce(F.col("part.hi") - F.col("part.lo"), F.lit(0.0)))
    dup = (F.col("covered") >= least) & ((length(a) <= longest * length(b)) | (F.col("covered") >= whole))
    return like.groupBy(F.col("a_id").alias("id")).agg(F.bool_or(dup).alias("dup")).where("dup").select("id")


def split_at_sharp_turns(lines: DataFrame, least_angle: float = 135.0, least: float = 0.0) -> DataFrame:
    """id, part, points: polylines (id, points array<struct<x,y>>) cut at vertices that turn more sharply; parts no longer than `least` go, part counts them all."""
    p = F.col("points")
    at = lambda i: F.get(p, i)
    angle = lambda i: G.turn_angle(at(i - 1)["x"], at(i - 1)["y"], at(i)["x"], at(i)["y"], at(i + 1)["x"], at(i + 1)["y"])
    inner = F.when(F.size(p) > 2, F.sequence(F.lit(1), F.size(p) - 2)).otherwise(F.array().cast("array<int>"))
    cuts = F.concat(F.array(F.lit(0)), F.filter(inner, lambda i: angle(i) < least_angle), F.array(F.size(p) - 1))
    cut = lines.where(F.size("points") > 1).withColumn("cuts", cuts)
    spans = F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), lambda k: F.slice(p, F.get("cuts", k) + 1, F.get("cuts", k + 1) - F.get("cuts", k) + 1))
    return cut.select("id", F.posexplode(spans).alias("part", "points")).where(line_length(F.col("points")) > least)


def split_by_length(segments: DataFrame, most: float, least: float = 0.0) -> DataFrame:
    """id, part (from 1), x1, y1, x2, y2: each segment in pieces of length `most` and a rest; pieces no longer than `least` go."""
    long = length(segment())
    n = F.greatest(F.ceil(long / most), F.lit(1)).cast("int")
    cut = segments.select("id", *segment(), long.alias("long"), n.alias("n")).withColumn("part", F.explode(F.sequence(F.lit(1), F.col("n"))))
    low, high = (F.col("part") - 1) * most, F.least(F.col("part") * most, F.col("long"))
    at = lambda a, b, d: F.when(d == F.col("long"), F.col(b)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * d / F.col("long"))
    return cut.where(high - low > least).select("id", "part", at("x1", "x2", low).alias("x1"), at("y1", "y2", low).alias("y1"), at("x1", "x2", high).alias("x2"), at("y1", "y2", high).alias("y2"))


def ring_segments(layer: DataFrame) -> DataFrame:
    """id, part, place, x1, y1, x2, y2: the lines, and the rings of polygons, of a layer (id, parts) as segments in order."""
    each = layer.select("id", F.posexplode("parts").alias("part", "ring")).where(F.size("ring") > 1)
    pairs = F.transform(F.slice("ring", 2, F.size("ring")), lambda q, i: F.struct(F.get("ring", i).alias("p"), q.alias("q")))
    made = each.select("id", "part", F.posexplode(pairs).alias("place", "s"))
    return made.select("id", "part", "place", F.col("s.p.x").alias("x1"), F.col("s.p.y").alias("y1"), F.col("s.q.x").alias("x2"), F.col("s.q.y").alias("y2"))


def directed(segments: DataFrame) -> DataFrame:
    """Segments that start at their lower left end, so that one drawn either way is the same."""
    x1, y1, x2, y2 = segment()
    turn = (x1 > x2) | ((x1 == x2) & (y1 > y2))
    pick = lambda a, b: F.when(turn, b).otherwise(a)
    return segments.withColumns({"x1": pick(x1, x2), "y1": pick(y1, y2), "x2": pick(x2, x1), "y2": pick(y2, y1)})


def joined_ends(segments: DataFrame, cell: float, radius: float) -> DataFrame:
    """Segments whose ends that lie within radius of each other, by steps, are moved to one place, that of the least of them in order."""
    ends = segments.select("id", F.explode(F.array(*(F.struct(F.lit(k).alias("end"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (1, 2)))).alias("e")).select("id", "e.*")
    node = F.struct("x", "y")
    places = ends.select("x", "y").distinct().withColumns({"minx": F.col("x"), "miny": F.col("y"), "maxx": F.col("x"), "maxy": F.col("y")})
    near = grid_join(places, places, cell, radius).where(G.distance(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y")) <= radius)
    links = near.select(F.struct(F.col("a_x").alias("x"), F.col("a_y").alias("y")).alias("a"), F.struct(F.col("b_x").alias("x"), F.col("b_y").alias("y")).alias("b"))
    of = checkpointed(connected_components(links))
    moved = ends.withColumn("node", node).join(of, "node", "left").select("id", "end", F.coalesce("component", "node").alias("to"))
    both = moved.groupBy("id").agg(F.max(F.when(F.col("end") == 1, F.col("to"))).alias("p"), F.max(F.when(F.col("end") == 2, F.col("to"))).alias("q"))
    return segments.drop(*ENDS).join(both, "id").select(*(c for c in segments.columns if c not in ENDS), F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("q.x").alias("x2"), F.col("q.y").alias("y2"))


def planarized(segments: DataFrame, cell: float, digits: int = 6) -> DataFrame:
    """id, part, x1, y1, x2, y2: segments cut where others cross or touch them within, so that they meet at ends only.

    Places along a segment are told apart to so many digits of its length. Lines that lie on each other aren't cut.
    """
    x1, y1, x2, y2 = segment("a_")
    x3, y3, x4, y4 = segment("b_")
    pairs = grid_join(boxed(segments), boxed(segments), cell, keep=F.col("a_id") != F.col("b_id"))
    across = (x2 - x1) * (y4 - y3) - (y2 - y1) * (x4 - x3)
    step = F.nullif(across, F.lit(0.0))
    cut = pairs.select(F.col("a_id").alias("id"), (((x3 - x1) * (y4 - y3) - (y3 - y1) * (x4 - x3)) / step).alias("t"), (((x3 - x1) * (y2 - y1) - (y3 - y1) * (x2 - x1)) / step).alias("u"))
    # rounded before it is judged, as a touch may come out a hair beyond an end
    at = F.round("t", digits)
    inner = F.when((at > 0) & (at < 1) & (F.round("u", digits).between(0.0, 1.0)), at)
    found = cut.groupBy("id").agg(F.array_sort(F.collect_set(inner)).alias("cuts"))
    ends = F.concat(F.array(F.lit(0.0)), F.coalesce("cuts", F.array().cast("array<double>")), F.array(F.lit(1.0)))
    spans = F.transform(F.slice(ends, 2, F.size(ends)), lambda hi, i: F.struct(F.get(ends, i).alias("lo"), hi.alias("hi")))
    each = segments.join(found, "id", "left").select("id", *segment(), F.posexplode(spans).alias("part", "s"))
    place = lambda a, b, t: F.col(a) + (F.col(b) - F.col(a)) * F.col(f"s.{t}")
    return each.select("id", "part", place("x1", "x2", "lo").alias("x1"), place("y1", "y2", "lo").alias("y1"), place("x1", "x2", "hi").alias("x2"), place("y1", "y2", "hi").alias("y2"))


def suppressed_in_order(edges: DataFrame) -> DataFrame:
    """id of the rows that the sequential rule drops: from the first on, a row that stands drops those it has an edge to.

    edges (id, other) mean that `id`, if it stands, drops `other`, a later one. In each round the rows that no row left
    could drop stand, and what they drop leaves with its edges; there are as many rounds as the
    longest chain of rows that wait for each other.
    """
    left, gone = checkpointed(edges.select("id", "other").distinct()), []
    while not left.isEmpty():
        stands = left.select("id").distinct().join(left.select(F.col("other").alias("id")), "id", "left_anti")
        hit = checkpointed(left.join(stands, "id").select(F.col("other").alias("id")).distinct())
        gone.append(hit)
        rest = left.join(stands, "id", "left_anti").join(hit, "id", "left_anti")
        left = checkpointed(rest.join(hit.select(F.col("id").alias("other")), "other", "left_anti").select("id", "other"))
    return reduce(DataFrame.union, gone) if gone else edges.select("id").limit(0)
