"""Lines of any number of vertices, by linear referencing.

A line is (id, points). Its segments carry where they begin along it, so that what a
segment pair tells (where one runs within a radius of the other) becomes an interval of the line's own
measure, from 0 to 1, and intervals of all its segments unite over the whole line.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweld.functions import geometry as G
from geoweld.functions.geometry import BOX
from geoweld.functions.polygons import _sides, bounds, line_length
from geoweld.operators.components import checkpointed
from geoweld.operators.grid_join import grid_join
from geoweld.operators.lines import SLACK, union_length, with_covered_interval

INTERVALS = "array<struct<lo:double,hi:double>>"


def _distance(p: Column, q: Column) -> Column:
    return F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"]))


def measures(points: Column) -> Column:
    """How far along the line each of its points is, in length."""
    start = F.struct(F.array(F.lit(0.0)).alias("all"), F.lit(0.0).alias("upto"))

    def step(acc: Column, s: Column) -> Column:
        upto = acc["upto"] + _distance(s["p"], s["q"])
        return F.struct(F.concat(acc["all"], F.array(upto)).alias("all"), upto.alias("upto"))

    return F.aggregate(_sides(points), start, step, lambda acc: acc["all"])


def point_at(points: Column, along: Column, at: Column) -> Column:
    """The point of a line at a length along it; along are the line's measures."""
    i = F.greatest(F.lit(0), F.least(F.size(points) - 2, F.size(F.filter(along, lambda m: m <= at)) - 1))
    p, q, a, b = F.get(points, i), F.get(points, i + 1), F.get(along, i), F.get(along, i + 1)
    t = F.when(b > a, (at - a) / (b - a)).otherwise(0.0)
    return F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"))


def part_of(points: Column, along: Column, low: Column, high: Column) -> Column:
    """The part of a line between two lengths along it."""
    inner = F.transform(F.filter(F.arrays_zip(points.alias("p"), along.alias("m")), lambda z: (z["m"] > low) & (z["m"] < high)), lambda z: z["p"])
    return F.concat(F.array(point_at(points, along, low)), inner, F.array(point_at(points, along, high)))


def line_segments(lines: DataFrame) -> DataFrame:
    """id, place, x1, y1, x2, y2, lo, hi: a line's segments of some length, and which share of it each takes up."""
    made = lines.select("id", "points", measures(F.col("points")).alias("m")).withColumn("long", F.element_at("m", -1))
    each = made.where("long > 0").select("id", "long", F.posexplode(F.arrays_zip(_sides(F.col("points")).alias("s"), F.col("m"))).alias("place", "z"))
    s, m = F.col("z.s"), F.col("z.m")
    ends = [s["p"]["x"].alias("x1"), s["p"]["y"].alias("y1"), s["q"]["x"].alias("x2"), s["q"]["y"].alias("y2")]
    return each.select("id", "place", *ends, (m / F.col("long")).alias("lo"), ((m + _distance(s["p"], s["q"])) / F.col("long")).alias("hi")).where("hi > lo")


def line_direction(points: Column) -> Column:
    """From the first point to the last, in degrees within [0, 180); 0 where they are one."""
    p, q = F.get(points, F.lit(0)), F.element_at(points, -1)
    return F.when((p["x"] == q["x"]) & (p["y"] == q["y"]), 0.0).otherwise(G.bearing(p["x"], p["y"], q["x"], q["y"]))


def vertex_hausdorff(p: Column, q: Column) -> Column:
    """Discrete Hausdorff distance: over vertices alone, both ways."""
    one = lambda a, b: F.array_max(F.transform(a, lambda v: F.array_min(F.transform(b, lambda w: _distance(v, w)))))
    return F.greatest(one(p, q), one(q, p))


#: Vertices and sides that are compared at a time.
COMPARED = 1 << 18


def _farthest(p: pa.Array, q: pa.Array) -> np.ndarray:
    """For each pair of lines how far the vertices of p lie from q at most; nan where there is no vertex or no side."""
    offsets = [np.asarray(x.offsets, np.int64) for x in (p, q)]
    size = [np.asarray(pc.fill_null(pc.list_value_length(x), 0), np.int64) for x in (p, q)]
    (px, py), (qx, qy) = ([np.asarray(x.values.field(c), np.float64) for c in "xy"] for x in (p, q))
    sides = np.maximum(size[1] - 1, 0)
    v = np.repeat(np.arange(len(p)), np.where(sides > 0, size[0], 0))  # the pair of each vertex
    first = np.cumsum(np.bincount(v, minlength=len(p))) - np.bincount(v, minlength=len(p))
    at = offsets[0][v] + np.arange(len(v)) - first[v]
    near = np.full(len(v), np.inf)
    upto = np.cumsum(sides[v])
    low = 0
    while low < len(v):  # a vertex's sides stay together where they are no more than that
        high = max(low + 1, int(np.searchsorted(upto, upto[low] - sides[v[low]] + COMPARED, "right")))
        for begin in range(0, int(sides[v[low]]) if high == low + 1 else 1, COMPARED):
            n = np.minimum(sides[v[low:high]] - begin, COMPARED)
            i = np.repeat(np.arange(low, high), n)
            start = np.cumsum(n) - n
            j = offsets[1][v[i]] + begin + np.arange(len(i)) - np.repeat(start, n)
            x, y, x1, y1 = px[at[i]], py[at[i]], qx[j], qy[j]
            dx, dy = qx[j + 1] - x1, qy[j + 1] - y1
            squared = dx * dx + dy * dy
            t = np.clip(np.divide((x - x1) * dx + (y - y1) * dy, squared, out=np.zeros(len(i)), where=squared > 0), 0.0, 1.0)
            ox, oy = x1 + t * dx - x, y1 + t * dy - y
            near[low:high] = np.minimum(near[low:high], np.minimum.reduceat(np.sqrt(ox * ox + oy * oy), start))
        low = high
    far = np.full(len(p), -np.inf)
    np.maximum.at(far, v, near)
    return np.where(np.isinf(far) & (far < 0), np.nan, far)


def line_hausdorff(p: Column, q: Column) -> Column:
    """Hausdorff distance from vertices to the other line, both ways; null where a line has less than two points."""

    @F.arrow_udf("double")
    def far(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            found = np.maximum(_farthest(a, b), _farthest(b, a))
            yield pa.array(found, mask=np.isnan(found))

    # told to be nondeterministic so that filters on it aren't pushed down, which would work it out twice
    return far.asNondeterministic()(p, q)


def boxed_lines(lines: DataFrame) -> DataFrame:
    b = bounds(F.col("points"))
    return lines.withColumns({c: b[c] for c in BOX})


def covered_parts(pairs: DataFrame, lines: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """a_id, b_id, parts: for each pair of lines where line a_ (0 to 1) runs within radius of line b_, as intervals that may overlap."""
    a = line_segments(lines).select(F.col("id").alias("a_id"), *(F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2", "lo", "hi")))
    b = line_segments(others).select(F.col("id").alias("b_id"), *(F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")))
    apart = lambda c: (F.least(f"a_{c}1", f"a_{c}2") - radius > F.greatest(f"b_{c}1", f"b_{c}2")) | (F.least(f"b_{c}1", f"b_{c}2") > F.greatest(f"a_{c}1", f"a_{c}2") + radius)
    met = pairs.select("a_id", "b_id").join(a, "a_id").join(b, "b_id").where(~apart("x") & ~apart("y"))
    made = with_covered_interval(met, radius)
    own = F.struct(*((F.col("a_lo") + F.col(f"part.{k}") * (F.col("a_hi") - F.col("a_lo"))).alias(k) for k in ("lo", "hi")))
    return made.groupBy("a_id", "b_id").agg(F.collect_list(F.when(F.col("part").isNotNull(), own)).alias("parts"))


def measured_lines(lines: DataFrame) -> DataFrame:
    """id, points, their box, long and way of each line, in a copy, as joins by boxes look at both sides more than once."""
    several = F.size("points") > 1
    made = boxed_lines(lines.select("id", "points")).withColumns({"long": F.when(several, line_length(F.col("points"))), "way": F.when(several, line_direction(F.col("points")))})
    return checkpointed(made)


def _near_lines(base: DataFrame, other: DataFrame, cell: float, radius: float, angle: float, similar: float, keep: Column) -> DataFrame:
    """a_id, b_id, angle, similarity of measured lines near each other that are alike in direction and length."""
    slim = [x.where("long > 0").select("id", *BOX, "long", "way") for x in (base, other)]
    near = grid_join(*slim, cell, radius, keep).withColumns({"angle": G.angle_difference(F.col("a_way"), F.col("b_way")), "similarity": G.length_similarity(F.col("a_long"), F.col("b_long"))})
    return near.where((F.col("angle") <= angle) & (F.col("similarity") >= similar))


def lines_within(base: DataFrame, other: DataFrame, cell: float, most: float, radius: float = 20.0, angle: float = 45.0, similar: float = 0.05) -> DataFrame:
    """a_id, b_id, hausdorff: lines whose boxes come within radius, alike in direction and length, with a discrete Hausdorff distance of up to `most`.

    Every vertex then has one of the other line within `most`, so sides of the boxes are no farther apart either, which spares
    most pairs the look at their vertices.
    """
    a, b = G.box("a_"), G.box("b_")
    sides = reduce(Column.__and__, (F.abs(p - q) <= most + SLACK for p, q in zip(a, b, strict=True)))
    made = [measured_lines(x) for x in (base, other)]
    pairs = _near_lines(*made, cell, radius, angle, similar, sides).select("a_id", "b_id")
    p, q = (x.select(F.col("id").alias(f"{k}_id"), F.col("points").alias(f"{k}_points")) for k, x in zip("ab", made, strict=True))
    far = pairs.join(p, "a_id").join(q, "b_id").select("a_id", "b_id", vertex_hausdorff(F.col("a_points"), F.col("b_points")).alias("hausdorff"))
    return checkpointed(far).where(F.col("hausdorff") <= most)


def _matches(base: DataFrame, other: DataFrame, cell: float, radius: float = 20.0, angle: float = 45.0, similar: float = 0.05, least: float = 0.80, hausdorff: float = 15.0) -> DataFrame:
    """matched_lines of measured lines, with `parts`, where along b the base line covers it."""
    a, b = G.box("a_"), G.box("b_")
    # what of b lies beyond the base line's box and radius is as long as it reaches out, to either side
    spare = F.greatest(F.lit(0.0), F.lit(1.0 - least)) * F.col("b_long") + SLACK
    out = lambda d: F.greatest(F.lit(0.0), d - radius)
    inside = reduce(Column.__and__, (out(a[i] - b[i]) + out(b[i + 2] - a[i + 2]) <= spare for i in (0, 1)))
    alike = checkpointed(_near_lines(base, other, cell, radius, angle, similar, inside).select("a_id", "b_id", "angle", "similarity"))
    turned = alike.select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"))
    parts = covered_parts(turned, other, base, radius).select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), "parts", union_length(F.col("parts")).alias("covered"))
    good = alike.join(checkpointed(parts).where(F.col("covered") >= least), ["a_id", "b_id"])
    p, q = (x.select(F.col("id").alias(f"{k}_id"), F.col("points").alias(f"{k}_points")) for k, x in (("a", base), ("b", other)))
    far = good.join(p, "a_id").join(q, "b_id").withColumn("hausdorff", line_hausdorff(F.col("a_points"), F.col("b_points")))
    return far.select("a_id", "b_id", "angle", "similarity", "covered", "hausdorff", F.when(F.col("hausdorff") <= hausdorff, 1).otherwise(2).alias("label"), "parts")


def matched_lines(base: DataFrame, other: DataFrame, cell: float, radius: float = 20.0, angle: float = 45.0, similar: float = 0.05, least: float = 0.80, hausdorff: float = 15.0) -> DataFrame:
    """a_id, b_id, angle, similarity, covered, hausdorff, label of lines of other (b) that a base line (a) covers.

    Of lines near each other and alike in direction and length, those match that lie for a share `least` or more of their length within
    radius of the base line. label is 1 up to the given Hausdorff distance, 2 beyond it.
    """
    return _matches(measured_lines(base), measured_lines(other), cell, radius, angle, similar, least, hausdorff).drop("parts")


def gaps(parts: Column) -> Column:
    """What of 0 to 1 an array of intervals leaves, in order."""
    empty = F.array().cast(INTERVALS)
    start = F.struct(empty.alias("gaps"), F.lit(0.0).alias("upto"))
    one = lambda lo, hi: F.array(F.struct(lo.alias("lo"), hi.alias("hi")))
    step = lambda acc, x: F.struct(
        F.when(x["lo"] > acc["upto"], F.concat(acc["gaps"], one(acc["upto"], x["lo"]))).otherwise(acc["gaps"]).alias("gaps"),
        F.greatest(acc["upto"], x["hi"]).alias("upto"),
    )
    close = lambda acc: F.when(acc["upto"] < 1, F.concat(acc["gaps"], one(acc["upto"], F.lit(1.0)))).otherwise(acc["gaps"])
    return F.aggregate(F.array_sort(F.coalesce(parts, empty)), start, step, close)


def fused_lines(base: DataFrame, other: DataFrame, cell: float, radius: float = 20.0, least_part: float = 10.0, **rules: float) -> DataFrame:
    """role, id, part, label1, label2, points: the base lines with the lines they match by label, and what other adds.

    A line of other that matches no base line is a supplement; of one that does, the parts longer than least_part that lie beyond radius of
    all base lines it matches are residuals, part from 1. Labels are ids in order, joined by commas.
    """
    base, other = measured_lines(base), measured_lines(other)
    matches = checkpointed(_matches(base, other, cell, radius, **rules))
    listed = lambda k: F.array_join(F.array_sort(F.collect_list(F.when(F.col("label") == k, F.col("b_id")))).cast("array<string>"), ",").alias(f"label{k}")
    labels = matches.groupBy(F.col("a_id").alias("id")).agg(listed(1), listed(2))
    whole = base.select("id", "points").join(labels, "id", "left").select(F.lit("base").alias("role"), "id", F.lit(0).alias("part"), *(F.coalesce(f"label{k}", F.lit("")).alias(f"label{k}") for k in (1, 2)), "points")
    none = [F.lit("").alias("label1"), F.lit("").alias("label2")]
    over = checkpointed(matches.groupBy(F.col("b_id").alias("id")).agg(F.flatten(F.collect_list("parts")).alias("parts")))
    rest = other.join(over.select("id"), "id", "left_anti").select(F.lit("supplement").alias("role"), "id", F.lit(0).alias("part"), *none, "points")
    left = over.select("id", F.explode(gaps(F.col("parts"))).alias("gap"))
    cut = left.join(other.select("id", "points", "long"), "id").where((F.col("gap.hi") - F.col("gap.lo")) * F.col("long") > least_part)
    cut = cut.select("id", "points", "gap", measures(F.col("points")).alias("m"))
    long = F.element_at("m", -1)
    made = cut.select("id", F.row_number().over(Window.partitionBy("id").orderBy("gap.lo")).alias("part"), part_of(F.col("points"), F.col("m"), F.col("gap.lo") * long, F.col("gap.hi") * long).alias("points"))
    return whole.union(rest).union(made.select(F.lit("residual").alias("role"), "id", "part", *none, "points"))


def split_by_length(lines: DataFrame, most: float, least: float = 0.0) -> DataFrame:
    """id, part (from 0), points: lines longer than `most` cut into pieces of that length and a rest; pieces no longer than `least` go."""
    m = F.col("m")
    made = lines.where(F.size("points") > 1).select("id", "points", measures(F.col("points")).alias("m")).withColumn("long", F.element_at(m, -1))
    n = F.greatest(F.lit(1), F.ceil(F.col("long") / most)).cast("int")
    each = made.withColumn("part", F.explode(F.sequence(F.lit(0), n - 1)))
    low, high = F.col("part") * most, F.least((F.col("part") + 1) * most, F.col("long"))
    points = F.when(F.col("long") <= most, F.col("points")).otherwise(part_of(F.col("points"), m, low, high))
    return each.where(high - low > least).select("id", "part", points.alias("points"))
