"""Measures of polygons and lines given as arrays of points (x, y).

What a fold over the points can tell stays in Spark expressions; clipping and hulls,
which grow their own lists of points, are Arrow-batched.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


def _sides(points: Column) -> Column:
    """Consecutive pairs of points."""
    n = F.size(points)
    rest = F.when(n > 1, F.slice(points, F.lit(2), n - 1)).otherwise(F.slice(points, F.lit(1), F.lit(0)))
    return F.zip_with(F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))), rest, lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def line_length(points: Column) -> Column:
    step = lambda acc, s: acc + F.sqrt(F.pow(s["q"]["x"] - s["p"]["x"], 2) + F.pow(s["q"]["y"] - s["p"]["y"], 2))
    return F.aggregate(_sides(points), F.lit(0.0), step)


def closed(points: Column) -> Column:
    """The ring with its first point at the end."""
    first, last = F.get(points, F.lit(0)), F.get(points, F.size(points) - 1)
    return F.when((F.size(points) > 0) & (first != last), F.concat(points, F.array(first))).otherwise(points)


def signed_area(ring: Column) -> Column:
    """Positive for a ring that turns left."""
    step = lambda acc, s: acc + (s["p"]["x"] * s["q"]["y"] - s["q"]["x"] * s["p"]["y"])
    return F.aggregate(_sides(closed(ring)), F.lit(0.0), step) / 2


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def ring_centroid(ring: Column) -> Column:
    """Struct x, y; null for a ring without area."""
    start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(acc: Column, s: Column) -> Column:
        cross = s["p"]["x"] * s["q"]["y"] - s["q"]["x"] * s["p"]["y"]
        return F.struct((acc["x"] + (s["p"]["x"] + s["q"]["x"]) * cross).alias("x"), (acc["y"] + (s["p"]["y"] + s["q"]["y"]) * cross).alias("y"))

    six = 6 * signed_area(ring)
    total = F.aggregate(_sides(closed(ring)), start, step)
    return F.when(six != 0, F.struct((total["x"] / six).alias("x"), (total["y"] / six).alias("y")))


def bounds(points: Column) -> Column:
    """Struct minx, miny, maxx, maxy."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def contains_point(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ray from the point crosses the ring an odd number of times."""

    def step(acc: Column, s: Column) -> Column:
        p, q = s["p"], s["q"]
        spans = (p["y"] > y) != (q["y"] > y)
        at = p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / F.when(q["y"] != p["y"], q["y"] - p["y"]).otherwise(1.0)
        return F.when(spans & (x < at), ~acc).otherwise(acc)

    return F.aggregate(_sides(closed(ring)), F.lit(False), step)


def _points(ring: object) -> list[tuple[float, float]]:
    return [] if ring is None else [(p["x"], p["y"]) for p in ring]


def clipped(subject: list[tuple[float, float]], clip: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The part of a polygon inside a convex one, side by side of the clip."""
    turn = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(clip, clip[1:] + clip[:1], strict=True))
    if turn < 0:
        clip = clip[::-1]
    for a, b in zip(clip, clip[1:] + clip[:1], strict=True):
        side = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])  # noqa: B023, E731
        out = []
        for p, q in zip(subject, subject[1:] + subject[:1], strict=True):
            s, t = side(p), side(q)
            if s >= 0:
                out.append(p)
            if s * t < 0:
                out.append((p[0] + (q[0] - p[0]) * s / (s - t), p[1] + (q[1] - p[1]) * s / (s - t)))
        subject = out
    return subject


def _area(ring: list[tuple[float, float]]) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


@F.pandas_udf(T.DoubleType())
def shared_polygon_area(subject: pd.Series, clip: pd.Series) -> pd.Series:
    """Area that a polygon shares with a convex one; 0 if either has fewer than three points."""
    pairs = ((_points(s), _points(c)) for s, c in zip(subject, clip, strict=True))
    return pd.Series([_area(clipped(s, c)) if min(len(s), len(c)) > 2 else 0.0 for s, c in pairs], dtype=float)


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    ordered = sorted(set(points))
    if len(ordered) < 3:
        return ordered

    def half(of: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in of:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return half(ordered) + half(ordered[::-1])


def smallest_rectangle(points: list[tuple[float, float]]) -> tuple[float, float, float]:
    """Long side, short side and direction of the long one, in degrees within [0, 180), of the least rectangle around the points."""
    hull = np.array(convex_hull(points), float).reshape(-1, 2)
    if len(hull) < 2:
        return 0.0, 0.0, 0.0
    best = None
    for p, q in zip(hull, np.roll(hull, -1, axis=0), strict=True):
        angle = math.atan2(q[1] - p[1], q[0] - p[0])
        c, s = math.cos(angle), math.sin(angle)
        w, h = np.ptp(hull @ np.array([c, s])), np.ptp(hull @ np.array([-s, c]))
        found = (w * h, *((w, h, math.degrees(angle) % 180) if w >= h else (h, w, (math.degrees(angle) + 90) % 180)))
        best = found if best is None or found[0] < best[0] - 1e-12 else best
    return best[1], best[2], best[3]


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("long_side", "short_side", "direction")]))
def oriented_rectangle(ring: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([smallest_rectangle(_points(r)) for r in ring], columns=["long_side", "short_side", "direction"], dtype=float)


def shape_similarity(a: tuple[Column, ...], b: tuple[Column, ...], distance: Column, shared: Column, reach: float = 70.0) -> dict[str, Column]:
    """Similarity of two shapes given as (area, long side, short side, direction): location, area, overlap, direction, shape."""
    turn = F.abs(a[3] - b[3])
    return {
        "location": 1 - distance / reach,
        "area": F.least(a[0], b[0]) / F.greatest(a[0], b[0]),
        "overlap": shared / F.greatest(a[0], b[0]),
        "orientation": F.radians(F.least(turn, 180 - turn)),
        "shape": F.least(a[1] / a[2], b[1] / b[2]) / F.greatest(a[1] / a[2], b[1] / b[2]),
    }
