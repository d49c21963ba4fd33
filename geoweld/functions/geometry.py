"""Geometry of boxes, points and segments as column expressions; all stay in generated code.

A box is four columns (minx, miny, maxx, maxy), a segment (x1, y1, x2, y2).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("minx", "miny", "maxx", "maxy")


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + c) for c in BOX)  # type: ignore[return-value]


def box_area(b: tuple[Column, ...]) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def boxes_meet(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Closed boxes with a point in common."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def box_contains(outer: tuple[Column, ...], inner: tuple[Column, ...]) -> Column:
    return (outer[0] <= inner[0]) & (outer[1] <= inner[1]) & (outer[2] >= inner[2]) & (outer[3] >= inner[3])


def shared_area(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Area of the intersection; 0 where the boxes don't meet."""
    width = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    height = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(width, F.lit(0)) * F.greatest(height, F.lit(0))


def aspect_ratio(b: tuple[Column, ...]) -> Column:
    """Long side by short side; null for a box without a short side."""
    w, h = b[2] - b[0], b[3] - b[1]
    return F.when(F.least(w, h) > 0, F.greatest(w, h) / F.least(w, h))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def bearing(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Direction of the line in degrees within [0, 180)."""
    return F.pmod(F.degrees(F.atan2(y2 - y1, x2 - x1)), F.lit(180.0))


def angle_difference(a: Column, b: Column) -> Column:
    """Between two line directions, at most 90."""
    d = F.abs(a - b)
    return F.least(d, 180.0 - d)


def turn_angle(x1: Column, y1: Column, x2: Column, y2: Column, x3: Column, y3: Column) -> Column:
    """Angle at the middle point in degrees; 180 where a side has no length."""
    ax, ay, bx, by = x1 - x2, y1 - y2, x3 - x2, y3 - y2
    sides = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / sides))
    return F.when(sides > 0, F.degrees(F.acos(cosine))).otherwise(180.0)


def length_similarity(a: Column, b: Column) -> Column:
    """The shorter by the longer length; 0 unless both are above 0."""
    return F.when((a > 0) & (b > 0), F.least(a, b) / F.greatest(a, b)).otherwise(0.0)


def point_segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    squared = dx * dx + dy * dy
    t = F.when(squared > 0, ((px - x1) * dx + (py - y1) * dy) / squared).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return distance(px, py, x1 + t * dx, y1 + t * dy)


def vertex_hausdorff(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Discrete Hausdorff distance of two segments, over their end points only."""
    d = [[distance(a[2 * i], a[2 * i + 1], b[2 * j], b[2 * j + 1]) for j in (0, 1)] for i in (0, 1)]
    ab = F.greatest(F.least(d[0][0], d[0][1]), F.least(d[1][0], d[1][1]))
    ba = F.greatest(F.least(d[0][0], d[1][0]), F.least(d[0][1], d[1][1]))
    return F.greatest(ab, ba)


def segment_hausdorff(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Hausdorff distance from vertices to the other segment, both ways."""
    ab = F.greatest(point_segment_distance(a[0], a[1], *b), point_segment_distance(a[2], a[3], *b))
    ba = F.greatest(point_segment_distance(b[0], b[1], *a), point_segment_distance(b[2], b[3], *a))
    return F.greatest(ab, ba)


def utm_zone(lon: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(60), F.floor((lon + 180) / 6).cast("int") + 1))


def utm_code(lon: Column, lat: Column) -> Column:
    """EPSG:326zz north of the equator, EPSG:327zz south of it."""
    return F.format_string("EPSG:%d%02d", F.when(lat >= 0, F.lit(326)).otherwise(F.lit(327)), utm_zone(lon))


#: Radius of EPSG:3857 in metres. Fixed value.
MERCATOR_RADIUS = 6378137.0


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    x = F.radians(lon) * MERCATOR_RADIUS
    return x, F.log(F.tan(F.radians(lat) / 2 + F.lit(0.7853981633974483))) * MERCATOR_RADIUS


def _series(n: float, *rows: tuple[float, ...]) -> list[float]:
    """Coefficients of n^j, n^(j+1), ... for each j from 1, added up."""
    return [sum(c * n ** (j + k) for k, c in enumerate(row)) for j, row in enumerate(rows, 1)]


#: WGS 84 and the zones' scale and false origin. Fixed values.
EQUATOR, FLATTENING, SCALE, FALSE_EAST, FALSE_SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
_N = FLATTENING / (2 - FLATTENING)
#: Radius of the rectifying sphere, and Krueger's series to the fourth power of the third flattening. Fixed values.
RECTIFYING = EQUATOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
TO_GRID = _series(_N, (1 / 2, -2 / 3, 5 / 16, 41 / 180), (13 / 48, -3 / 5, 557 / 1440), (61 / 240, -103 / 140), (49561 / 161280,))
FROM_GRID = _series(_N, (1 / 2, -2 / 3, 37 / 96, -1 / 360), (1 / 48, 1 / 15, -437 / 1440), (17 / 480, -37 / 840), (4397 / 161280,))
TO_LATITUDE = _series(_N, (2, -2 / 3, -2, 116 / 45), (7 / 3, -8 / 5, -227 / 45), (56 / 15, -136 / 35), (4279 / 630,))


def to_utm(lon: Column, lat: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Easting and northing in metres in a zone, on the southern grid if south; far beyond the zone the series loses its millimetres."""
    e = 2 * math.sqrt(_N) / (1 + _N)
    sine, turn = F.sin(F.radians(lat)), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(sine) - e * F.atanh(e * sine))
    xi, eta = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
    east = eta + sum((c * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, c in enumerate(TO_GRID, 1)), F.lit(0.0))
    north = xi + sum((c * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, c in enumerate(TO_GRID, 1)), F.lit(0.0))
    return FALSE_EAST + SCALE * RECTIFYING * east, F.when(south, FALSE_SOUTH).otherwise(0.0) + SCALE * RECTIFYING * north


def from_utm(east: Column, north: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    xi = (north - F.when(south, FALSE_SOUTH).otherwise(0.0)) / (SCALE * RECTIFYING)
    eta = (east - FALSE_EAST) / (SCALE * RECTIFYING)
    x = xi - sum((c * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, c in enumerate(FROM_GRID, 1)), F.lit(0.0))
    y = eta - sum((c * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, c in enumerate(FROM_GRID, 1)), F.lit(0.0))
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi + sum((c * F.sin(2 * j * chi) for j, c in enumerate(TO_LATITUDE, 1)), F.lit(0.0))
    return F.degrees(F.atan2(F.sinh(y), F.cos(x))) + zone * 6 - 183, F.degrees(lat)


def box_to(b: tuple[Column, ...], project: Callable[[Column, Column], tuple[Column, Column]], pieces: int = 20) -> tuple[Column, ...]:
    """The box around a box's projected edges, each in so many pieces, as straight edges may bulge."""
    at = lambda low, high: F.transform(F.sequence(F.lit(0), F.lit(pieces)), lambda i: low + (high - low) * i / pieces)
    edges = [(at(b[0], b[2]), b[1], 0), (at(b[0], b[2]), b[3], 0), (at(b[1], b[3]), b[0], 1), (at(b[1], b[3]), b[2], 1)]
    xs, ys = ([_along(moving, fixed, upright, axis, project) for moving, fixed, upright in edges] for axis in (0, 1))
    return F.least(*map(F.array_min, xs)), F.least(*map(F.array_min, ys)), F.greatest(*map(F.array_max, xs)), F.greatest(*map(F.array_max, ys))


def _along(moving: Column, fixed: Column, upright: int, axis: int, project: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    return F.transform(moving, lambda v: (project(fixed, v) if upright else project(v, fixed))[axis])


def quadkey_tile(key: Column) -> tuple[Column, Column]:
    """Column and row of a quadkey's tile: digit bits 1 and 2, the first digit highest."""
    digits = F.transform(F.split(key, ""), lambda d: F.coalesce(F.expr("null").cast("int"), d.try_cast("int")))
    digits = F.filter(digits, lambda d: d.isNotNull())

    def folded(bit: int) -> Column:
        return F.aggregate(digits, F.lit(0), lambda acc, d: acc * 2 + (F.shiftright(d, bit).bitwiseAND(F.lit(1))))

    return folded(0), folded(1)


def tile_bounds(column: Column, row: Column, level: Column) -> tuple[Column, Column, Column, Column]:
    """West, south, east and north of a Web Mercator tile, in degrees."""
    wide = F.pow(F.lit(2.0), level)
    lon = lambda x: x / wide * 360 - 180
    lat = lambda y: F.degrees(F.atan(F.sinh(F.lit(3.141592653589793) * (1 - 2 * y / wide))))
    return lon(column), lat(row + 1), lon(column + 1), lat(row)


#: Alphabet of geohashes. Fixed value.
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def _grid(value: Column, low: float, high: float, bits: int) -> Column:
    cells = 1 << bits
    return F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor((value - low) / (high - low) * cells))).cast("long")


def geohash_cells(lon: Column, lat: Column, precision: int = 8) -> tuple[Column, Column]:
    """Column and row of the geohash grid; neighbours lie one apart."""
    bits = 5 * precision
    return _grid(lon, -180.0, 180.0, bits - bits // 2), _grid(lat, -90.0, 90.0, bits // 2)


def geohash_of_cells(cx: Column, cy: Column, precision: int = 8) -> Column:
    """Interleaves the bits of column and row, the column's first, in groups of five."""
    bits = 5 * precision
    xbits, ybits = bits - bits // 2, bits // 2
    letters = []
    for k in range(precision):
        digit = F.lit(0).cast("long")
        for b in range(5 * k, 5 * k + 5):
            source, at = (cx, xbits - 1 - b // 2) if b % 2 == 0 else (cy, ybits - 1 - b // 2)
            digit = digit * 2 + F.shiftright(source, at).bitwiseAND(F.lit(1).cast("long"))
        letters.append(F.substring(F.lit(BASE32), (digit + 1).cast("int"), F.lit(1)))
    return F.concat(*letters)


def geohash(lon: Column, lat: Column, precision: int = 8) -> Column:
    return geohash_of_cells(*geohash_cells(lon, lat, precision), precision)


def geohash_ring(lon: Column, lat: Column, precision: int = 8) -> Column:
    """The hashes of the point's cell and the eight around it; longitudes wrap, poles end."""
    cx, cy = geohash_cells(lon, lat, precision)
    bits = 5 * precision
    wide, high = 1 << (bits - bits // 2), 1 << (bits // 2)
    found = [
        F.when((cy + dy >= 0) & (cy + dy < high), geohash_of_cells(F.pmod(cx + dx, F.lit(wide)), cy + dy, precision))
        for dx in (-1, 0, 1)
        for dy in (-1, 0, 1)
    ]
    return F.array_distinct(F.array_compact(F.array(*found)))
