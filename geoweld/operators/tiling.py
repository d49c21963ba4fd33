"""Tiles of a bounding box."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweld.functions.geometry import BOX, box, boxes_meet


def _counts(bbox: tuple[float, float, float, float], size: float) -> tuple[int, int]:
    """Rows and columns of tiles."""
    x1, y1, x2, y2 = bbox
    return max(1, math.ceil((y2 - y1) / size)), max(1, math.ceil((x2 - x1) / size))


def _tile(row: Column, col: Column, bbox: tuple[float, float, float, float], size: float) -> tuple[Column, Column, Column, Column]:
    x1, y1, x2, y2 = bbox
    minx, miny = x1 + col * size, y1 + row * size
    return minx, miny, F.least(minx + size, F.lit(x2)), F.least(miny + size, F.lit(y2))


def _buffered(tile: tuple[Column, ...], bbox: tuple[float, float, float, float], overlap: float) -> tuple[Column, Column, Column, Column]:
    x1, y1, x2, y2 = bbox
    return F.greatest(tile[0] - overlap, F.lit(x1)), F.greatest(tile[1] - overlap, F.lit(y1)), F.least(tile[2] + overlap, F.lit(x2)), F.least(tile[3] + overlap, F.lit(y2))


def partition_bbox(spark: SparkSession, bbox: tuple[float, float, float, float], size: float = 5000.0, overlap: float = 64.0) -> DataFrame:
    """tile_id, row, col, minx, miny, maxx, maxy and `buffered`, the tile widened by the overlap within the box.

    Tiles are made by tasks from two sequences; the last of a row or column ends with the box.
    """
    rows, cols = _counts(bbox, size)
    t = spark.range(rows * cols).select((F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    t = t.withColumns(dict(zip(BOX, _tile(F.col("row"), F.col("col"), bbox, size), strict=True)))
    buffered = F.struct(*(c.alias(name) for name, c in zip(BOX, _buffered(box(), bbox, overlap), strict=True)))
    return t.select(F.format_string("tile_%03d_%03d", "row", "col").alias("tile_id"), "row", "col", *BOX, buffered.alias("buffered"))


def dealt_to_tiles(boxes: DataFrame, at: tuple[Column, Column, Column, Column], bbox: tuple[float, float, float, float], size: float = 5000.0, overlap: float = 64.0) -> DataFrame:
    """boxes with row and col, once for each tile of partition_bbox whose buffered box meets theirs, the columns at. By arithmetic, so nothing is joined."""
    rows, cols = _counts(bbox, size)

    def over(low: Column, high: Column, start: float, n: int) -> Column:
        # one more at either end, as sums are rounded; the exact test follows
        first, last = F.floor((low - overlap - start) / size) - 1, F.floor((high + overlap - start) / size) + 1
        first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit(n - 1))
        return F.when(first <= last, F.sequence(first, last))

    dealt = boxes.withColumn("col", F.explode(over(at[0], at[2], bbox[0], cols))).withColumn("row", F.explode(over(at[1], at[3], bbox[1], rows)))
    return dealt.where(boxes_meet(at, _buffered(_tile(F.col("row"), F.col("col"), bbox, size), bbox, overlap)))


def tile_size_for(features: int, area_km2: float, size: float, most_features: int = 300_000, most_km2: float = 50_000.0, most_tiles: int = 64) -> int:
    """How many tiles a run takes: one for a small area, else enough for the size, up to the cap."""
    if features <= most_features and area_km2 <= most_km2:
        return 1
    return max(1, min(most_tiles, math.ceil(area_km2 * 1e6 / (size * size))))


def tiles_for(features: Column, km2: Column, size: float, most_features: int = 300_000, most_km2: float = 50_000.0, most_tiles: int = 64) -> Column:
    """tile_size_for as an expression over a table of runs."""
    several = F.greatest(F.lit(1), F.least(F.lit(most_tiles), F.ceil(km2 * 1e6 / (size * size))))
    return F.when((features <= most_features) & (km2 <= most_km2), F.lit(1)).otherwise(several).cast("int")
