"""Measures of a layer or table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweld.functions.text import semantic_null
from geoweld.operators.lines import length, segment


def line_topology(segments: DataFrame) -> DataFrame:
    """zero_length, dangles (ends that no other end shares), length_km and dangles_per_100km, one row."""
    measured = segments.agg(
        F.count_if((F.col("x1") == F.col("x2")) & (F.col("y1") == F.col("y2"))).alias("zero_length"), (F.sum(length(segment())) / 1000).alias("km")
    )
    ends = segments.select(F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("e"))
    alone = ends.groupBy("e").count().where("count = 1").agg(F.count(F.lit(1)).alias("dangles"))
    return measured.crossJoin(alone).select(
        "zero_length", "dangles", F.round("km", 6).alias("length_km"), F.round(F.col("dangles") * 100 / F.col("km"), 6).alias("dangles_per_100km")
    )


def field_quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, n_rows, n_filled, null_rate and n_distinct of each column, blank and null-like texts being missing; one pass."""
    row = F.array(*(F.struct(F.lit(c).alias("field"), semantic_null(F.col(c).cast("string")).alias("value")) for c in columns))
    each = df.select(F.explode(row).alias("f")).select("f.field", "f.value")
    return each.groupBy("field").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_filled"),
        F.round(1 - F.count("value") / F.count(F.lit(1)), 6).alias("null_rate"), F.count_distinct("value").alias("n_distinct"),
    )


def gini(counts: DataFrame, value: str) -> DataFrame:
    """gini of the values, one row; counts holds one row a source. 0 for no or all zero values.

    Equal values stand in a row of ranks, so only the distinct values are ranked.
    """
    from geoweld.operators.relational import with_running_total

    v, c = F.col("v"), F.col("c")
    sizes = counts.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ranked = with_running_total(sizes, ["v"], "c", "before")
    n, total = F.sum(c), F.sum(v * c)
    ranks = c * F.col("before") + c * (c + 1) / 2
    g = 2 * F.sum(ranks * v) / (n * total) - (n + 1) / n
    return ranked.agg(F.round(F.coalesce(F.when(total > 0, g), F.lit(0.0)), 6).alias("gini"))


def duplicate_rate(df: DataFrame, *columns: str) -> DataFrame:
    """rate: one minus distinct by all rows."""
    distinct, rows = F.count_distinct(F.struct(*columns)), F.count(F.lit(1))
    return df.agg(F.round(1 - distinct / F.greatest(rows, F.lit(1)), 6).alias("rate"), rows.alias("n_rows"))


def sample_summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """n, mean, sd and the half width of the 95 % interval of the mean (t for up to five values, else 1.96)."""
    # two-sided 95 % points of Student's t for n - 1 degrees of freedom: fixed values
    t = F.when(F.col("n") == 2, 12.706).when(F.col("n") == 3, 4.303).when(F.col("n") == 4, 3.182).when(F.col("n") == 5, 2.776).otherwise(1.96)
    stats = df.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    half = F.when(F.col("n") > 1, t * F.col("sd") / F.sqrt("n")).otherwise(0.0)
    return stats.select(key, "n", F.round("mean", 6).alias("mean"), F.round(F.coalesce("sd", F.lit(0.0)), 6).alias("sd"), F.round(half, 6).alias("half_width"))


def zonal_statistics(zones: DataFrame, pixels: DataFrame, cell: float, nodata: float | None = None) -> DataFrame:
    """a_id, n, low, high, dominant: valid pixels (value > 0) with their point in each zone's box; of equal counts the higher value is dominant."""
    from geoweld.operators.grid_join import grid_join, points

    valid = (F.col("value") > 0) & ~F.isnan("value") & (F.lit(True) if nodata is None else F.col("value") != nodata)
    placed = points(pixels.where(valid).withColumn("value", F.round("value", 3)))
    counted = grid_join(zones, placed, cell).groupBy("a_id", "b_value").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("a_id").agg(
        F.sum("n").alias("n"), F.min("b_value").alias("low"), F.max("b_value").alias("high"), F.max_by("b_value", F.struct("n", "b_value")).alias("dominant")
    )
