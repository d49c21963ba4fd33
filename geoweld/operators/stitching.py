"""Putting tiles, sources and attempts together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweld.functions.text import semantic_null
from geoweld.operators.naming import first_rows, free_name, row_digest
from geoweld.operators.relational import exact_quantiles


def first_source_per_tile(rows: DataFrame, tile: str, priority: str) -> DataFrame:
    """Of each tile the rows of the source that comes first in priority and has any."""
    name = free_name(rows, "first")
    first = rows.groupBy(tile).agg(F.min(priority).alias(name))
    return rows.join(first, tile).where(F.col(priority) == F.col(name)).drop(name)


def stitched(rows: DataFrame, source: str, key: str, shape: Column, order: str) -> DataFrame:
    """One row for each source and key, or, without a key, for each shape; the first in order stays."""
    own = semantic_null(F.col(key).cast("string"))
    name = F.coalesce(F.concat_ws("~", F.lit("id"), F.col(source), own).cast("string"), F.lit(""))
    name = F.when(own.isNotNull(), name).otherwise(F.concat(F.lit("shape~"), shape))
    return first_rows(rows, [name], [order, row_digest(rows)])


def best_candidates(rows: DataFrame, name: str, country: str, box: list[str], score: str, digits: int = 7) -> DataFrame:
    """One row for each name, country and rounded box, that of the highest score."""
    keys = [F.lower(name), F.upper(country), *(F.round(c, digits) for c in box)]
    return first_rows(rows, keys, [F.col(score).desc(), name, row_digest(rows)])


def retry_jobs(attempts: DataFrame, backoff: Column, window_hours: int = 24) -> DataFrame:
    """A job for each attempt that isn't available: job_key, next_retry, window_ends.

    attempts: scenario, run, source, status, at. Of attempts of one key the latest counts.
    """
    key = F.concat_ws(":", "scenario", "run", "source")
    jobs = attempts.where("status <> 'available'").withColumn("job_key", key)
    latest = first_rows(jobs, ["job_key"], [F.col("at").desc(), row_digest(jobs)])
    return latest.select("job_key", "status", F.timestamp_seconds(F.unix_timestamp("at") + backoff).alias("next_retry"), (F.col("at") + F.expr(f"INTERVAL {window_hours} HOURS")).alias("window_ends"))


def authorized(allowed: Column, asked: Column) -> tuple[Column, Column]:
    """What is asked and allowed, and what is asked only."""
    return F.array_intersect(asked, allowed), F.array_except(asked, allowed)


def aligned(base: DataFrame, other: DataFrame, cell: float, radius: float) -> DataFrame:
    """a_id, b_id, how, dist: rows with the same key first, then the nearest within radius of those that are left.

    Both sides: id, key, x, y. A b may be met by several a.
    """
    from geoweld.functions.geometry import distance
    from geoweld.operators.grid_join import nearest_within, points, prefixed

    a, b = prefixed(base, "a_"), prefixed(other, "b_")
    d = distance(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y"))
    keyed = a.join(b, semantic_null(F.col("a_key")) == semantic_null(F.col("b_key"))).withColumn("dist", d)
    # the least of each a is kept while rows are joined, so a common key makes no rows beyond the join
    best = keyed.groupBy("a_id").agg(F.min(F.struct("dist", "b_id")).alias("best"))
    by_key = best.select("a_id", "best.b_id", F.lit("key").alias("how"), "best.dist")
    rest = base.join(by_key.select(F.col("a_id").alias("id")), "id", "left_anti")
    near = nearest_within(points(rest), points(other), cell, radius, d, F.col("b_id"))
    return by_key.union(near.select("a_id", "b_id", F.lit("nearest"), "dist"))


def alignment_summary(matches: DataFrame, n_base: int, n_other: int) -> DataFrame:
    """recall, precision and deviation of matches (a_id, b_id, dist); a ratio without denominator is 1."""
    ratio = lambda n, d: F.round(n / d, 6) if d else F.lit(1.0)
    counts = matches.agg(ratio(F.count_distinct("a_id"), n_base).alias("recall"), ratio(F.count_distinct("b_id"), n_other).alias("precision"))
    ranks = exact_quantiles(matches, "dist", (0.5, 0.95))  # one row
    return counts.crossJoin(ranks).select("recall", "precision", F.round("q0", 6).alias("p50"), F.round("q1", 6).alias("p95"))
