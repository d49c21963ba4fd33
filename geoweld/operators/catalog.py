"""Paths, reachability and search over a catalog of typed nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweld.operators.components import checkpointed


def transform_paths(edges: DataFrame, start: str, goal: str, most: int = 3) -> DataFrame:
    """depth, path: the shortest path from start to goal in at most `most` steps, of equals the first in order of its nodes.

    edges (source, target). Each step is one join; of the paths to a node only the first in order goes on, and only
    those to nodes not reached before, so there are no more paths than nodes. No row if there is none; equal ends give a path of one node.
    """
    spark = edges.sparkSession
    e = edges.select("source", "target").distinct()
    frontier = spark.createDataFrame([(0, start, [start])], "depth int, node string, path array<string>")
    found = frontier
    for _ in range(most):
        step = frontier.join(e, F.col("node") == F.col("source")).join(found.select(F.col("node").alias("target")), "target", "left_anti")
        ahead = step.select((F.col("depth") + 1).alias("depth"), F.col("target").alias("node"), F.concat("path", F.array("target")).alias("path"))
        frontier = checkpointed(ahead.groupBy("depth", "node").agg(F.min("path").alias("path")))
        found = found.union(frontier)
    return found.where(F.col("node") == goal).orderBy("depth", "path").limit(1).select("depth", "path")


def upstream(edges: DataFrame, goals: DataFrame, most: int = 3) -> DataFrame:
    """goal, node, hops: every node from which a goal is reached in at most `most` steps, by the fewest."""
    e = edges.select("source", "target").distinct()
    frontier = goals.select(F.col("node").alias("goal"), "node", F.lit(0).alias("hops"))
    found = frontier
    for _ in range(most):
        step = frontier.join(e, F.col("node") == F.col("target"))
        frontier = step.select("goal", F.col("source").alias("node"), (F.col("hops") + 1).alias("hops")).distinct()
        found = found.union(frontier)
    return found.groupBy("goal", "node").agg(F.min("hops").alias("hops"))


def token_search(nodes: DataFrame, text: str, query: str, key: str, k: int) -> DataFrame:
    """The k nodes whose text has the most of the query's words, ties by key; nodes without any are left out."""
    words = [w for w in dict.fromkeys(query.lower().split()) if w]
    hits = sum((F.contains(F.lower(text), F.lit(w)).cast("int") for w in words), F.lit(0))
    return nodes.withColumn("hits", hits).where("hits > 0").orderBy(F.col("hits").desc(), key).limit(k)


def collected_per_pattern(patterns: DataFrame, steps: DataFrame, algorithms: DataFrame) -> DataFrame:
    """Each pattern with its steps in order, as an array of (step, algorithm, rate)."""
    named = steps.join(algorithms, "algorithm", "left")
    grouped = named.groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct("step", "algorithm", "rate"))).alias("steps"))
    return patterns.join(grouped, "pattern", "left")
