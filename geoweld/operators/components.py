"""Connected components of a distributed edge list, and the folder that intermediate results are kept in."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it names none, a temporary one on one machine, and an error elsewhere."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage at a copy in the shared folder, which outlives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of the undirected links (a, b).

    Alternating large-star and small-star steps: every node's neighbours are
    joined to the smallest of them, first the larger ones, then the rest, until
    the links are stars. Each step is one grouping; the number of steps grows
    with the logarithm of the nodes. Nodes without a link aren't listed.
    """
    edges = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    changed = True
    while changed:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        after = checkpointed(small.union(lowest.select("a", F.col("m").alias("b"))).distinct())
        changed = not after.join(edges, ["a", "b"], "left_anti").isEmpty()
        edges = after
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
