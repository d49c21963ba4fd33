"""Assigning candidates: one-to-one matches, priorities and layers made of matched and unmatched rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweld.functions.geometry import box, box_area, shared_area
from geoweld.operators.components import checkpointed, connected_components
from geoweld.operators.grid_join import best_per, grid_join
from geoweld.operators.naming import free_name


def similar_boxes(base: DataFrame, other: DataFrame, cell: float, by: str = "least") -> DataFrame:
    """a_id, b_id, shared, similarity of every pair of boxes that meet.

    similarity is the shared area by the least, the greatest or the base's own ("base") area.
    """
    a, b = box("a_"), box("b_")
    whole = {"least": F.least(box_area(a), box_area(b)), "greatest": F.greatest(box_area(a), box_area(b)), "base": box_area(a)}[by]
    return grid_join(base, other, cell).withColumn("shared", shared_area(a, b)).withColumn(
        "similarity", F.when(whole > 0, F.col("shared") / whole).otherwise(0.0)
    )


def two_pass_matches(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs of at least that similarity, the best for each a_id, then of these the best for each b_id.

    This isn't a greedy matching: an a whose best partner goes to another stays without. Ties go to the smaller ids.
    """
    down = F.col("similarity").desc()
    first = best_per(pairs.where(F.col("similarity") >= least), "a_id", down, F.col("b_id"))
    return best_per(first, "b_id", down, F.col("a_id"))


def greedy_one_to_one(pairs: DataFrame, *order: str, rounds: int = 3, most_pairs: int = 500_000) -> DataFrame:
    """Pairs (a_id, b_id, ...) that taking the first of all free pairs again and again would take.

    In the total order (order, a_id, b_id), none of it null, a pair that is the first of both its
    ends is taken; its ends leave, and so on. A round takes every such pair at once, which leaves little but chains
    of pairs that wait for each other. After some rounds, what is left falls into connected groups; each of at most most_pairs pairs is
    finished by the rule itself in a task of its own, and larger ones go through further rounds, until nothing is left.
    """
    total, taken = [*order, "a_id", "b_id"], []
    left = checkpointed(pairs)
    while True:
        for _ in range(rounds):
            key = F.struct(*total)
            of_a = left.groupBy("a_id").agg(F.min(key).alias("ka"))
            of_b = left.groupBy("b_id").agg(F.min(key).alias("kb"))
            mutual = checkpointed(left.join(of_a, "a_id").join(of_b, "b_id").where((key == F.col("ka")) & (key == F.col("kb"))).select(*pairs.columns))
            if mutual.isEmpty():
                return reduce(DataFrame.union, taken) if taken else pairs.limit(0)
            taken.append(mutual)
            left = checkpointed(left.join(mutual.select("a_id"), "a_id", "left_anti").join(mutual.select("b_id"), "b_id", "left_anti").select(*pairs.columns))
        if left.isEmpty():
            return reduce(DataFrame.union, taken)
        node = F.concat(F.lit("a"), "a_id")
        groups = connected_components(left.select(node.alias("a"), F.concat(F.lit("b"), "b_id").alias("b"))).where("node LIKE 'a%'")
        group = free_name(left, "group")
        grouped = checkpointed(left.withColumn("node of a", node).join(groups.toDF("node of a", group), "node of a").drop("node of a"))
        sizes = grouped.groupBy(group).count().withColumn("small", F.col("count") <= most_pairs).drop("count")
        sized = grouped.join(sizes, group)
        taken.append(checkpointed(sized.where("small").drop("small").groupBy(group).applyInPandas(_one_by_one(total, group), pairs.schema)))
        left = checkpointed(sized.where("NOT small").select(*pairs.columns))


def _one_by_one(total: list[str], group: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns=[group]).sort_values(total, kind="stable")
        used_a, used_b, keep = set(), set(), []
        for a, b in zip(pdf["a_id"], pdf["b_id"], strict=True):
            keep.append(a not in used_a and b not in used_b)
            if keep[-1]:
                used_a.add(a)
                used_b.add(b)
        return pdf[keep]

    return take


def merged_layer(base: DataFrame, other: DataFrame, matches: DataFrame, keep_base: bool = True) -> DataFrame:
    """id, ref_id, src: matched base rows, unmatched base rows and unmatched other rows.

    matches has a_id and b_id. Without keep_base, unmatched base rows are left out.
    """
    both = matches.select(F.col("a_id").alias("id"), F.col("b_id").alias("ref_id"), F.lit("matched").alias("src"))
    only_base = base.join(matches.select(F.col("a_id").alias("id")), "id", "left_anti").select("id", F.lit(None).cast("long").alias("ref_id"), F.lit("base").alias("src"))
    used = matches.select(F.col("b_id").alias("id")).distinct()
    only_other = other.join(used, "id", "left_anti").select(F.lit(None).cast("long").alias("id"), F.col("id").alias("ref_id"), F.lit("other").alias("src"))
    return both.union(only_base).union(only_other) if keep_base else both.union(only_other)


def priority_cascade(layers: list[tuple[str, DataFrame]], cell: float, least: float) -> DataFrame:
    """id, source and box of the layers from the first: each adds the rows that match none of those before it."""
    name, first = layers[0]
    fused = first.select("id", F.lit(name).alias("source"), *box())
    for name, layer in layers[1:]:
        hit = similar_boxes(layer, fused, cell).where(F.col("similarity") >= least).select(F.col("a_id").alias("id")).distinct()
        fused = checkpointed(fused.union(layer.join(hit, "id", "left_anti").select("id", F.lit(name).alias("source"), *box())))
    return fused


def relation_class(pairs: DataFrame) -> DataFrame:
    """pairs with n_b (partners of a_id), n_a (partners of b_id) and relation: 1:1, 1:N, N:1 or M:N."""
    pairs = checkpointed(pairs)  # looked at three times, and found by a join
    per_a = pairs.groupBy("a_id").agg(F.count_distinct("b_id").alias("n_b"))
    per_b = pairs.groupBy("b_id").agg(F.count_distinct("a_id").alias("n_a"))
    kind: Column = (
        F.when((F.col("n_b") == 1) & (F.col("n_a") == 1), "1:1")
        .when((F.col("n_b") > 1) & (F.col("n_a") == 1), "1:N")
        .when((F.col("n_b") == 1) & (F.col("n_a") > 1), "N:1")
        .otherwise("M:N")
    )
    return pairs.join(per_a, "a_id").join(per_b, "b_id").withColumn("relation", kind)
