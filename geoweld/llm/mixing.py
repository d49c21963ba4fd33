"""Mixing sources to target weights, in DataFrame functions only.

Every row gets a hash-random key. Within its source, rows stand in the order of
that key; Spark deals them by ranges of similar size, so a
source that holds most of the rows is ordered by many tasks. The words before a
row are the words of the ranges before its range, which come from one small row
a range, plus a running sum within the range. A source's budget is then cut
exactly: whole epochs first, then the rows up to the remainder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweld.llm.common import WORD, checkpointed, free_name


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_targets(totals: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """A target for each row (source, source_size) of totals, which has one row a source.

    Sources by code point, null last, take the weights in turn and share
    `share` times all words; a target stops at `most` times its source's size
    and the excess goes to the others by weight until none is above. That is
    the level at which least(most * size, level * weight) adds up to the
    whole: sources are taken by size per weight, and the first whose level lies
    below its own bound sets it. An empty table or sizes of 0 give targets of 0.
    The table has a row for each source name, not for each document.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    bound = totals.withColumn("weight", w).withColumn("bound", most * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").isNull(), F.encode("source", "utf-8"))
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    return (
        bound.withColumn("own_level", level)
        .withColumn("own_level", F.when(F.col("own_level") * F.col("weight") <= F.col("bound"), F.col("own_level")))
        .withColumn("level", F.max("own_level").over(whole))  # levels fall after the first that holds
        .withColumn("target", F.least(F.col("bound"), F.coalesce(F.col("level") * F.col("weight"), F.col("bound"))))
        .select("source", "source_size", "target")
    )


def mixed(docs: DataFrame, size: Column, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 11, more: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how many words of each row the mix takes.

    Repeats count: a row may be taken once an epoch, up to `most` times its
    size. The sum of taken in a source is the whole part of its target, as the
    row at the cut gives only the words up to it. A null source is a source of
    its own; a null text has size 0 and gives 0. Rows that agree in doc_id,
    source and size are alike, so their order doesn't matter; reruns agree.
    Columns of docs other than those of more are left out.

    Rows are sorted by ranges of source, hash key, size and row, so neither a large source nor
    many rows of one doc_id, or of none, lie in one range.
    """
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id"), F.col("source")))
    sized = checkpointed(docs.select("doc_id", "source", size.cast("long").alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("row"), *more))
    dealt = sized.repartitionByRange(F.col("source").asc_nulls_last(), "key", "doc_id", "size", "row")
    sized = checkpointed(dealt.withColumn("range", F.spark_partition_id()))
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    totals = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    targets = cyclic_targets(totals, weights, share, most)
    in_source = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("source", "range", F.coalesce(F.sum("range_size").over(in_source), F.lit(0)).alias("range_start"))
    starts = starts.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    in_range = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("before", F.coalesce(F.sum("size").over(in_range), F.lit(0)))
    placed = placed.join(
        starts.withColumnsRenamed({"source": "of", "range": "at"}),
        F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("at")),
    )
    budget, whole = F.floor("target").cast("long"), F.col("source_size")
    epochs = F.when(whole > 0, F.floor(budget / F.greatest(whole, F.lit(1)))).otherwise(0).cast("long")
    rest = budget - epochs * whole - F.col("range_start") - F.col("before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *more)


def mix_documents(docs: DataFrame, size: Column, **params) -> DataFrame:
    """The rows of docs as the mix takes them: as often as an epoch takes a part of them, whole each time.

    The row at a source's cut is thus the only one that gives more than the
    budget. Rows that share a doc_id and a source share one decision: the mix
    counts their words together; so do those without a doc_id that share source and text. A row without words comes once: it costs nothing.
    Columns are those of docs.
    """
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    unit = docs.groupBy("doc_id", "source", own.alias("of_text")).agg(F.sum(size).alias("unit_size"))
    taken = mixed(unit, F.col("unit_size"), more=["of_text"], **params)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.ceil(F.col("taken") / F.col("size"))).cast("int")
    chosen = taken.select(F.col("doc_id").alias("of_doc"), F.col("source").alias("of_source"), "of_text", copies.alias("copies")).where("copies > 0")
    d, copy = docs.alias("d"), free_name(docs, "copy")
    same = F.col("d.doc_id").eqNullSafe(F.col("c.of_doc")) & F.col("d.source").eqNullSafe(F.col("c.of_source"))
    of_text = F.when(F.col("d.doc_id").isNull(), F.xxhash64("d.text")).eqNullSafe(F.col("c.of_text"))
    return d.join(chosen.alias("c"), same & of_text).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("c.copies")))).select("d.*")
