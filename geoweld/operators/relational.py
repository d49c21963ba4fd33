"""Ranking, upserts, diffs and rule tables over plain tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweld.functions.text import clamp, decay_weight
from geoweld.operators.components import checkpointed
from geoweld.operators.naming import first_rows, free_name, row_digest


def top_k(df: DataFrame, k: int, *order: Column, per: Sequence[str] = ()) -> DataFrame:
    """The first k rows, of each key if given. Without a key this is a sort with limit, which keeps k rows a task."""
    if not per:
        return df.orderBy(*order).limit(k)
    return first_rows(df, per, order, k)


def upserted(current: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """One row a key, the one of the latest version; a change wins over a current row of equal version.

    Of rows alike in all that, the one with the largest digest of its columns stays, so reruns agree.
    """
    new = free_name(changes, free_name(current, "new"))
    both = current.withColumn(new, F.lit(0)).unionByName(changes.withColumn(new, F.lit(1)), allowMissingColumns=True)
    return first_rows(both, [key], [F.col(version).desc(), F.col(new).desc(), row_digest(both).desc()]).drop(new)


def keyed_diff(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """key, left_value, right_value of the keys whose values differ or that one side lacks."""
    a = left.select(F.col(key), F.col(value).alias("left_value"))
    b = right.select(F.col(key), F.col(value).alias("right_value"))
    return a.join(b, key, "full_outer").where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def with_margin(df: DataFrame, per: str, score: str, tie: str, margin: float = 0.10) -> DataFrame:
    """The top row of each key with `reason`: single_candidate, top_confidence_margin, or ambiguous if the next is closer than margin."""
    w = Window.partitionBy(per).orderBy(F.col(score).desc(), F.col(tie))
    rank, after = free_name(df, "rank"), free_name(df, "next")
    ranked = df.withColumns({rank: F.row_number().over(w), after: F.lead(score).over(w)}).where(F.col(rank) == 1)
    reason = F.when(F.col(after).isNull(), "single_candidate").when(F.col(score) - F.col(after) >= margin, "top_confidence_margin").otherwise("ambiguous")
    return ranked.withColumn("reason", reason).drop(rank, after)


def learning_summary(records: DataFrame, entity: str, half_life_days: float = 30.0) -> DataFrame:
    """Runs of each entity: counts, last run, last failure's reason, decayed success and the adjustment drawn from it.

    records: entity, at (timestamp), success and repaired (boolean), reason. A run
    weighs half for each half life before the entity's newest run. The
    adjustment is 0 for a single run.
    """
    newest = records.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.max("at").alias("newest"))
    aged = records.join(newest, entity)
    weight = decay_weight((F.unix_micros("newest") - F.unix_micros("at")) / 86_400_000_000, half_life_days)
    failed = ~F.col("success")
    out = aged.withColumn("w", weight).groupBy(entity).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("success").alias("successes"), F.count_if("repaired").alias("repairs"), F.max("at").alias("last_run"),
        F.max_by(F.when(failed, F.col("reason")), F.when(failed & F.col("reason").isNotNull(), F.struct("at", "reason"))).alias("last_failure"),
        (F.sum(F.when(F.col("success"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("score"),
    )
    adjustment = F.when(F.col("runs") >= 2, clamp((F.col("score") - 0.5) * 0.2, -0.10, 0.10)).otherwise(0.0)
    return out.withColumn("adjustment", F.round(adjustment, 6)).withColumn("score", F.round("score", 6))


def retrieval_score(quality: Column, fit: Column, support: Column, missing: Column, weights: tuple[float, float, float] = (0.4, 0.4, 0.2), penalty: float = 0.1, most: float = 0.3) -> Column:
    """Weighted sum of values clamped to 0..1, less a bounded penalty for each missing requirement."""
    unit = [clamp(F.coalesce(c, F.lit(0.0)), 0.0, 1.0) for c in (quality, fit, support)]
    return F.round(clamp(sum((w * u for w, u in zip(weights, unit, strict=True)), F.lit(0.0)) - F.least(F.lit(most), penalty * missing), 0.0, 1.0), 6)


def compared(value: Column, op: Column, bound: Column) -> Column:
    """value against bound by eq, lt, lte, gt or gte; a missing value passes only where it should equal a missing bound."""
    test = F.when(op == "lt", value < bound).when(op == "lte", value <= bound).when(op == "gt", value > bound).when(op == "gte", value >= bound)
    return F.when(op == "eq", value.eqNullSafe(bound)).otherwise(F.coalesce(test, F.lit(False)))


def with_minted_ids(df: DataFrame, candidate: str, order: Sequence[str]) -> DataFrame:
    """df with `id`: the candidate where it is a number, else the largest one and 1, 2, ... in order.

    The rows without an id are sorted by ranges, which are numbered within and by the sizes of those before.
    """
    numeric = df.withColumn("id", F.col(candidate).try_cast("long"))
    top = free_name(numeric, "top")
    largest = numeric.agg(F.coalesce(F.max("id"), F.lit(0)).alias(top))
    numbered = with_row_numbers(numeric.where("id IS NULL").drop("id"), order, "id")
    minted = numbered.crossJoin(F.broadcast(largest)).withColumn("id", F.col(top) + F.col("id")).drop(top)
    return numeric.where("id IS NOT NULL").unionByName(minted)


def with_running_total(df: DataFrame, order: Sequence[str | Column], value: str, name: str) -> DataFrame:
    """df with the sum of value over the rows before each in a total order, without one task that sees them all.

    Rows are dealt by ranges of the order; each range adds up by itself, and one row a range tells
    the sum of those before it.
    """
    part, start = free_name(df, "part"), free_name(df, "start of part")
    dealt = checkpointed(df.repartitionByRange(*(F.col(c) if isinstance(c, str) else c for c in order)).withColumn(part, F.spark_partition_id()))
    none = F.lit(0).cast("long")
    upto = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), none)
    sums = dealt.groupBy(part).agg(F.sum(value).alias(value))
    starts = sums.select(F.col(part), upto(Window.orderBy(part)).alias(start))
    own = upto(Window.partitionBy(part).orderBy(*order))
    return dealt.join(F.broadcast(starts), part).withColumn(name, F.col(start) + own).drop(part, start)


def with_row_numbers(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """df with its rows' numbers, from 1, in a total order."""
    one = free_name(df, "one")
    return with_running_total(df.withColumn(one, F.lit(1).cast("long")), order, one, name).withColumn(name, F.col(name) + 1).drop(one)


def exact_quantile(df: DataFrame, value: str, q: float) -> DataFrame:
    """One row with `quantile`: the q-quantile of the values by linear interpolation, null if there are none.

    Distinct values are counted and ranked by ranges, so no task holds them all.
    """
    sizes = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ranked = checkpointed(with_running_total(sizes, ["v"], "c", "before"))
    n = ranked.agg(F.sum("c").alias("n"))
    at = q * (F.col("n") - 1)
    low, high = F.floor(at), F.ceil(at)
    holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("c"))
    ends = ranked.crossJoin(F.broadcast(n)).agg(F.max(F.when(holds(low), F.col("v"))).alias("a"), F.max(F.when(holds(high), F.col("v"))).alias("b"), F.max(at - low).alias("t"))
    return ends.select((F.col("a") + (F.col("b") - F.col("a")) * F.col("t")).alias("quantile"))


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float], key: Sequence[str] = ()) -> DataFrame:
    """key, q0, q1, ...: quantiles of each key's values by linear interpolation. Keys without a value have no row.

    Distinct values of all keys are ranked in ranges together, so a key may have any number of them.
    """
    sizes = df.where(F.col(value).isNotNull()).groupBy(*key, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ranked = checkpointed(with_running_total(sizes, [*key, "v"], "c", "before"))
    per = ranked.groupBy(*key).agg(F.sum("c").alias("n"), F.min("before").alias("start"))
    alike = [F.col(f"r.{k}").eqNullSafe(F.col(f"p.{k}")) for k in key]
    both = ranked.alias("r").join(per.alias("p"), reduce(Column.__and__, alike)) if key else ranked.alias("r").crossJoin(F.broadcast(per.alias("p")))
    own = F.col("r.before") - F.col("p.start")
    aggregates = []
    for i, share in enumerate(shares):
        at = share * (F.col("p.n") - 1)
        holds = lambda k: (own <= k) & (k < own + F.col("r.c"))
        low, high = (F.max(F.when(holds(k), F.col("r.v"))) for k in (F.floor(at), F.ceil(at)))
        aggregates.append((low + (high - low) * F.max(at - F.floor(at))).alias(f"q{i}"))
    return both.groupBy(*(F.col(f"r.{k}") for k in key)).agg(*aggregates)


def set_metrics(expected: Column, found: Column) -> dict[str, Column]:
    """precision, recall and F1 of two arrays as sets; recall is 1 if nothing is expected, precision 1 only if nothing is found either."""
    hits, n_e, n_f = F.size(F.array_intersect(expected, found)), F.size(F.array_distinct(expected)), F.size(F.array_distinct(found))
    precision = F.when(n_f > 0, hits / n_f).when(n_e == 0, 1.0).otherwise(0.0)
    recall = F.when(n_e > 0, hits / n_e).otherwise(1.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return {"precision": F.round(precision, 6), "recall": F.round(recall, 6), "f1": F.round(f1, 6)}


def normalized_columns(df: DataFrame, profile: dict[str, list[str]]) -> DataFrame:
    """The profile's canonical columns, each from the first of its candidate columns that has a value in the row."""
    from geoweld.functions.text import first_present

    there = {c.lower(): c for c in df.columns}
    made = []
    for name, candidates in profile.items():
        found = [F.col(there[c.lower()]) for c in candidates if c.lower() in there]
        made.append((first_present(*found) if found else F.lit(None).cast("string")).alias(name))
    return df.select(*made)
