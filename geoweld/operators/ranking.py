"""Scores, orders and choices among candidates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweld.functions.text import clamp
from geoweld.operators.naming import first_rows


def weighted_score(core: Mapping[str, float], optional: Mapping[str, float], mix: tuple[float, float] = (0.6, 0.4), primary: float = 0.3, missing_core: float = 0.0, neutral: float = 0.5) -> Column:
    """The policy's score of a candidate with columns success_rate, accuracy, learning and those of core and optional, each with its weight.

    A missing core value counts as missing_core, a missing optional one as neutral, missing learning as none.
    """
    core_value = lambda c: F.coalesce(F.col(c), F.lit(missing_core))
    total = primary * (mix[0] * core_value("success_rate") + mix[1] * core_value("accuracy"))
    for c, w in core.items():
        total = total + w * core_value(c)
    for c, w in optional.items():
        total = total + w * F.coalesce(F.col(c), F.lit(neutral))
    return total + F.coalesce(F.col("learning"), F.lit(0.0))


def ranked_patterns(patterns: DataFrame, steps: DataFrame, algorithms: DataFrame, supported: DataFrame, preferred: str | None = None, penalty: float = 0.1, most: float = 0.3) -> DataFrame:
    """pattern, fit, support, missing, score, place: patterns by how well their steps are served; a preferred one comes first.

    patterns: pattern, quality. steps: pattern, step, algorithm, source_type. algorithms: algorithm, rate. supported: source_type. A step without
    a rate counts as its pattern's quality.
    """
    # kinds of sources are few, and most steps may be of one: broadcast, as by a shuffle all those would meet in one task
    known = F.broadcast(supported.select("source_type", F.lit(True).alias("there")).distinct())
    served = steps.join(algorithms, "algorithm", "left").join(known, "source_type", "left")
    per = served.join(patterns, "pattern").groupBy("pattern").agg(
        F.avg(F.coalesce("rate", "quality")).alias("fit"), F.avg(F.coalesce(F.col("there").cast("int"), F.lit(0))).alias("support"),
        F.count_distinct(F.when(F.col("there").isNull(), F.col("source_type"))).alias("missing"), F.first("quality").alias("quality"),
    )
    score = clamp(0.4 * F.col("quality") + 0.4 * F.col("fit") + 0.2 * F.col("support") - F.least(F.lit(most), penalty * F.col("missing")), 0.0, 1.0)
    first = (F.col("pattern") == preferred) if preferred is not None else F.lit(False)
    return per.select("pattern", F.round("fit", 6).alias("fit"), F.round("support", 6).alias("support"), "missing", F.round(score, 6).alias("score"), first.alias("preferred"))


def served_patterns(patterns: DataFrame, kind: str, disaster: str | None, scores: DataFrame, k: int) -> DataFrame:
    """The k best patterns of a kind that serve the disaster or any ("generic"), by rate and what was learnt of them.

    patterns: pattern, kind, disasters (array), rate. scores: pattern, delta.
    """
    wanted = (disaster or "generic").lower()
    fits = F.exists("disasters", lambda d: F.lower(d).isin(wanted, "generic"))
    rows = patterns.where((F.col("kind") == kind) & fits).join(scores, "pattern", "left")
    return rows.withColumn("score", F.round(F.col("rate") + F.coalesce("delta", F.lit(0.0)), 6)).drop("delta").orderBy(F.desc("score"), "pattern").limit(k)


def per_type(sources: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """type, source, score: the k best sources that serve each wanted type; sources: source, types (array), score."""
    each = sources.select("source", "score", F.explode("types").alias("type")).join(wanted.select("type").distinct(), "type", "left_semi")
    return first_rows(each, ["type"], [F.desc("score"), "source"], k).select("type", "source", "score")


def alternatives(algorithms: DataFrame, links: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """algorithm, other, score: the k best known alternatives of each algorithm; links: algorithm, other."""
    rated = algorithms.join(scores, "algorithm", "left").select(F.col("algorithm").alias("other"), F.round(F.col("rate") + F.coalesce("delta", F.lit(0.0)), 6).alias("score"))
    return first_rows(links.distinct().join(rated, "other"), ["algorithm"], [F.desc("score"), "other"], k).select("algorithm", "other", "score")


def feedback_scores(feedback: DataFrame, key: str, gain: float, loss: float) -> DataFrame:
    """key, delta: what the runs say of each entity, a gain for a success and a loss for a failure; rows without key are left out."""
    return feedback.where(F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != "")).groupBy(key).agg(F.round(F.sum(F.when(F.col("success"), gain).otherwise(-loss)), 6).alias("delta"))


def reusable(artifacts: DataFrame, kind: str, box: tuple[float, float, float, float], since: str, k: int = 1) -> DataFrame:
    """The k newest artifacts of a kind that cover the box and aren't older than since; artifacts: artifact, kind, created, minx, ..."""
    x1, y1, x2, y2 = box
    covers = (F.col("minx") <= x1) & (F.col("miny") <= y1) & (F.col("maxx") >= x2) & (F.col("maxy") >= y2)
    return artifacts.where((F.col("kind") == kind) & covers & (F.col("created") >= F.lit(since).cast("timestamp"))).orderBy(F.desc("created"), "artifact").limit(k)


def ranked_paths(paths: DataFrame, path: str, words: Sequence[str], k: int) -> DataFrame:
    """The k paths with the most of the words, of equals the shorter, then in order."""
    hits = sum((F.lower(path).contains(w.lower()).cast("int") for w in words), F.lit(0))
    return paths.withColumn("hits", hits).orderBy(F.desc("hits"), F.length(path), path).limit(k)


def custom_order(column: Column, values: Sequence[str]) -> Column:
    """The place of a value in a list, others after all of them."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, values)), column), F.lit(0)), F.lit(len(values) + 1))


def page(df: DataFrame, at: str, key: str, number: int = 1, size: int = 100) -> DataFrame:
    """A page of rows, the newest first; at most 100 of them."""
    size = max(1, min(100, size))
    return df.orderBy(F.desc(at), key).offset((max(1, number) - 1) * size).limit(size)


def one_by_key(df: DataFrame, key: str, value: object, order: Sequence[Column]) -> DataFrame:
    return df.where(F.col(key) == F.lit(value)).orderBy(*order).limit(1)


def first_available(candidates: DataFrame, role: str) -> DataFrame:
    """role, id, path: of each role the available candidate that comes first by priority and id."""
    return first_rows(candidates.where("available"), [role], ["priority", "id"]).select(role, "id", "path")


def most_hinted(rows: DataFrame, per: str, text: str, hints: Sequence[str]) -> DataFrame:
    """Of each key the rows with the most of the hints in their text, all of equals; rows without any are left out."""
    score = sum((F.lower(text).contains(h.lower()).cast("int") for h in hints), F.lit(0))
    scored = rows.withColumn("hits", score).where("hits > 0")
    best = scored.groupBy(per).agg(F.max("hits").alias("most hits"))
    return scored.join(best, per).where(F.col("hits") == F.col("most hits")).drop("most hits")
