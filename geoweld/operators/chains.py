"""Segments put together into chains, by pointer doubling.

Every segment points to the one that follows it. In each round a segment's pointer
moves on to where the one it points to points, and its distance grows by that one's, so
after as many rounds as the longest chain has doublings each knows the end of its
chain and its place. A ring has no end; it is known once no round tells its segments a smaller
point, and is cut at its least one. No task sees more than its share of the segments, however long a chain is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweld.operators.components import checkpointed

ENDS = ("x1", "y1", "x2", "y2")


def _ranked(links: DataFrame) -> DataFrame:
    """h, end, dist of links (h, x, y, next): the last of each one's chain and the steps to it; rings are cut before their least (x, y, h)."""
    low = F.struct("x", "y", "h")
    last = F.col("next").isNull()
    state = checkpointed(links.select("h", F.col("next").alias("to"), F.when(last, F.col("h")).alias("end"), F.when(last, 0).otherwise(1).cast("long").alias("dist"), low.alias("low"), F.lit(False).alias("new")))
    while True:
        o = state.select(F.col("h").alias("to"), F.col("to").alias("o_to"), F.col("end").alias("o_end"), F.col("dist").alias("o_dist"), F.col("low").alias("o_low"))
        open_, done = state.where("to IS NOT NULL"), state.where("to IS NULL")
        moved = open_.join(o, "to").select(
            "h", F.col("o_to").alias("to"), F.col("o_end").alias("end"), (F.col("dist") + F.col("o_dist")).alias("dist"), F.least("low", "o_low").alias("low"),
            (F.col("o_end").isNotNull() | (F.col("o_low") < F.col("low"))).alias("new"),
        )
        state = checkpointed(moved.union(done.withColumn("new", F.lit(False))))
        left = state.agg(F.coalesce(F.bool_or("new"), F.lit(False)).alias("new"), F.count_if(F.col("to").isNotNull()).alias("left")).first()
        if not left["new"]:
            break
    found = state.where("to IS NULL").select("h", "end", "dist")
    if not left["left"]:
        return found
    rings = state.where("to IS NOT NULL").select("h", F.col("low.h").alias("first"))
    cut = links.join(rings, "h").select("h", "x", "y", F.when(F.col("next") != F.col("first"), F.col("next")).alias("next"))
    return found.union(_ranked(cut))


def chains(segments: DataFrame, key: Sequence[str] = (), directed: bool = False) -> DataFrame:
    """key, chain, place, x1, y1, x2, y2: the segments of each key in the order and direction of their chains, place from 0.

    Undirected segments are joined where just two ends meet, and a chain runs from its lesser end (of equal ones,
    to the lesser neighbour). Directed ones go on to the one that leaves their end, of several
    to the first clockwise from where they came. Rings start at their least point. Segments
    without length, or with a null or infinite end, are left out; ones that repeat count each. The numbers of chains differ from run to run.
    """
    real = segments.where(" AND ".join([f"abs({c}) < double('infinity')" for c in ENDS]) + " AND (x1 <> x2 OR y1 <> y2)")
    own = checkpointed(real.select(*key, *ENDS, F.monotonically_increasing_id().alias("n")))
    forth = own.select(*key, *ENDS, (F.col("n") * 2).alias("h"))
    halves = forth if directed else forth.union(own.select(*key, "x2", "y2", "x1", "y1", F.col("n") * 2 + 1).toDF(*key, *ENDS, "h"))
    follow = _followers(halves, key) if directed else _pairs_at_ends(halves, key)
    ranked = checkpointed(_ranked(halves.select("h", F.col("x1").alias("x"), F.col("y1").alias("y")).join(follow, "h", "left")))
    whole = halves.join(ranked, "h")
    if directed:
        sizes = ranked.groupBy("end").agg(F.max("dist").alias("most"))
        return whole.join(sizes, "end").select(*key, F.col("end").alias("chain"), (F.col("most") - F.col("dist")).alias("place"), *ENDS)
    ends = halves.select(F.col("h").alias("end"), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"), F.col("x1").alias("bx"), F.col("y1").alias("by")).alias("tail"))
    told = whole.join(ends, "end")
    back = told.select(F.col("h").bitwiseXOR(F.lit(1).cast("long")).alias("h"), F.col("tail").alias("head"), F.col("end").alias("back"), F.col("dist").alias("place"))
    both = told.join(back, "h")
    forward = (F.col("head") < F.col("tail")) | ((F.col("head") == F.col("tail")) & (F.col("end") < F.col("back")))
    return both.where(forward).select(*key, F.col("end").alias("chain"), "place", *ENDS)


def _pairs_at_ends(halves: DataFrame, key: Sequence[str]) -> DataFrame:
    """h, next where just two segments meet: of those that arrive at a point, each is followed by the other one turned round."""
    turned = lambda h: h.bitwiseXOR(F.lit(1).cast("long"))
    two = halves.groupBy(*key, "x2", "y2").agg(F.count(F.lit(1)).alias("count"), F.min("h").alias("a"), F.max("h").alias("b")).where("count = 2")
    pair = lambda h, other: F.struct(F.col(h).alias("h"), turned(F.col(other)).alias("next"))
    return two.select(F.explode(F.array(pair("a", "b"), pair("b", "a"))).alias("p")).select("p.*")


def _followers(halves: DataFrame, key: Sequence[str]) -> DataFrame:
    """h, next: at the end of each segment the one that leaves it, of several the first clockwise from the way back."""
    by = lambda prefix: [F.col(c).alias(f"{prefix}{c}") for c in (*key, *ENDS, "h")]
    met = F.lit(True)
    for k in key:
        met &= F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}"))
    pairs = halves.select(*by("a_")).join(halves.select(*by("b_")), met & (F.col("a_x2") == F.col("b_x1")) & (F.col("a_y2") == F.col("b_y1")))
    back = F.atan2(F.col("a_y1") - F.col("a_y2"), F.col("a_x1") - F.col("a_x2"))
    turn = F.pmod(back - F.atan2(F.col("b_y2") - F.col("b_y1"), F.col("b_x2") - F.col("b_x1")), F.lit(6.283185307179586))
    order = F.struct(F.when(turn > 1e-12, turn).otherwise(7.0).alias("turn"), F.col("b_h").alias("h"))
    return pairs.groupBy(F.col("a_h").alias("h")).agg(F.min(order).alias("best")).select("h", F.col("best.h").alias("next"))


def merged_lines(segments: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """key, part, points: the chains as polylines, part from 0 within a key by their points. A chain is one row here; chains() has a row a segment."""
    linked = chains(segments, key)
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    rows = linked.groupBy(*key, "chain").agg(F.array_sort(F.collect_list(F.struct("place", point("x1", "y1").alias("p"), point("x2", "y2").alias("q")))).alias("s"))
    points: Column = F.concat(F.transform("s", lambda s: s["p"]), F.array(F.element_at("s", -1)["q"]))
    made = rows.select(*key, points.alias("points"))
    return made.withColumn("part", F.row_number().over(Window.partitionBy(*key).orderBy("points")) - 1) if key else made
