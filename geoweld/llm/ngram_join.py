"""N-gram Jaccard join with adaptive multi-match prefixes.

Texts with equal shingle sets form a class; the join runs over classes. All sets
are ordered alike, shingles that are in many prefixes last. Two sets
whose overlap reaches the threshold then share at least k of their first
n - ceil(t * n) + k shingles. Every class chooses its k: a longer prefix meets
more shingles, but a pair must share k of them before it is verified, so k is
the one of least estimated cost. A pair goes by the smaller k of the two.

Prefixes can't tell apart the members of a large group of near copies, as all of them
hold its common shingles. At shingles that many classes share, a few central ones are
therefore drawn as pivots, and each class there is compared with them once: those
within the threshold are linked, and each class keeps the pivot it is close to as its centre
together with its difference from the centre's consensus, the shingles it adds and those it lacks. Between two
classes of one centre the distance follows from the differences alone, so they
never meet in the prefix join. They are joined by the shingles that they add, which are few
and rare: classes x and y at most L apart share at least
(added(x) + added(y) + |lacking(x) - lacking(y)| - L) / 2 of these. Where that is
nothing, sizes are close, and classes of such sizes are compared by what they lack.
A class of another centre that would meet many members at many shingles is a guest of theirs: its
difference from their consensus is taken too, and it meets them by that instead.

Only components are wanted, so links within one needn't all be tried: in both joins the members
outside a shingle's or a centre's largest part meet all of another one. No group is
cut: a pair that shares enough shingles is either decided or within a component already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweld.llm.common import SMALL_BATCHES, checkpointed, free_name, session_settings
from geoweld.llm.shingles import shingle_sets
from geoweld.operators.components import connected_components

#: The k of the prefixes.
SHARED = (1, 2, 4, 8, 16)
#: Cost of verifying a pair against that of meeting a shingle of it.
VERIFY_COST = 20
#: Entries that the list of frequent shingles has at most (8 MB): a shingle is on it if it holds more than this part of all prefix entries.
FREQUENT_LIST = 1 << 20
#: Prefixes that a shingle on it is in at least.
FREQUENT = 16
#: A shingle that so many classes share is a hub, where so many pivots are drawn; all but the first go by chance to this degree.
HUB, PIVOTS, JITTER = 8, 4, 0.3
#: A class is compared with a pivot if they share this part of the shingles that similar ones would. It takes the pivot that most
#: others are similar to, of those at most NEARLY times as far as the nearest.
TRIED, NEARLY = 0.25, 1.5
#: Sizes of differences are put in so many steps of the centre's size.
STEPS = 32
#: While the join runs, Spark removes an action's shuffle files once it has ended, as all that is read again is
#: checkpointed, and hands Python batches of a few MB.
SETTINGS = {
    "spark_sql_classic_shuffleDependency_fileCleanup_enabled": "true",
    "spark_sql_execution_arrow_maxRecordsPerBatch": "1000",
    **SMALL_BATCHES,
}
#: Bits of the filter that tells documents whose sets are wanted while texts are read (2 MB).
FILTER_BITS = 24

SKETCH = "doc_id long, version long, n long, id long, tokens array<long>"


def needed(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """The least overlap of a set of n with a similar one."""
    return (percent * n + 99) // 100


def apart(n: Column, percent: int) -> Column:
    """The most elements in which two similar sets with n elements between them (common ones twice) differ."""
    return F.floor((100 - percent) * n / (100 + percent) + 1e-9)


def digest_of(shingles: np.ndarray) -> int:
    """A class's id."""
    return int(np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), np.int64)[0])


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _prefix(shingles: np.ndarray, percent: int) -> np.ndarray:
    return shingles[: len(shingles) - needed(len(shingles), percent) + SHARED[-1]]


def _sketches(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Size, digest and prefix (of the longest kind) of each document's set, by hash; rows of SKETCH."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, tokens = [], [], []
            for u in shingle_sets(batch.column("text"), width):
                n.append(len(u))
                ids.append(digest_of(u))
                tokens.append(_prefix(u, percent))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("version"), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), _lists(tokens)],
                names=["doc_id", "version", "n", "id", "tokens"],
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("version")).mapInArrow(sketch, SKETCH)


def _wanted(docs: DataFrame, classes: DataFrame, width: int, make: Callable[[np.ndarray], np.ndarray], column: str, kind: str) -> DataFrame:
    """id, n and make(set) of the given classes: id, doc_id (one of its documents), version (of its text).

    Texts are read and hashed again, so sets are never kept for all documents; a filter of fixed size spares most other texts the hashing.
    """
    bit = F.pmod(F.xxhash64("doc_id", "version"), F.lit(1 << FILTER_BITS))
    places = classes.select((bit + 1).alias("bit"))  # Spark's bitmaps count from 1
    maps = places.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    there = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for part, found in maps.collect():  # 4 KB for each 32768 bits
        there[(part - 1) * 4096 : part * 4096] = np.frombuffer(found, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(there)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = shared.value
        for batch in batches:
            at = batch.column("bit").to_numpy()
            batch = batch.filter(pa.array((filled[at // 8] >> (at % 8)) & 1 == 1))
            sets = list(shingle_sets(batch.column("text"), width))
            made = [make(u) for u in sets]
            made = _lists(made) if kind == "array<long>" else pa.array([x.tobytes() for x in made], pa.binary())
            ids, n = pa.array([digest_of(u) for u in sets], pa.int64()), pa.array([len(u) for u in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, n, made], names=["id", "n", column])

    named = docs.select("doc_id", "text", F.xxhash64("text").alias("version")).select("text", bit.alias("bit"))
    found = named.mapInArrow(hashed, f"id long, n long, {column} {kind}").join(classes.select("id"), "id", "left_semi")
    return checkpointed(found.groupBy("id").agg(F.first("n").alias("n"), F.first(column).alias(column)))


def _sets_of(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """id, shingles (as bytes) of the given classes."""
    return _wanted(docs, classes, width, lambda u: u, "shingles", "binary").drop("n")


def _compared(pairs: DataFrame, sets: DataFrame, percent: int, whole: bool = False) -> DataFrame:
    """The pairs (a, b) with added (shingles of b that a lacks), lacking (of a that b lacks) and similar.

    added and lacking are counts, or the shingles themselves if whole.
    """
    kind = "array<long>" if whole else "long"

    @F.pandas_udf(f"added {kind}, lacking {kind}, similar boolean")
    def compare(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = []
        for p, q in zip(x, y, strict=True):
            u, v = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            added, lacking = np.setdiff1d(v, u, assume_unique=True), np.setdiff1d(u, v, assume_unique=True)
            both, union = len(v) - len(added), len(u) + len(added)
            same = 100 * both >= percent * union
            out.append((added.view(np.int64), lacking.view(np.int64), same) if whole else (len(added), len(lacking), same))
        return pd.DataFrame(out, columns=["added", "lacking", "similar"])

    with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b")), "b")
    both = with_b.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a")), "a")
    return checkpointed(both.select(*pairs.columns, compare("of_a", "of_b").alias("c")).select(*pairs.columns, "c.*"))


def _ends(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes that lie in a pair, as _sets_of wants them."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    return classes.select("id", "doc_id", "version").join(ids, "id", "left_semi")


def _side(entries: DataFrame, s: str, *more: str) -> DataFrame:
    return entries.select("token", F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("level").alias(f"l{s}"), F.col("k").alias(f"k{s}"), *(F.col(m).alias(f"{m}_{s}") for m in more))


def _candidates(met: DataFrame, percent: int) -> DataFrame:
    """Pairs that share as many shingles of their prefixes as similar sets must.

    met: a and b that meet in a shingle, with n, level and k of each (na, la, ka, nb, ...). With the
    smaller k of the two, a set of n has needed(n) - k shingles behind its prefix. What a pair shares
    outside both prefixes lies behind the one that ends first, so similar sets
    of n and m share within them all but that of their least overlap.
    """
    k = F.least("ka", "kb")
    near = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    counted = met.where(near & (F.greatest("la", "lb") <= k)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), _least(percent).alias("least"))
    return counted.groupBy("a", "b", "least").agg(F.count(F.lit(1)).alias("shared")).where("shared >= least").select("a", "b")


def _least(percent: int) -> Column:
    """Shingles of their prefixes that a similar pair shares at least."""
    k = F.least("ka", "kb")
    overlap = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent) - 1e-9)
    behind = F.floor((percent * F.greatest("na", "nb") + 99) / 100) - k
    return F.greatest(k, overlap - behind).cast("int")


def _classes(sketches: DataFrame) -> DataFrame:
    """id, doc_id (the smallest), version (of one of its texts), n and tokens of each class that has shingles."""
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "version")))
    found = sketches.where("n > 0").groupBy("id").agg(first.alias("first"), F.min("version").alias("any"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    return found.select("id", "first.doc_id", F.coalesce("first.version", "any").alias("version"), "n", "tokens")


def _repeated_entries(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """token, id, n, level, k: the prefix entries of classes whose shingle another one has as well.

    level is the least k whose prefix holds the entry.
    """
    counts = classes.select(F.explode("tokens").alias("token")).groupBy("token").count()
    total = classes.agg(F.sum(F.size("tokens"))).first()[0] or 0
    often = max(FREQUENT, -(-total // FREQUENT_LIST))
    found = counts.where(F.col("count") > often).select("token").toArrow().column(0).to_numpy()
    frequent = classes.sparkSession.sparkContext.broadcast(np.sort(found.astype(np.int64).view(np.uint64)))

    def often_in(u: np.ndarray) -> np.ndarray:
        f = frequent.value
        return f[np.minimum(np.searchsorted(f, u), len(f) - 1)] == u if len(f) else np.zeros(len(u), bool)

    @F.pandas_udf("boolean")
    def touched(prefixes: pd.Series) -> pd.Series:
        return pd.Series([bool(often_in(p.view(np.uint64)).any()) for p in prefixes], dtype=bool)

    def late(u: np.ndarray) -> np.ndarray:
        often = often_in(u)
        return _prefix(np.concatenate([u[~often], u[often]]), percent)

    # a prefix without frequent shingles stays as it is when these come last
    moved = _wanted(docs, classes.where(touched("tokens")), width, late, "tokens", "array<long>")
    own = classes.where(~touched("tokens")).select("id", "n", "tokens").union(moved)
    least = F.col("n") - F.floor((percent * F.col("n") + 99) / 100)
    placed = own.select("id", "n", F.posexplode("tokens").alias("pos", "token")).select(
        "token", "id", F.col("n").cast("int").alias("n"), F.greatest(F.lit(1), F.col("pos") + 1 - least).cast("int").alias("level")
    )
    repeated = placed.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    met = checkpointed(placed.join(repeated, "token"))
    cost = [F.sum(F.when(F.col("level") <= k, F.col("df") - 1).otherwise(0)) * (1 + VERIFY_COST / k) for k in SHARED]
    n = F.first("n")
    within = [F.when(n - (n - F.floor((percent * n + 99) / 100)) >= k, F.struct(c.alias("cost"), F.lit(k).alias("k"))) for k, c in zip(SHARED, cost, strict=True)]
    chosen = met.groupBy("id").agg(F.least(*within)["k"].alias("k"))
    return checkpointed(met.drop("df").join(chosen, "id"))


def _tried(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a pivot and a class that meets it at hubs often enough.

    Pivots are those that meet the most others at hubs for their size, as the least changed of many near
    copies do, and at each hub some more by chance. Each class meets at most PIVOTS of them there.
    """
    hubs = entries.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= HUB)
    at_hubs = entries.join(hubs, "token")
    central = at_hubs.groupBy("id").agg((F.sum("df") / F.first("n")).alias("central"))
    at_hubs = checkpointed(at_hubs.drop("df").join(central, "id"))
    lot = [F.lit(0), *(F.pmod(F.xxhash64(F.lit(i), "id"), F.lit(1000)) / 1000 for i in range(1, PIVOTS))]
    drawn = [F.max(F.struct((F.col("central") * (1 - JITTER * x)).alias("h"), "id", "n", "level", "k")) for x in lot]
    spread = at_hubs.groupBy("token").agg(F.array_distinct(F.transform(F.array(*drawn), lambda p: p.dropFields("h"))).alias("p"))
    pivots = spread.select("token", F.explode("p").alias("p")).select("token", "p.*")
    near = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    met = _side(at_hubs, "b").join(_side(pivots, "a"), "token").where((F.col("a") != F.col("b")) & near)
    counted = met.groupBy("a", "b", _least(percent).alias("least")).agg(F.count(F.lit(1)).alias("shared"))
    return checkpointed(counted.where(F.col("shared") >= TRIED * F.col("least")).select("a", "b"))


def _centres(compared: DataFrame) -> DataFrame:
    """a, b: the pivot a that class b takes as its centre. Pivots only take one that more classes are similar to."""
    weight = compared.groupBy("a").agg(F.count_if("similar").alias("weight"))
    of_b = weight.select(F.col("a").alias("b"), F.col("weight").alias("own"))
    known = compared.join(weight, "a").join(of_b, "b", "left")
    open_ = known.where(F.col("own").isNull() | (F.struct("own", "b") < F.struct("weight", "a")))
    near = F.collect_list(F.struct("weight", "a", (F.col("added") + F.col("lacking")).alias("far")))  # no more than PIVOTS times its prefix
    of = open_.groupBy("b").agg(near.alias("near"), F.min(F.col("added") + F.col("lacking")).alias("least"))
    return of.select(F.array_max(F.filter("near", lambda x: x["far"] <= NEARLY * F.col("least")))["a"].alias("a"), "b")


def _differing(chosen: DataFrame, sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """id, centre, size (the centre's), n, added, lacking of the pairs (a, b) of a centre and a class, where sets has both."""
    differ = _compared(chosen, sets, percent, whole=True).drop("similar")
    size = classes.select(F.col("id").alias("a"), F.col("n").alias("size"))
    n = F.col("size") + F.size("added") - F.size("lacking")
    return checkpointed(differ.join(size, "a").select(F.col("b").alias("id"), F.col("a").alias("centre"), "size", n.alias("n"), "added", "lacking"))


def _members(docs: DataFrame, classes: DataFrame, entries: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links found at pivots, each class that has a centre with its difference (see _differing), and the sets of all classes that were tried."""
    tried = _tried(entries, percent)
    sets = _sets_of(docs, _ends(tried, classes), width)
    compared = _compared(tried, sets, percent)
    chosen = checkpointed(_centres(compared))
    return compared.where("similar").select("a", "b"), _differing(chosen, sets, classes, percent), sets


def _consensus(members: DataFrame) -> DataFrame:
    """centre, more, fewer: the shingles that most members of a centre hold and it doesn't, and those that they lack.

    A pivot has changes of its own, which all others would seem to lack or add alike.
    Most members have no more than twice the average difference in common, so a centre's list is short.
    """
    each = members.select("centre", F.explode("added").alias("token"), F.lit(True).alias("more")).union(members.select("centre", F.explode("lacking"), F.lit(False)))
    counts = each.groupBy("centre", "token", "more").count().join(members.groupBy("centre").agg(F.count(F.lit(1)).alias("of")), "centre").where("2 * count > of")
    return checkpointed(counts.groupBy("centre").agg(F.collect_list(F.when(F.col("more"), F.col("token"))).alias("more"), F.collect_list(F.when(~F.col("more"), F.col("token"))).alias("fewer")))


def _refined(members: DataFrame, consensus: DataFrame) -> DataFrame:
    """members with differences from the centre's consensus instead of the centre."""
    none = F.array().cast("array<long>")
    known = members.join(consensus, "centre", "left").withColumns({x: F.coalesce(x, none) for x in ("more", "fewer")})
    return checkpointed(known.select(
        "id", "centre", (F.col("size") + F.size("more") - F.size("fewer")).alias("size"), "n",
        F.concat(F.array_except("added", "more"), F.array_except("fewer", "lacking")).alias("added"),
        F.concat(F.array_except("lacking", "fewer"), F.array_except("more", "added")).alias("lacking"),
    ))


def _to_nearest(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of each centre's least different member a with the others."""
    far = F.size("added") + F.size("lacking")
    least = members.groupBy("centre").agg(F.min(F.struct(far, F.col("id"))).alias("least")).select("centre", F.col("least.id").alias("a"))
    of = members.withColumnsRenamed({"id": "a", "n": "n_a", "added": "added_a", "lacking": "lacking_a"}).drop("size").join(least, ["centre", "a"])
    both = members.join(of, "centre").where("a <> id")
    common = F.size(F.array_intersect("added", "added_a")) + F.size(F.array_intersect("lacking", "lacking_a"))
    apart_by = far + F.size("added_a") + F.size("lacking_a") - 2 * common
    return checkpointed(both.where(apart_by <= apart(F.col("n") + F.col("n_a"), percent)).select("a", F.col("id").alias("b")))


def _centre_links(members: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes of one centre and different parts, from their differences. A class may have several centres."""
    of = members.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("part", F.coalesce("component", "id"))
    sizes = of.groupBy("centre", "part").count()
    main = sizes.groupBy("centre").agg(F.max(F.struct("count", "part"))["part"].alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    of = of.withColumns({"more": F.size("added"), "less": F.size("lacking")})
    of = checkpointed(of.join(main.drop("parts"), "centre").select("id", "centre", "part", "main", "size", "n", "more", "less", "added", "lacking"))
    sides = []
    for s, side in (("a", of.where("part <> main")), ("b", of)):
        sides.append(side.select("centre", *(F.col(c).alias(f"{c}_{s}") for c in of.columns if c != "centre")))
    outside, every = sides
    limit = apart(F.col("n_a") + F.col("n_b"), percent)
    least = F.ceil((F.col("more_a") + F.col("more_b") + F.abs(F.col("less_a") - F.col("less_b")) - limit) / 2)
    once = F.expr("part_a <> part_b AND (part_b = main_b OR id_a < id_b)")

    wide = ["lacking_a", "lacking_b", "added_a", "added_b"]
    met = outside.withColumn("token", F.explode("added_a")).drop(*wide).join(every.withColumn("token", F.explode("added_b")).drop(*wide), ["centre", "token"]).where(once)
    counted = met.groupBy("centre", "id_a", "id_b", limit.alias("limit"), least.alias("least"), (F.col("more_a") + F.col("more_b") + F.col("less_a") + F.col("less_b")).alias("all")).agg(F.count(F.lit(1)).alias("shared"))
    left = checkpointed(counted.where("shared >= least"))
    lacking = of.select("centre", "id", "lacking")
    both = left.join(lacking.withColumnsRenamed({"id": "id_a", "lacking": "lacking_a"}), ["centre", "id_a"]).join(lacking.withColumnsRenamed({"id": "id_b", "lacking": "lacking_b"}), ["centre", "id_b"])
    common = F.size(F.array_intersect("lacking_a", "lacking_b"))
    by_added = both.where(F.col("all") - 2 * F.col("shared") - 2 * common <= F.col("limit")).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))

    # classes that needn't share an added shingle: by steps of what they add and lack
    step = lambda s: F.greatest(F.lit(1), F.floor(F.col(f"size_{s}") / STEPS))
    kinds = [
        side.withColumns({f"add_{s}": F.floor(F.col(f"more_{s}") / step(s)), f"lack_{s}": F.floor(F.col(f"less_{s}") / step(s))})
        for s, side in (("a", outside), ("b", every))
    ]
    kind_a, kind_b = (k.select("centre", f"size_{s}", f"add_{s}", f"lack_{s}").distinct() for s, k in (("a", kinds[0]), ("b", kinds[1])))
    w, lo = step("a"), {x: F.col(x) * step("a") for x in ("add_a", "add_b", "lack_a", "lack_b")}
    between = F.greatest(F.lit(0), F.abs(lo["lack_a"] - lo["lack_b"]) - (w - 1))
    # least <= 0 with n = size + added - lacking; the left side grows with every size, so the least of a step serves
    may = (
        2 * percent * (lo["add_a"] + lo["add_b"]) + (100 - percent) * (lo["lack_a"] + lo["lack_b"]) + (100 + percent) * between
        <= 2 * (100 - percent) * F.col("size_a")
    )
    close = kind_a.join(kind_b, "centre").where(may).select("centre", "add_a", "lack_a", "add_b", "lack_b")
    alike = kinds[0].drop("added_a").join(close, ["centre", "add_a", "lack_a"]).join(kinds[1].drop("added_b"), ["centre", "add_b", "lack_b"])
    total = F.col("more_a") + F.col("more_b") + F.col("less_a") + F.col("less_b")
    by_sizes = alike.where(once & (least <= 0) & (total - 2 * common <= limit)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    return checkpointed(by_added.union(by_sizes))


def _placed(entries: DataFrame, centre: DataFrame, parts: DataFrame) -> DataFrame:
    """The entries that count at shingles of several cells (a centre's members) and parts, with the shingle's largest cell, `main`, and how many of it hold it, `often`."""
    placed = entries.where("level <= k").join(centre, "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left")
    placed = placed.select("token", "id", "n", "level", "k", F.coalesce("centre", "id").alias("cell"), F.coalesce("component", "id").alias("part"))
    sizes = placed.groupBy("token", "cell").agg(F.count(F.lit(1)).alias("count"), F.min("part").alias("low"), F.max("part").alias("high"))
    main = sizes.groupBy("token").agg(F.max(F.struct("count", "cell")).alias("most"), F.count(F.lit(1)).alias("cells"), F.min("low").alias("low"), F.max("high").alias("high")).where("cells > 1 AND low <> high")
    return checkpointed(placed.join(main.select("token", F.col("most.cell").alias("main"), F.col("most.count").alias("often")), "token"))


def _guests(placed: DataFrame, sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Classes of other cells that would meet the members of a centre at many of its hubs, with their differences from it, as _differing gives them."""
    near = placed.where((F.col("cell") != F.col("main")) & (F.col("often") >= HUB)).groupBy("main", "id").agg(F.count(F.lit(1)).alias("shared"))
    chosen = checkpointed(near.where(F.col("shared") >= HUB).select(F.col("main").alias("a"), F.col("id").alias("b")))
    return _differing(chosen, sets, classes, percent)


def _prefix_links(docs: DataFrame, classes: DataFrame, placed: DataFrame, guests: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between classes of different centres and parts, by their prefixes.

    Entries outside a shingle's largest cell meet all others there, but a guest's don't meet those of its host.
    """
    outside = placed.where("cell <> main").join(guests.select("id", F.col("centre").alias("main"), F.lit(True).alias("guest")), ["id", "main"], "left")
    inner = F.explode(F.when(F.col("guest"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True))))
    every = _side(placed, "b", "part", "cell", "main").withColumn("inner", F.col("cell_b") == F.col("main_b"))
    met = _side(outside.withColumn("inner", inner), "a", "part", "cell", "inner").withColumnRenamed("inner_a", "inner").join(every, ["token", "inner"])
    met = met.where("part_a <> part_b AND cell_a <> cell_b AND (inner OR a < b)")
    left = checkpointed(_candidates(met, percent))
    sets = _sets_of(docs, _ends(left, classes), width)
    return _compared(left, sets, percent).where("similar").select("a", "b")


def _class_components(docs: DataFrame, sketches: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The classes (id, doc_id, version, ...) and the links between them, both checkpointed."""
    classes = checkpointed(_classes(sketches))
    entries = _repeated_entries(docs, classes, width, percent)
    links, members, sets = _members(docs, classes, entries, width, percent)
    consensus = _consensus(members)
    members = _refined(members, consensus)
    links = links.union(_to_nearest(members, percent))
    parts = checkpointed(connected_components(links))
    placed = _placed(entries, members.select("id", "centre"), parts)
    guests = _guests(placed, sets, classes, percent)
    links = links.union(_centre_links(members.union(_refined(guests, consensus).select(members.columns)), parts, percent))
    links = links.union(_prefix_links(docs, classes, placed, guests, width, percent))
    return classes, checkpointed(links)


def _of_each(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The classes with their component, a number that stands for it."""
    found = connected_components(links).withColumnRenamed("node", "id")
    return classes.select("id", "doc_id", "version").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def similarity_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs.

    Two documents link when their sets of distinct `width`-word shingles have a
    Jaccard similarity of percent / 100 or more; component_id is the smallest
    doc_id reachable by links, the document's own included. Shingles, and equal sets, compare by
    64-bit hashes. A text without words, or a null one, has no shingles and links
    to nothing. Rows that share a doc_id are one document with several texts, so all of them lie in
    one component. Rows with a null doc_id link as others do; their component_id is
    null where no row of the component has a doc_id. Other columns are left out; an empty table gives an empty result.
    """
    with session_settings(docs.sparkSession, **SETTINGS):
        sketches = checkpointed(_sketches(docs, width, percent))
        classes, links = _class_components(docs, sketches, width, percent)
        texts = sketches.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "id")
        several = texts.groupBy("doc_id").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high")
        same = texts.join(several, "doc_id").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct()
        of = checkpointed(_of_each(classes, links.union(same)))
        least = of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        named = of.join(least, "component").select("id", "component_id")
    rows = sketches.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("id")).alias("id"))
    return rows.join(named, "id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs but for near-duplicates: of each component of texts one row, that of the smallest doc_id.

    Links are those of similarity_components, but between texts: of a doc_id with several texts each is kept that
    no smaller row covers. Of rows alike in doc_id and text one stays, by a hash of its other columns. Texts without words are no
    duplicates of others, and rows with a null doc_id stay. Columns are those of docs; reruns agree.
    """
    with session_settings(docs.sparkSession, **SETTINGS):
        sketches = checkpointed(_sketches(docs, width, percent))
        classes, links = _class_components(docs, sketches, width, percent)
        of = checkpointed(_of_each(classes, links)).where("doc_id IS NOT NULL")
        first = of.groupBy("component").agg(F.min(F.struct("doc_id", "version")).alias("f")).select("f.*")
        bare = sketches.where("n = 0 AND doc_id IS NOT NULL").select("doc_id", "version").distinct()
        keep = first.union(bare)
    # a text's rows: most stand alone and go through as they are; of several alike one is chosen, which combines before the shuffle
    rows = sketches.groupBy("doc_id", "version").agg(F.count(F.lit(1)).alias("rows"))
    keep = checkpointed(keep.join(rows, ["doc_id", "version"]).select("doc_id", "version", (F.col("rows") > 1).alias("several")))
    version, alike = free_name(docs, "version"), free_name(docs, "row")

    def kept(several: bool) -> DataFrame:
        d, k = docs.withColumn(version, F.xxhash64("text")).alias("d"), keep.where(F.col("several") == several).alias("k")
        return d.join(k, (F.col("d.doc_id").cast("long") == F.col("k.doc_id")) & (F.col(f"d.{version}") == F.col("k.version")), "left_semi")

    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = kept(True).groupBy("doc_id", version).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias(alike)).select(f"{alike}.*")
    return kept(False).drop(version).unionByName(one).unionByName(docs.where("doc_id IS NULL"))
