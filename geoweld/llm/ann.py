"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

The largest inner product is the smallest angle once vectors get one more
component that makes their lengths equal. A rotation learned on a bounded sample
(iterative quantisation) turns them into codes of 64 bits, close in Hamming
distance where the angle is small. Codes are cut into substrings, each with an
index of its own; two codes within r bits agree to within r // m bits in one of
the m substrings, so probing those finds every code within r. What is found is
ranked by the inner product of the original vectors.

Rows are dealt into blocks by hash, queries too, and each block of rows meets
each block of queries in one task, which builds the block's index and keeps the
best few for each query. Blocks have a bounded number of rows, so the memory of
a task doesn't grow with the table. Equal vectors are kept once with the smallest ids
that could be asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweld.llm.common import checkpointed

BITS, SUBSTRINGS = 64, 8
WIDTH = BITS // SUBSTRINGS
#: Rows that the rotation and the radius are learned from, and queries that the radius is tried with.
SAMPLE_ROWS, SAMPLE_QUERIES = 10_000, 200
#: Rows and queries of a block at most, and blocks that a small table is spread over.
BLOCK_ROWS, BLOCK_QUERIES, SMALL_BLOCKS = 1 << 15, 1 << 12, 12

_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Substring values within e bits of 0, for each e.
_NEAR = [np.flatnonzero(_POPCOUNT <= e).astype(np.uint8) for e in range(WIDTH + 1)]


@dataclass(frozen=True)
class Hashing:
    """longest: the largest norm; a code is the signs of ((x, rest) - centre) @ rotation. radius: bits to search within."""

    longest: float
    centre: np.ndarray
    rotation: np.ndarray
    radius: int

    def codes(self, x: np.ndarray, is_query: bool) -> np.ndarray:
        """Codes as rows of bytes."""
        norms = np.linalg.norm(x, axis=1)
        if is_query:
            full = np.column_stack([x / np.maximum(norms, 1e-300)[:, None], np.zeros(len(x))])
        else:
            full = np.column_stack([x / self.longest, np.sqrt(np.maximum(0, 1 - (norms / self.longest) ** 2))])
        return np.packbits((full - self.centre) @ self.rotation > 0, axis=1)


def fit(sample: np.ndarray, longest: float, k: int, reach: float = 0.97, rounds: int = 30, seed: int = 3) -> Hashing:
    """Rotation by iterative quantisation, and the radius that reaches the share `reach` of the sample's own k nearest.

    Nearest rows lie farther off in a sample than in the whole table, so the radius errs to the wide side.
    """
    rng = np.random.default_rng(seed)
    dim = sample.shape[1] + 1
    norms = np.linalg.norm(sample, axis=1) / longest
    full = np.column_stack([sample / longest, np.sqrt(np.maximum(0, 1 - norms**2))])
    centre = full.mean(axis=0)
    _, vectors = np.linalg.eigh((full - centre).T @ (full - centre))
    take = min(BITS, dim)
    principal = vectors[:, ::-1][:, :take]
    spread = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0][:take]  # fewer dimensions than bits: more directions than axes
    v, rotation = (full - centre) @ principal, spread
    if take == BITS:
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ rotation > 0, 1.0, -1.0).T @ v)
            rotation = (u @ w).T
    hashing = Hashing(longest, centre, principal @ rotation, BITS)
    picked = rng.choice(len(sample), min(SAMPLE_QUERIES, len(sample)), replace=False)
    scores = sample[picked] @ sample.T
    scores[np.arange(len(picked)), picked] = -np.inf
    k = min(k, max(1, len(sample) - 1))
    nearest = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    own, asked = hashing.codes(sample, False), hashing.codes(sample[picked], True)
    bits = _POPCOUNT[own[nearest] ^ asked[:, None, :]].sum(axis=2)
    return Hashing(longest, centre, principal @ rotation, int(np.quantile(bits, reach, method="higher")))


class MultiIndex:
    """Codes of one block, indexed by each substring."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.words = codes.view(np.uint64).ravel()
        self.order = np.argsort(codes, axis=0, kind="stable").astype(np.int32)
        self.starts = np.stack([np.searchsorted(codes[self.order[:, j], j], np.arange(257)) for j in range(SUBSTRINGS)])

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every code within radius bits: substrings up to r % m may differ by r // m bits, the others by one fewer."""
        hit = np.zeros(len(self.codes), bool)
        for j in range(SUBSTRINGS):
            e = min(WIDTH, radius // SUBSTRINGS - (j > radius % SUBSTRINGS))
            if e < 0:
                continue
            probes = (_NEAR[e] ^ code[j]).astype(np.int64)
            a, b = self.starts[j][probes], self.starts[j][probes + 1]
            n = b - a
            ends = np.cumsum(n)
            hit[self.order[np.repeat(a - (ends - n), n) + np.arange(ends[-1]), j]] = True
        found = np.flatnonzero(hit)
        return found[np.bitwise_count(self.words[found] ^ code.view(np.uint64)[0]) <= radius]


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, x (doubles) of the rows that take part: of the commonest length, finite, not all zero, with an id."""
    x = F.col("embedding").cast("array<double>")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)
        & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("x", lambda v: v != 0)
    )
    common = kept.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return kept.where(F.size("x") == (common["dim"] if common else 0))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by `every`, itself left out.

    Nearness is the inner product in double precision, ties go to the smaller
    vec_id. A query gets all candidates if there are fewer than k: where a
    block has fewer within the radius, the radius grows until it has k or all.
    Rows that don't take part (see usable) neither ask nor answer. Rows that repeat a
    vec_id with another vector are candidates each; a repeated row counts once. Other columns
    are left out.
    """
    rows = usable(vectors).distinct()
    # of equal vectors, only the k + 1 smallest ids can be among anyone's k
    part = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    few = F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1)
    some = rows.withColumn("vector", F.md5(F.col("x").cast("string"))).groupBy("vector", part).agg(
        F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"), F.first("x").alias("x")
    )
    distinct = checkpointed(some.groupBy("vector").agg(few.alias("ids"), F.first("x").alias("x")))
    asked = rows.where(F.col("vec_id") % every == 0).withColumn("vector", F.md5(F.col("x").cast("string"))).select("vec_id", "vector")
    askers = distinct.join(asked.select("vector").distinct(), "vector", "left_semi")
    n, longest = distinct.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    sample = distinct.orderBy(F.xxhash64(F.lit(1), "vector"), "vector").limit(SAMPLE_ROWS).select("x").toPandas()
    hashing = fit(np.array(sample["x"].tolist()), longest, k)
    shared = vectors.sparkSession.sparkContext.broadcast(hashing)
    blocks = max(-(-n // BLOCK_ROWS), min(SMALL_BLOCKS, -(-n // 1024)))
    groups = max(1, -(-askers.count() // BLOCK_QUERIES))
    hashed = F.xxhash64(F.lit(2), "vector")
    held = distinct.select(F.lit(False).alias("asks"), "vector", "ids", "x", F.pmod(hashed, F.lit(blocks)).alias("block"), F.explode(_numbers(groups)).alias("group"))
    asks = askers.select(F.lit(True).alias("asks"), "vector", F.lit(None).cast("array<long>").alias("ids"), "x", F.explode(_numbers(blocks)).alias("block"), F.pmod(hashed, F.lit(groups)).alias("group"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        own, queries = pdf[~pdf["asks"]], pdf[pdf["asks"]]
        out = []
        if len(own) and len(queries):
            x, q = np.array(own["x"].tolist()), np.array(queries["x"].tolist())
            index = MultiIndex(shared.value.codes(x, False))
            ids = own["ids"].tolist()
            members = np.array([len(v) for v in ids])
            for vector, one, code in zip(queries["vector"], q, shared.value.codes(q, True), strict=True):
                radius = shared.value.radius
                found = index.within(code, radius)
                while members[found].sum() < k + 1 and radius < BITS:
                    radius += 2
                    found = index.within(code, radius)
                score = np.einsum("ij,j->i", x[found], one)
                if len(found) > k + 1:
                    floor = np.partition(score, -(k + 1))[-(k + 1)]
                    found, score = found[score >= floor], score[score >= floor]
                pairs = sorted((-s, int(i)) for f, s in zip(found, score, strict=True) for i in ids[f])[: k + 1]
                out += [(vector, i, -s) for s, i in pairs]
        return pd.DataFrame(out, columns=["vector", "vec_id", "score"])

    near = held.union(asks).groupBy("block", "group").applyInPandas(search, "vector string, vec_id long, score double")
    best = F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v"))
    merged = near.groupBy("vector").agg(F.slice(F.array_sort(F.collect_list(best)), 1, k + 1).alias("near"))
    ranked = asked.join(merged, "vector").select(
        F.col("vec_id").alias("query_id"),
        F.posexplode(F.slice(F.filter("near", lambda c: c["v"] != F.col("vec_id")), 1, k)).alias("pos", "c"),
    )
    return ranked.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("c.v").alias("vec_id"), (-F.col("c.s")).alias("score"))
