"""Runs: stretches of words that repeat with a period, found by divide and conquer at midpoints.

The words of a batch of texts are interned as integers. All segments of one size
are worked on together: at the midpoint of each, the Z-function of its right half
(how far the words from the midpoint on agree with those p later) and that of the
reversed left half tell every repetition of period p that crosses the midpoint;
the halves follow. A run of four periods has two on one side of the midpoint, so
there its Z-value is p or more; it is worked out only where the first words
agree, as it is too low elsewhere. Agreements are measured by names of blocks of 1, 2, 4 ... words (equal
blocks have equal names), so they are exact and reach beyond the segment: every
repetition found is extended as far as its text allows. The same stretch is then
found by several periods and in several segments; the smallest period stays.

Work is words times the logarithm of the longest text, memory 4 bytes a word of
texts that do repeat for each doubling of their longest repeated stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweld.llm.common import free_name

#: Bytes of text that are interned and searched at once; a longer text goes alone.
CHUNK_BYTES = 4 << 20
#: Words that are compared one by one before the agreement is measured by blocks.
FIRST_WORDS = 8
#: Candidate periods that are looked at together.
CANDIDATES = 1 << 21

FOUND = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.large_string())])


class Blocks:
    """How far two places of a sequence agree, forwards and backwards. The sequence ends in a value that occurs once."""

    def __init__(self, ids: np.ndarray):
        self.names = [ids.astype(np.int32)]
        while True:
            half, last = 1 << (len(self.names) - 1), self.names[-1]
            if 2 * half > len(ids):
                return
            pairs = last[:-half].astype(np.int64) * len(ids) + last[half:]
            known, names = np.unique(pairs, return_inverse=True)
            if len(known) == len(pairs):
                return  # no longer block occurs twice
            self.names.append(names.astype(np.int32))

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The length of the longest common prefix of the sequence from a and from b, a < b."""
        far = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names = self.names[k]
            inside = np.flatnonzero(b + far < len(names))
            at = far[inside]
            same = names[a[inside] + at] == names[b[inside] + at]
            far[inside[same]] += 1 << k
        return far

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The length of the longest common suffix of the sequence before a and before b, a < b."""
        far = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names, size = self.names[k], 1 << k
            inside = np.flatnonzero(a - far >= size)
            at = far[inside] + size
            same = names[a[inside] - at] == names[b[inside] - at]
            far[inside[same]] += size
        return far


def _periods(ids: np.ndarray, mid: np.ndarray, most: np.ndarray, step: int, power: int) -> tuple[np.ndarray, np.ndarray]:
    """Midpoints and periods p <= most whose Z-value may be high enough: the first words at the midpoint (going by step) agree with those p on."""
    p = np.arange(1, most.sum() + 1) - np.repeat(np.cumsum(most) - most, most)
    m = np.repeat(mid, most)
    for j in range(FIRST_WORDS):
        enough = 2 * j >= (power - 2) * p
        here = (m if step > 0 else m - 1) + np.where(enough, 0, step * j)
        same = enough | (ids[here] == ids[np.where(enough, here, here + step * p)])
        m, p = m[same], p[same]
        if not len(p):
            break
    return m, p


def candidates(ids: np.ndarray, low: np.ndarray, high: np.ndarray, least: int, power: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, p): places a < a + p about a midpoint whose surroundings may repeat with period p, for all segments [low, high) and their halves.

    A run about a midpoint has half of its periods or more on one side of it, within the segment.
    """
    while True:
        long = high - low >= least
        low, high = low[long], high[long]
        if not len(low):
            return
        mid = (low + high) // 2
        for most, step in ((2 * (high - mid) // power, 1), (2 * (mid - low) // power, -1)):
            part = np.cumsum(most) // CANDIDATES
            for s in np.split(np.arange(len(mid)), np.flatnonzero(np.diff(part)) + 1):
                m, p = _periods(ids, mid[s], most[s], step, power)
                if len(p):
                    yield (m if step > 0 else m - p), p
        low, high = np.concatenate([low, mid]), np.concatenate([mid, high])


def maximal_runs(ids: np.ndarray, sizes: np.ndarray, least: int = 6, power: int = 4) -> np.ndarray:
    """Rows (text, start, length, period) by text, start and period of texts that lie in ids one after another.

    A run is as long as its smallest period allows, has at least `least` words
    and `power` (2 or more) periods.
    """
    if power < 2 or least < 2:
        raise ValueError("a run has two words and two periods at least")
    n = len(sizes)
    ends = np.cumsum(sizes)
    place = np.arange(len(ids)) + np.repeat(np.arange(n), sizes)  # a mark of its own ends each text
    marked = np.zeros(len(ids) + n, np.int64)
    marked[ends + np.arange(n)] = np.arange(n)
    marked[place] = ids + n
    starts = ends - sizes + np.arange(n)
    hopeful = np.zeros(n, bool)
    for a, _ in candidates(marked, starts, starts + sizes, max(least, power), power):
        hopeful[np.searchsorted(starts, a, "right") - 1] = True
    if not hopeful.any():
        return np.zeros((0, 4), np.int64)
    own = np.repeat(hopeful, sizes + 1)
    marked, text, sizes = np.unique(marked[own], return_inverse=True)[1], np.flatnonzero(hopeful), sizes[hopeful]
    starts = np.cumsum(sizes + 1) - sizes - 1
    blocks, found = Blocks(marked), [np.zeros((0, 3), np.int64)]
    for a, p in candidates(marked, starts, starts + sizes, max(least, power), power):
        start = a - blocks.backward(a, a + p)
        end = a + p + blocks.forward(a, a + p)
        good = end - start >= np.maximum(least, power * p)
        rows = np.stack([start, end, p], axis=1)[good]
        found.append(_smallest(rows))
    start, end, period = _smallest(np.concatenate(found)).T
    of = np.searchsorted(starts, start, "right") - 1
    rows = np.stack([text[of], start - starts[of], end - start, period], axis=1)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _smallest(rows: np.ndarray) -> np.ndarray:
    """One row for each start and end, that of the smallest period."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[new]


def found_in(texts: list[str | None], least: int, power: int) -> pa.Array:
    """A row of FOUND for each text."""
    words = [(t or "").encode().split() for t in texts]  # bytes split at ASCII white space alone
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = pa.array([w for own in words for w in own], pa.large_binary())
    ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    rows = maximal_runs(ids, sizes, least, power)
    change = np.zeros(len(ids) + 1, np.int64)
    first = np.cumsum(sizes) - sizes
    np.add.at(change, first[rows[:, 0]] + rows[:, 1] + rows[:, 3], 1)
    np.add.at(change, first[rows[:, 0]] + rows[:, 1] + rows[:, 2], -1)
    dropped = np.cumsum(change)[:-1] > 0
    changed = set(rows[:, 0].tolist())
    kept = [
        b" ".join(w for w, gone in zip(own, dropped[first[i] : first[i] + sizes[i]], strict=True) if not gone) if i in changed else b" ".join(own)
        for i, own in enumerate(words)
    ]
    offsets = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1)).astype(np.int32)
    runs = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in (1, 2, 3)], fields=list(FOUND.field("runs").type.value_type))
    return pa.StructArray.from_arrays(
        [pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), runs), pa.array(kept, pa.large_binary()).cast(pa.large_string())], fields=list(FOUND)
    )


def with_runs(docs: DataFrame, text: str | Column = "text", least: int = 6, power: int = 4) -> DataFrame:
    """docs with n_words, runs (start, length and period in words, by start and period) and collapsed (the text without repetitions).

    A word is a run of characters other than ASCII white space. A run has at
    least `least` words and `power` periods, its period is its smallest, and it can't be
    extended. collapsed leaves out what any run holds beyond its first period and
    joins the other words by one space. Null and empty texts have no words, no
    runs and an empty collapsed text. Columns of docs under these names are
    replaced; rows that repeat are each worked out.
    """

    @F.arrow_udf("struct<n_words: long, runs: array<struct<start: long, length: long, period: long>>, collapsed: string>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out, some, size = [], [], 0
            for t in texts:
                some.append(t.as_py())
                size += len(some[-1] or "")
                if size >= CHUNK_BYTES:
                    out.append(found_in(some, least, power))
                    some, size = [], 0
            if some or not out:
                out.append(found_in(some, least, power))
            yield pa.concat_arrays([x.cast(SPARK_FOUND) for x in out])

    found = free_name(docs, "found")
    old = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {"n_words", "runs", "collapsed"}]
    told = docs.withColumn(found, find(F.col(text) if isinstance(text, str) else text))
    return told.select(*old, *(F.col(found)[c].alias(c) for c in ("n_words", "runs", "collapsed")))


#: As Spark takes it: strings of a batch, which is far below 2 GB.
SPARK_FOUND = pa.struct([FOUND.field("n_words"), FOUND.field("runs"), ("collapsed", pa.string())])


def with_planted_tail(docs: DataFrame, text: str = "text", key: str = "doc_id") -> Column:
    """The text, whose words from some place on repeat with some period where crc32 of the key ends in 0.

    With h = crc32 of the key in decimal and g = floor(h / 10): place a = g % n of n
    words and period 1 + floor((n - a) / (3 + g % 8)). A null key changes nothing.
    """
    h = F.crc32(F.col(key).cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    return F.when((h % 10 == 0) & (n > 0), planted).otherwise(F.col(text))
