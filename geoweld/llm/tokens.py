"""Token ids of whole texts, and shards of raw ids with keyed access.

Ids come from a public tokenizer file through the tokenizers library. In its
pre-tokenizer, white space always ends a piece, so a text's ids are those of its
words in a row; each task encodes a distinct word once and looks up the rest.

A shard is a row: the raw little-endian uint32 ids of its documents, the end
offset of each document, and a minimal perfect hash from document keys to the
document's number, with a fingerprint to refuse foreign keys. Shards follow the
keys' order, are bounded in bytes and are written by Spark, so they may lie in any
store that Spark writes to.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoweld.llm.common import SMALL_BATCHES, session_settings

#: Words that a Python worker remembers; beyond, it starts anew.
REMEMBERED = 700_000
#: A word with marks after a final letter.
MARKED = r"^(?P<stem>(?s:.)*[a-z])(?P<marks>[.,;:!?)|\]\"']+)$"
#: Bytes of text that are split into words at once.
TEXT_BYTES = 4 << 20
#: Bytes of ids at which a shard closes.
SHARD_BYTES = 1 << 20
#: Bytes of texts in a range of keys, and the number of ranges from which they grow.
LEAST_RANGE, MOST_RANGE, MANY_RANGES = 12 << 20, 512 << 20, 10_000
#: Texts that a task is handed at once while shards are written; a few hundred long ones are some MB.
BATCH_ROWS = "500"


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    """The place of a public tokenizer file, on the executor that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """ids(texts): the ids of each whole text, exactly as the tokenizer gives them.

    Only for tokenizers that drop white space and fold case before the model, as
    word_bpe_49k.json does: words are keyed in lower case (ASCII only, which the
    tokenizer's own folding subsumes). Marks after a final ASCII letter are a
    piece of their own, so stem and marks are kept apart. A text with a special
    token's opening "<|" goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        """known: the number of each piece; its ids are flat[starts[number]:][:sizes[number]]."""
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, "<u4"), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _raw(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces, joined, and how many each has. Pieces of letters end in an id that ends a word, so they are encoded as one text."""
        if all(map(str.isalpha, pieces)):
            ids = np.array(self._raw([" ".join(pieces)])[0], "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(pieces):
                return ids, np.diff(ends, prepend=0)
        found = self._raw(pieces)
        return np.fromiter(chain.from_iterable(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found))

    def _learn(self, pieces: list[str]) -> None:
        pieces.sort(key=str.isalpha)
        for start in range(0, len(pieces), 1000):
            some = pieces[start : start + 1000]
            ids, sizes = self._encoded(some)
            number, used = len(self.known), self.used + len(ids)
            if number + len(some) > len(self.sizes):
                self.sizes, self.starts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sizes, self.starts))
            while used > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : used] = ids
            self.sizes[number : number + len(some)] = sizes
            self.starts[number : number + len(some)] = self.used + np.cumsum(sizes) - sizes
            self.known.update(zip(some, range(number, number + len(some)), strict=True))
            self.used = used

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        coded = pc.dictionary_encode(pieces)
        distinct = coded.dictionary.to_pylist()
        found = list(map(self.known.get, distinct))
        if new := [w for w, x in zip(distinct, found, strict=True) if x is None]:
            self._learn(new)
            found = list(map(self.known.__getitem__, distinct))
        return np.array(found, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]

    def ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order; none for a null one. A few MB of text are worked on at a time."""
        texts = texts.cast(pa.large_string())
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(texts):
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + TEXT_BYTES)))
            yield from self._some_ids(texts.slice(start, end - start))
            start = end

    def _some_ids(self, texts: pa.Array) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self._forget()
        texts = pc.fill_null(texts, "")
        odd = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))
        whole = self._raw(texts.take(pa.array(odd)).to_pylist()) if len(odd) else []
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = pc.dictionary_encode(split.flatten())
        words = coded.dictionary
        marked = pc.extract_regex(words, MARKED)
        stems, marks = pc.coalesce(marked.field("stem"), words), pc.fill_null(marked.field("marks"), "")
        if marked.null_count:
            plain = pc.is_null(marked)
            stems, marks = pc.if_else(plain, words, stems), pc.if_else(plain, "", marks)
        stems, marks = self._numbers(stems), self._numbers(marks)
        # a text as the pieces of its words: a stem and its marks, mostly none, in turn
        at = coded.indices.to_numpy(zero_copy_only=False)
        sizes = self.sizes[stems] + self.sizes[marks]
        n = sizes[at]
        ends = np.cumsum(n)
        pair = np.stack([stems, marks], axis=1).ravel()
        of_word = spans(self.flat, self.starts[pair], self.sizes[pair])
        every = spans(of_word, (np.cumsum(sizes) - sizes)[at], n)
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy(zero_copy_only=False)]
        out = [every[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for i, raw in zip(odd, whole, strict=True):
            out[i] = np.array(raw, "<u4")
        return out


def spans(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[start : start + size] for each start and size, joined."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])] if len(ends) else flat[:0]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One for each Python worker, so that what it has learnt serves its later tasks."""
    return WordEncoder(path)


# --- minimal perfect hash -----------------------------------------------------


def mixed_hash(keys: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    """64-bit finaliser over integer keys."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * (np.asarray(seed, np.uint64) + np.uint64(1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build_mph(keys: np.ndarray, load: int = 4) -> np.ndarray:
    """A seed for each bucket of about `load` distinct keys such that slot_of() is a bijection onto range(len(keys)).

    Hash and displace: buckets, the fullest first, try seeds until their keys
    fall into free slots.
    """
    n = len(keys)
    seeds = np.zeros(max(1, -(-n // load)), np.uint32)
    bucket = (mixed_hash(keys, 0) % np.uint64(len(seeds))).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    starts = np.searchsorted(bucket[order], np.arange(len(seeds) + 1))
    taken = np.zeros(n, bool)
    tries = np.arange(1, 65, dtype=np.uint64)
    for b in np.argsort(-np.diff(starts), kind="stable"):
        own = keys[order[starts[b] : starts[b + 1]]]
        if not len(own):
            break
        base = 0
        while True:
            slots = (mixed_hash(own[None, :], (tries + np.uint64(base))[:, None]) % np.uint64(n)).astype(np.int64)
            ok = ~taken[slots].any(axis=1)
            if len(own) > 1:
                ordered = np.sort(slots, axis=1)
                ok &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if ok.any():
                k = int(ok.argmax())
                seeds[b] = int(tries[k]) + base
                taken[slots[k]] = True
                break
            base += len(tries)
    return seeds


def slot_of(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    bucket = (mixed_hash(keys, 0) % np.uint64(len(seeds))).astype(np.int64)
    return (mixed_hash(keys, seeds[bucket].astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mixed_hash(keys, 0xF1A6) >> np.uint64(32)).astype(np.uint32)


# --- shards -------------------------------------------------------------------

SHARD = "shard_id long, first_key long, last_key long, n_docs int, n_null int, n_ids long, ids binary, keys binary, ends binary, seeds binary, slots binary, fingerprints binary"


def rows_of(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_pylist(rows, pa.schema([(k, kinds[t]) for k, t in map(str.split, SHARD.split(", "))]))


def pack_shard(shard_id: int, keys: list[int | None], ids: list[np.ndarray]) -> dict:
    """A row of SHARD. keys are in order, null ones first; each distinct key has a slot, that of its first document."""
    n_null = sum(k is None for k in keys)
    known = np.array(keys[n_null:], "<i8")
    own, first = np.unique(known, return_index=True)
    seeds = build_mph(own)
    slots, marks = np.zeros(len(own), "<u4"), np.zeros(len(own), "<u4")
    if len(own):
        at = slot_of(own, seeds, len(own))
        slots[at], marks[at] = first + n_null, fingerprint(own)
    ends = np.cumsum([len(x) for x in ids]).astype("<i8")
    return {
        "shard_id": shard_id, "first_key": int(own[0]) if len(own) else None, "last_key": int(own[-1]) if len(own) else None,
        "n_docs": len(keys), "n_null": n_null, "n_ids": int(ends[-1]), "ids": np.concatenate(ids).astype("<u4").tobytes(),
        "keys": known.tobytes(), "ends": ends.tobytes(), "seeds": seeds.astype("<u4").tobytes(), "slots": slots.tobytes(),
        "fingerprints": marks.tobytes(),
    }


class Shard:
    """Reads one row of SHARD."""

    def __init__(self, row: dict):
        self.ids, self.keys, self.ends = (np.frombuffer(row[k], t) for k, t in (("ids", "<u4"), ("keys", "<i8"), ("ends", "<i8")))
        self.seeds, self.slots, self.marks = (np.frombuffer(row[k], "<u4") for k in ("seeds", "slots", "fingerprints"))
        self.n_null = int(row["n_null"])

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The documents' numbers in the shard, -1 for foreign keys: one hash and one probe a key; where the fingerprint agrees the key itself is compared."""
        if not len(self.slots):
            return np.full(len(keys), -1)
        at = slot_of(keys, self.seeds, len(self.slots))
        found = self.slots[at].astype(np.int64)
        return np.where((self.marks[at] == fingerprint(keys)) & (self.keys[found - self.n_null] == keys), found, -1)

    def span(self, number: int) -> tuple[int, int]:
        return (int(self.ends[number - 1]) if number else 0), int(self.ends[number])

    def get(self, key: int) -> np.ndarray | None:
        number = int(self.numbers(np.array([key], np.int64))[0])
        return None if number < 0 else self.ids[slice(*self.span(number))]


def token_shards(docs: DataFrame, path: str | None = None, end_id: int | None = 1, shard_bytes: int = SHARD_BYTES, partition_bytes: int | None = None) -> DataFrame:
    """Rows of SHARD over the documents in ascending doc_id order (null first), with end_id after each document.

    A null text gives the end id alone. A shard closes once its ids reach
    shard_bytes, so only a document longer than that makes a longer one. The
    texts are dealt by ranges of doc_id, of partition_bytes or as partitions_for tells. Rows that repeat a doc_id follow
    each other in the order of their texts' openings and may lie in several ranges, however many they are. shard_id ascends with the documents.
    Other columns are left out; an empty table gives no shards.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or public_tokenizer())
        tail = np.array([] if end_id is None else [end_id], "<u4")
        shard_id = (TaskContext.get().partitionId() << 32) - 1
        keys: list[int | None] = []
        ids: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for key, x in zip(batch.column("doc_id").to_pylist(), encode.ids(batch.column("text")), strict=True):
                keys.append(key)
                ids.append(np.concatenate([x, tail]))
                size += 4 * len(ids[-1])
                if size >= shard_bytes:
                    yield rows_of([pack_shard(shard_id := shard_id + 1, keys, ids)])
                    keys, ids, size = [], [], 0
        if keys:
            yield rows_of([pack_shard(shard_id + 1, keys, ids)])

    size = input_bytes(docs)
    parts = [] if size is None else [-(-size // partition_bytes) if partition_bytes else partitions_for(size)]
    # the last of them tells rows apart that are alike, so that ranges may split them
    order = ["doc_id", "opening", "row"]
    rows = docs.select("doc_id", "text", F.substring("text", 1, 16).alias("opening"), F.monotonically_increasing_id().alias("row"))
    return rows.repartitionByRange(*parts, *order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(build, SHARD)


def partitions_for(size: int) -> int:
    """Ranges for so many bytes: of LEAST_RANGE until there are MANY_RANGES, then of more, up to MOST_RANGE (200,000 of them at 100 TB)."""
    return max(1, -(-size // min(MOST_RANGE, max(LEAST_RANGE, size // MANY_RANGES))))


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of the plan's input as Spark estimates them from the files; None where it can't."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 56 else None


def write_shards(shards: DataFrame, folder: str) -> None:
    """Parquet with small row groups, as a shard is one row of some MB."""
    with session_settings(shards.sparkSession, spark_sql_execution_arrow_maxRecordsPerBatch=BATCH_ROWS, **SMALL_BATCHES):
        shards.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(folder)


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shards alone.

    A key's first document is found through the index, one that repeats a key
    or has none by its place. start counts the ids of all documents before: the
    ids of the shards before, which sums over one small row a shard give in two
    steps, and the place within the shard.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                shard = Shard(row)
                numbers = np.arange(row["n_docs"])
                again = np.r_[False, shard.keys[1:] == shard.keys[:-1]] if len(shard.keys) else np.zeros(0, bool)
                numbers[shard.n_null :][~again] = shard.numbers(shard.keys[~again])
                spans = [shard.span(int(k)) for k in numbers]
                yield pd.DataFrame({
                    "doc_id": pd.array([pd.NA] * shard.n_null + shard.keys.tolist(), "Int64"), "shard_id": row["shard_id"],
                    "in_shard": [a for a, _ in spans], "n_tokens": [b - a for a, b in spans],
                    "ids_crc32": [zlib.crc32(shard.ids[a:b].tobytes()) for a, b in spans],
                })

    sizes = shards.select("shard_id", "n_ids", F.shiftright("shard_id", 32).alias("part"))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("shard_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("shard_start", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts, "part")
    docs = shards.mapInPandas(read, "doc_id long, shard_id long, in_shard long, n_tokens long, ids_crc32 long")
    starts = starts.select("shard_id", (F.col("part_start") + F.col("shard_start")).alias("shard_start"))
    return docs.join(starts, "shard_id").select(
        "doc_id", (F.col("shard_start") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32"
    )


def fetch(shards: DataFrame, keys: list[int]) -> DataFrame:
    """key, ids of the documents with these keys, which the driver holds; no rows if there are none.

    The shards' key ranges, three small columns, tell which of them to read: no more than hold an asked key. Their
    ids are pushed down to the files, and in each the index gives a key's place in one probe. Of documents
    that share a key the first in a shard is given; keys that aren't there, and null ones, give no row.
    """
    asked = np.unique(np.array([k for k in keys if k is not None], np.int64))

    @F.pandas_udf("boolean")
    def holds(first: pd.Series, last: pd.Series) -> pd.Series:
        low, high = (x.fillna(y).to_numpy(np.int64) for x, y in ((first, 1), (last, 0)))
        return pd.Series(np.searchsorted(asked, high, "right") > np.searchsorted(asked, low, "left"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                shard = Shard(row)
                near = asked[(asked >= row["first_key"]) & (asked <= row["last_key"])]
                found = [(int(k), shard.ids[slice(*shard.span(int(i)))].tolist()) for k, i in zip(near, shard.numbers(near), strict=True) if i >= 0]
                yield pd.DataFrame(found, columns=["key", "ids"])

    near = shards.select("shard_id", "first_key", "last_key").where(holds("first_key", "last_key")).select("shard_id")
    wanted = [r[0] for r in near.collect()] if len(asked) else []  # of a key, the shards that its documents lie in
    return shards.where(F.col("shard_id").isin(wanted)).mapInPandas(read, "key long, ids array<long>")
