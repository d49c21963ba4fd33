"""Packing documents into sequences of bounded length by best-two-fit.

A bin is filled greedily: the longest piece that still fits, again and again.
Then its smallest piece is taken out if two unpacked pieces fill the widened gap
better than it did. Each task packs the pieces of its own split and keeps counts by length
rather than lists to search, so a step costs the sequence's length, not
the number of pieces. Bins that stay open, mostly a task's last ones, are taken apart and their pieces
(numbers only, no texts) packed once more in fewer tasks, until one task packs what is left. So the number
of sequences hardly depends on how the table is split.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweld.llm.common import SMALL_BATCHES, checkpointed, session_settings
from geoweld.llm.tokens import encoder, public_tokenizer

#: A bin with a gap of more than this part of its room is open.
OPEN_PART = 32
#: Pieces of open bins that a task packs again (5 MB), and the least part of their bins that another round must save.
REST_PIECES, LEAST_SAVED = 100_000, 0.001
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def best_two_fit(lengths: np.ndarray, room: int) -> list[list[int]]:
    """Bins of piece numbers; no bin is longer than room and every piece lies in one. A piece of length 0 goes to the first bin."""
    order = np.argsort(lengths, kind="stable")
    count = np.bincount(lengths, minlength=room + 1)
    ends = np.cumsum(count)
    count[0] = 0
    left, bins = int(count.sum()), []
    sizes: list[list[int]] = []

    def longest(upto: int) -> int:
        """The longest length of at most upto that is left; 0 if none."""
        found = np.flatnonzero(count[1 : upto + 1][::-1])
        return upto - int(found[0]) if len(found) else 0

    while left:
        gap, own = room, []
        while gap and (n := longest(gap)):
            take = min(int(count[n]), gap // n)
            own += [n] * take
            count[n] -= take
            gap -= take * n
        left -= len(own)
        if gap and len(own) > 0 and left >= 2:
            out = own[-1]
            pair = two_that_fit(count, out + gap, out)
            if pair:
                own[-1:] = pair
                for n in pair:
                    count[n] -= 1
                count[out] += 1
                left -= 1
        sizes.append(own)
    taken = np.zeros(room + 1, np.int64)
    starts = ends - np.bincount(lengths, minlength=room + 1)
    for own in sizes:
        members = []
        for n in own:
            members.append(int(order[starts[n] + taken[n]]))
            taken[n] += 1
        bins.append(members)
    empty = order[: ends[0]].tolist()
    if empty:
        bins[:1] = [empty + (bins[0] if bins else [])]
    return bins


def two_that_fit(count: np.ndarray, room: int, above: int) -> list[int] | None:
    """Two lengths that are left with the largest sum of at most room and more than above."""
    there = np.flatnonzero(count[: room + 1])
    there = there[there > 0]
    if not len(there):
        return None
    partner = there[np.maximum(np.searchsorted(there, room - there, side="right") - 1, 0)]
    sums = there + partner
    fits = (sums <= room) & (sums > above) & ((partner != there) | (count[there] >= 2))
    if not fits.any():
        return None
    k = int(np.where(fits, sums, -1).argmax())
    return sorted((int(there[k]), int(partner[k])), reverse=True)


def _placed(lengths: np.ndarray, room: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each piece's sequence (numbered from first) and offset, and whether the sequence is open."""
    sequence, offset, is_open = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), bool)
    for number, members in enumerate(best_two_fit(lengths, room)):
        sequence[members] = first + number
        ends = np.cumsum(lengths[members])
        offset[members] = ends - lengths[members]
        is_open[members] = OPEN_PART * (room - ends[-1]) > room
    return sequence, offset, is_open


def _first(turn: int) -> int:
    """The first sequence number of this task in a round."""
    return (turn << 56) + (TaskContext.get().partitionId() << 34)


def packed_documents(docs: DataFrame, room: int = 2048, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Every document's ids and end_id in pieces of at most room ids, with a sequence and a place in it for each piece.

    Rows: doc_id, piece (from 0), start (ids of the document before it), length,
    ids_crc32 (over little-endian uint32), sequence_id, offset. Only documents
    longer than room are cut, all pieces but the last being full. A null text counts
    as empty: its piece holds end_id. Rows that repeat are packed each time; a
    null doc_id stays null. sequence_id tells round and task, so numbers leave gaps. Other columns
    are left out; an empty table gives an empty result.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = encoder(path or public_tokenizer()), np.array([end_id], "<u4")
        keys, made = [], []
        for batch in batches:
            rows = []
            for i, x in enumerate(encode.ids(batch.column("text"))):
                raw = np.concatenate([x, tail]).tobytes()
                for piece, start in enumerate(range(0, len(raw) // 4, room)):
                    part = raw[4 * start : 4 * (start + room)]
                    rows.append((i, piece, start, len(part) // 4, zlib.crc32(part)))
            made.append(np.array(rows, np.int64).reshape(-1, 5))
            keys.append(batch.column("doc_id").cast(pa.int64()).take(pa.array(made[-1][:, 0])))
        if not made:
            return
        rows = np.concatenate(made)
        columns = [pa.concat_arrays(keys), pa.array(rows[:, 1], pa.int32()), *(pa.array(x) for x in (*rows[:, 2:].T, *_placed(rows[:, 3], room, _first(0))))]
        yield from pa.table(columns, names=names).to_batches(max_chunksize=1 << 16)

    def again(turn: int):
        def pack_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if some := list(batches):
                rows = pa.Table.from_batches(some)
                for name, x in zip(names[-3:], _placed(rows.column("length").to_numpy(), room, _first(turn)), strict=True):
                    rows = rows.set_column(names.index(name), name, pa.array(x))
                yield from rows.to_batches(max_chunksize=1 << 16)

        return pack_rest

    kind = f"{PACKED}, open boolean"
    names = [x.split()[0] for x in kind.split(", ")]
    with session_settings(docs.sparkSession, **SMALL_BATCHES):
        packed = checkpointed(docs.select("doc_id", "text").mapInArrow(pack, kind))
    done, turn, tasks = [], 0, packed.select(F.shiftright("sequence_id", 34)).distinct().count()
    while tasks > 1:
        pieces, bins = _rest(packed)
        done.append(packed.where("NOT open"))
        turn, tasks = turn + 1, min(-(-pieces // REST_PIECES), tasks // 2)
        packed = checkpointed(packed.where("open").repartition(max(1, tasks)).mapInArrow(again(turn), kind))
        if packed.select("sequence_id").distinct().count() > (1 - LEAST_SAVED) * bins:
            break
    done.append(packed)
    return reduce(DataFrame.union, done).drop("open")


def _rest(packed: DataFrame) -> tuple[int, int]:
    """Pieces and bins that are open."""
    open_ = packed.where("open")
    return open_.count(), open_.select("sequence_id").distinct().count()
