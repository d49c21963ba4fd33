"""What is left of shapes' sides once others are laid on them, by shares of the sides.

Each pair of shapes tells at which shares of the one's sides the other cuts them, and from where to where it covers them. What
pairs tell adds up, so a shape's neighbours needn't come together: a piece between two cuts stays where no pair covers it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from geoweld.functions.overlay import BLOCK, _in_parts, edges_of

#: A side's number in its shape, a share of its length, and by how many the shapes that cover the side get more there.
TURNS = "array<struct<side: int, share: double, turn: int>>"
PIECES = "array<struct<x1: double, y1: double, x2: double, y2: double>>"
#: Share of an edge's length within which a point lies on it.
ON = 1e-9


def _beside(begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row i with each of the size[i] places from begin[i] on, some at a time."""
    ends, at = np.cumsum(size), 0
    while at < len(size):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + BLOCK, "right")))
        own = np.arange(at, to)
        i = np.repeat(own, size[own])
        yield i, np.repeat(begin[own] - ends[own] + size[own] + before, size[own]) + np.arange(len(i))
        at = to


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]


def _cuts(own: np.ndarray, other: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Which edges of own those of other beside them cross, touch or end on, and at which share of their length."""
    d, e, w = own[:, 2:] - own[:, :2], other[:, 2:] - other[:, :2], other[:, :2] - own[:, :2]
    long = (d * d).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        across = _cross(d, e)
        t, u = _cross(w, e) / across, _cross(w, d) / across
        hit = np.flatnonzero((t > 0) & (t < 1) & (u >= -ON) & (u <= 1 + ON))
    yield hit, t[hit]
    for end in (w, other[:, 2:] - own[:, :2]):
        t = (end * d).sum(axis=1) / long
        hit = np.flatnonzero((np.abs(_cross(d, end)) <= ON * long) & (t > 0) & (t < 1))
        yield hit, t[hit]


def _covered(middle: np.ndarray, d: np.ndarray, begin: np.ndarray, size: np.ndarray, other: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray]:
    """Of pieces with a middle and a direction, whether their right side lies inside the rings of their edges of other, and whether one of those runs along them.

    A ray goes down or up from flat pieces, right or left from others; edges nearer than `near` are taken to be the piece itself.
    """
    odd, along = np.zeros(len(middle), np.int64), np.zeros(len(middle), bool)
    flat = np.abs(d[:, 0]) > np.abs(d[:, 1])
    forward = np.where(flat, d[:, 0] <= 0, d[:, 1] > 0)
    for k, j in _beside(begin, size):
        q, m, own, c = other[j], middle[k], d[k], flat[k].astype(int)
        r = np.arange(len(k))
        u, v, pu, pv, qu, qv = m[r, c], m[r, 1 - c], q[r, c], q[r, 1 - c], q[r, 2 + c], q[r, 3 - c]
        with np.errstate(divide="ignore", invalid="ignore"):
            at = pu + (v - pv) / (qv - pv) * (qu - pu)
        met = ((pv <= v) != (qv <= v)) & np.where(forward[k], at > u + near, at < u - near)
        np.add.at(odd, k[met], 1)
        e, w = q[:, 2:] - q[:, :2], m - q[:, :2]
        long, share = (e * e).sum(axis=1), (w * e).sum(axis=1)
        same = (np.abs(_cross(w, e)) <= ON * long) & (share > 0) & (share < long) & ((own * e).sum(axis=1) > 0)
        along[k[same & (np.abs(_cross(own, e)) <= ON * np.sqrt(long * (own * own).sum(axis=1)))]] = True
    return odd % 2 == 1, along


def _turns(a: pa.Array, b: pa.Array, first: pa.Array, near: float) -> pa.Array:
    n = len(a)
    (p, of), (q, of_other) = edges_of(a), edges_of(b)
    n_a, n_b = np.bincount(of, minlength=n), np.bincount(of_other, minlength=n)
    side, begin = np.arange(len(p)) - (np.cumsum(n_a) - n_a)[of], np.cumsum(n_b) - n_b
    low, high = np.full((n, 2), np.inf), np.full((n, 2), -np.inf)
    np.minimum.at(low, of_other, np.minimum(q[:, :2], q[:, 2:]))
    np.maximum.at(high, of_other, np.maximum(q[:, :2], q[:, 2:]))
    met = ((np.minimum(p[:, :2], p[:, 2:]) <= high[of]) & (np.maximum(p[:, :2], p[:, 2:]) >= low[of])).all(axis=1)
    p, of, side = p[met], of[met], side[met]
    rows, shares = [np.arange(len(p))] * 2, [np.zeros(len(p)), np.ones(len(p))]
    for i, j in _beside(begin[of], n_b[of]):
        for k, t in _cuts(p[i], q[j]):
            rows.append(i[k])
            shares.append(t)
    rows, shares = np.concatenate(rows), np.concatenate(shares)
    order = np.lexsort((shares, rows))
    rows, shares = rows[order], shares[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (shares[1:] != shares[:-1])
    rows, shares = rows[new], shares[new]
    at = np.flatnonzero(rows[1:] == rows[:-1])  # pieces, each from a cut to the next
    row, d = rows[at], p[:, 2:] - p[:, :2]
    middle = p[row, :2] + ((shares[at] + shares[at + 1]) / 2)[:, None] * d[row]
    inside, along = _covered(middle, d[row], begin[of[row]], n_b[of[row]], q, near)
    gone = at[inside | (along & first.to_numpy(zero_copy_only=False)[of[row]])]
    turn = np.zeros(len(rows), np.int32)
    turn[gone] += 1
    turn[gone + 1] -= 1
    told = (turn != 0) | ((shares > 0) & (shares < 1))
    rows, shares, turn = rows[told], shares[told], turn[told]
    found = pa.StructArray.from_arrays([pa.array(side[rows].astype(np.int32)), pa.array(shares), pa.array(turn)], ["side", "share", "turn"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of[rows], np.arange(n + 1)).astype(np.int32)), found)


def _pieces(parts: pa.Array, turns: pa.Array, digits: int) -> pa.Array:
    n = len(parts)
    p, of = edges_of(parts)
    size = np.bincount(of, minlength=n)
    begin = np.cumsum(size) - size
    rows, shares = [np.arange(len(p))] * 2, [np.zeros(len(p)), np.ones(len(p))]
    for i, j in _beside(begin[of], size[of]):  # a shape's own rings may touch
        i, j = i[i != j], j[i != j]
        for k, t in _cuts(p[i], p[j]):
            rows.append(i[k])
            shares.append(t)
    told = turns.flatten()
    field = lambda name: pc.struct_field(told, name).to_numpy(zero_copy_only=False)
    turn = np.concatenate([np.zeros(sum(map(len, rows)), np.int64), field("turn")])
    rows = np.concatenate([*rows, begin[pc.list_parent_indices(turns).to_numpy(zero_copy_only=False)] + field("side")])
    shares = np.concatenate([*shares, field("share")])
    order = np.lexsort((shares, rows))
    rows, shares, covered = rows[order], shares[order], np.cumsum(turn[order])
    own = p[rows]
    at = np.where((shares == 1)[:, None], own[:, 2:], own[:, :2] + shares[:, None] * (own[:, 2:] - own[:, :2]))
    at = np.where(np.abs(at) < 2.0**52 / 10.0**digits, np.round(at, digits), at)  # larger ones have no more digits
    left = np.flatnonzero((rows[1:] == rows[:-1]) & (covered[:-1] == 0) & (at[1:] != at[:-1]).any(axis=1))
    ends = [pa.array(v) for v in (*at[left].T, *at[left + 1].T)]
    offsets = np.searchsorted(of[rows[left]], np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(ends, ["x1", "y1", "x2", "y2"]))


def turns(own: str | Column, other: str | Column, first: Column, near: float) -> Column:
    """What a shape's sound rings tell of those of own: where they cut its sides and from where to where they cover them, as TURNS.

    A side is covered where its right, which is outside of own, lies inside other, and, if first, where one of other runs along it the same way.
    """

    @F.arrow_udf(TURNS)
    def made(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b, c in batches:
            yield _in_parts(lambda *some: _turns(*some, near), a, b, c)

    return made.asNondeterministic()(own, other, first)  # see overlay.measured


def pieces_left(parts: str | Column, told: str | Column, digits: int) -> Column:
    """The pieces of a shape's sides, cut at all shares told (TURNS) and where its own rings touch, that nothing covers; as PIECES, rounded to so many digits."""

    @F.arrow_udf(PIECES)
    def made(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for shapes, cuts in batches:
            yield _in_parts(lambda *some: _pieces(*some, digits), shapes, cuts)

    return made.asNondeterministic()(parts, told)  # see overlay.measured
