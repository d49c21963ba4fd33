"""Overlay of shapes given as lists of rings, with concave parts, holes and several members.

A shape's inside is told by the rings' winding alone (odd, or other than zero), so
holes and members need no marks and rings may be drawn either way. All edges of the
shapes are cut where they meet; each piece then lies between two faces, whose
windings follow from a ray that starts at its middle. A piece stays if just one of its faces
belongs to the result, directed so that the inside is on its left. Areas are sums over such pieces;
rings come from walking them, turning left as far as possible at each node.

All shapes, or pairs of shapes, of an Arrow batch are worked on together: an edge has the number
of its group and meets the edges of that group only. Work grows with the square of a group's edges.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = "array<array<struct<x: double, y: double>>>"
ARROW_PARTS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
#: Coordinates are told apart to this share of the shapes' extent.
GRAIN = 1e-12
#: Points nearer than this share of the largest coordinate are one: an end that near to an edge lies on it, and edges aren't cut that near to their ends.
NEAR = 1e-10
#: Sine of the least angle at which edges cross.
STEEP = 1e-9
#: Edges times edges that are compared at once; their figures fit a core's cache.
BLOCK = 1 << 16
#: Shapes, or pairs of them, that are worked on at once.
ROWS = 1 << 11

Rings = list[list[tuple[float, float]]]
#: Whether a face is inside the result, from whether it is inside either shape.
OPERATIONS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "intersection": np.logical_and,
    "union": np.logical_or,
    "difference": lambda a, b: a & ~b,
    "symmetric": np.logical_xor,
}
FILLS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"odd": lambda w: w % 2 != 0, "nonzero": lambda w: w != 0}


def edges_of(shapes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows x1, y1, x2, y2 of the shapes' edges and the shapes they belong to, closed where rings are open.

    Edges without length, points that aren't finite and rings of fewer than three points are left out.
    """
    rings = shapes.flatten()
    points = rings.flatten()
    of_ring = pc.list_parent_indices(rings).to_numpy(zero_copy_only=False)
    of_shape = pc.list_parent_indices(shapes).to_numpy(zero_copy_only=False)
    xy = np.stack([pc.struct_field(points, c).to_numpy(zero_copy_only=False).astype(float) for c in "xy"], axis=1)
    fine = np.isfinite(xy).all(axis=1)
    xy, of_ring = xy[fine], of_ring[fine]
    sizes = np.bincount(of_ring, minlength=len(rings))
    long = (sizes > 2)[of_ring]
    xy, of_ring = xy[long], of_ring[long]
    following = np.arange(1, len(xy) + 1)
    if len(xy):
        first = np.flatnonzero(np.r_[True, of_ring[1:] != of_ring[:-1]])
        following[np.r_[first[1:], len(xy)] - 1] = first
    edges = np.hstack([xy, xy[following]]) if len(xy) else np.zeros((0, 4))
    real = (edges[:, :2] != edges[:, 2:]).any(axis=1)
    return edges[real], of_shape[of_ring][real] if len(xy) else np.zeros(0, np.int64)


def _meetings(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of all pairs of one group, which lies together, some at a time."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[start, len(group)])
    begin, size = np.repeat(start, sizes), np.repeat(sizes, sizes)
    ends = np.cumsum(size)
    at = 0
    while at < len(group):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + BLOCK, "right")))
        own = np.arange(at, to)
        a = np.repeat(own, size[own])
        yield a, np.repeat(begin[own], size[own]) + np.arange(len(a)) - np.repeat(ends[own] - size[own] - before, size[own])
        at = to


def cut_edges(edges: np.ndarray, layer: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of the edges between the points at which any of their group meet, with coordinates told apart to GRAIN; their layers and groups. Groups lie together."""
    if not len(edges):
        return edges, layer, group
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    reach = np.repeat(np.maximum.reduceat(np.abs(edges).max(axis=1), first), np.diff(np.r_[first, len(group)]))
    near = NEAR * reach
    rows, shares, places = [np.arange(len(edges))] * 2, [np.zeros(len(edges)), np.ones(len(edges))], [edges[:, :2], edges[:, 2:]]
    low, high = (f(edges[:, :2], edges[:, 2:]).T for f in (np.minimum, np.maximum))
    low, high = low - near, high + near
    for a, b in _meetings(group):
        close = a != b  # most edges of a shape lie apart, which their boxes tell
        for c in (0, 1):
            close &= (low[c][a] <= high[c][b]) & (low[c][b] <= high[c][a])
        a, b = a[close], b[close]
        own, other = edges[a], edges[b]
        dx, dy = own[:, 2] - own[:, 0], own[:, 3] - own[:, 1]
        ex, ey = other[:, 2] - other[:, 0], other[:, 3] - other[:, 1]
        wx, wy = other[:, 0] - own[:, 0], other[:, 1] - own[:, 1]
        across, long = dx * ey - dy * ex, dx * dx + dy * dy
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (wx * ey - wy * ex) / across, (wx * dy - wy * dx) / across
            far = np.sqrt(ex * ex + ey * ey)
            s, v = near[a] / np.sqrt(long), near[a] / far
            steep = np.abs(across) > STEEP * np.sqrt(long) * far  # nearly parallel edges are cut by each other's ends alone
            hit = steep & (t > s) & (t < 1 - s) & (u > v) & (u < 1 - v)
        rows.append(a[hit])
        shares.append(t[hit])
        # a crossing is worked out along the first of both edges, so that it is the same point on either
        first = np.where((a < b)[:, None], edges[a], edges[b])[hit]
        places.append(first[:, :2] + np.where(a < b, t, u)[hit][:, None] * (first[:, 2:] - first[:, :2]))
        for k, (px, py) in ((0, (wx, wy)), (2, (other[:, 2] - own[:, 0], other[:, 3] - own[:, 1]))):  # ends of others that lie on an edge
            t = (px * dx + py * dy) / long
            hit = (np.abs(px * dy - py * dx) <= near[a] * np.sqrt(long)) & (t > s) & (t < 1 - s)
            rows.append(a[hit])
            shares.append(t[hit])
            places.append(other[hit, k : k + 2])
    rows, shares, at = np.concatenate(rows), np.concatenate(shares), np.concatenate(places)
    order = np.lexsort((shares, rows))
    rows, at = rows[order], at[order]
    step = 2.0 ** np.ceil(np.log2(np.maximum(GRAIN * reach[rows], 1e-300)))[:, None]
    at = np.round(at / step) * step
    same = rows[1:] == rows[:-1]
    pieces = np.hstack([at[:-1], at[1:]])[same]
    of = rows[:-1][same]
    real = (pieces[:, :2] != pieces[:, 2:]).any(axis=1)
    return pieces[real], layer[of][real], group[of][real]


def boundary(edges: np.ndarray, layer: np.ndarray, group: np.ndarray, inside: Callable[[np.ndarray], np.ndarray], layers: int) -> tuple[np.ndarray, np.ndarray]:
    """Directed pieces, and their groups, about the faces that `inside` admits, given rows of windings by layer."""
    order = np.argsort(group, kind="stable")
    pieces, layer, group = cut_edges(edges[order], layer[order], group[order])
    if not len(pieces):
        return pieces, group
    down = (pieces[:, 3] < pieces[:, 1]) | ((pieces[:, 3] == pieces[:, 1]) & (pieces[:, 2] < pieces[:, 0]))
    up = np.where(down[:, None], pieces[:, [2, 3, 0, 1]], pieces)  # upwards, or to the right
    order = np.lexsort((*up.T, group))
    up, group, layer, down = up[order], group[order], layer[order], down[order]
    new = np.r_[True, (up[1:] != up[:-1]).any(axis=1) | (group[1:] != group[:-1])]
    one, of_group = up[new], group[new]
    net = np.zeros((len(one), layers), np.int64)  # how often each layer goes up it
    np.add.at(net, (np.cumsum(new) - 1, layer), np.where(down, -1, 1))
    right = np.zeros((len(one), layers), np.int64)
    for a, b in _meetings(of_group):
        mx, my = (one[a, 0] + one[a, 2]) / 2, (one[a, 1] + one[a, 3]) / 2
        x1, y1, x2, y2 = one[b].T
        flat = one[a, 1] == one[a, 3]
        with np.errstate(divide="ignore", invalid="ignore"):
            # to the right along x; level pieces look down along y
            side = (y1 <= my) & (my < y2) & (x1 + (my - y1) / (y2 - y1) * (x2 - x1) > mx)
            under = (np.minimum(x1, x2) <= mx) & (mx < np.maximum(x1, x2)) & (y1 + (mx - x1) / (x2 - x1) * (y2 - y1) < my)
        met = np.flatnonzero(np.where(flat, under, side) & (a != b))
        # a ray to the right meets upward edges from their left, a ray down meets rightward ones from above, their left
        turn = np.where(flat[met] & (x2[met] <= x1[met]), -1, 1)
        np.add.at(right, a[met], turn[:, None] * net[b[met]])
    left = right + net
    a, b = inside(left), inside(right)
    return np.concatenate([one[a & ~b], one[b & ~a][:, [2, 3, 0, 1]]]), np.concatenate([of_group[a & ~b], of_group[b & ~a]])


def overlaid_edges(a: pa.Array, b: pa.Array, operation: str, fill: str = "odd") -> tuple[np.ndarray, np.ndarray]:
    """Boundary pieces of the overlay of each shape of a with that of b, and the pair they belong to."""
    rule, filled = OPERATIONS[operation], FILLS[fill]
    (first, g), (second, h) = edges_of(a), edges_of(b)
    layer = np.repeat([0, 1], [len(first), len(second)])
    return boundary(np.concatenate([first, second]), layer, np.concatenate([g, h]), lambda w: rule(filled(w[:, 0]), filled(w[:, 1])), 2)


def regions(shapes: pa.Array, fill: str = "odd") -> tuple[np.ndarray, np.ndarray]:
    """Boundary pieces of each shape, and the shape they belong to."""
    (edges, group), filled = edges_of(shapes), FILLS[fill]
    return boundary(edges, np.zeros(len(edges), np.int64), group, lambda w: filled(w[:, 0]), 1)


def areas(edges: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """The area that the directed pieces of each of n groups enclose, measured from a height of the group's own, so that far from the origin no digits are lost."""
    ground = np.zeros(n)
    ground[group] = edges[:, 1]
    return np.bincount(group, (edges[:, 0] - edges[:, 2]) * ((edges[:, 1] + edges[:, 3]) / 2 - ground[group]), n) if len(edges) else np.zeros(n)


def pieces_of(shapes: pa.Array, fill: str = "odd") -> tuple[pa.ListArray, np.ndarray]:
    """The boundary of each shape as flat numbers x1, y1, x2, y2 a piece, the inside on the left, and its area.

    Pieces that run straight up or down are left out: shared_areas looks at what lies below a piece.
    """
    edges, group = regions(shapes, fill)
    size = areas(edges, group, len(shapes))
    level = edges[:, 0] != edges[:, 2]
    edges, group = edges[level], group[level]
    order = np.argsort(group, kind="stable")
    offsets = np.searchsorted(group[order], np.arange(len(shapes) + 1)) * 4
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(edges[order].ravel())), size


def _flat(pieces: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces as rows, the first of each shape, and how many it has."""
    n = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False) // 4
    return pieces.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4), np.cumsum(n) - n, n


def shared_areas(a: pa.ListArray, b: pa.ListArray) -> np.ndarray:
    """The area that each shape of a shares with that of b, both as pieces_of gives them.

    A shape is the sum of what lies below its pieces, those to the left counting up and those to the right down; so what two shapes share is the sum,
    over pairs of their pieces, of what lies below both, and neither is cut. Where that is measured from
    cancels out, so it starts at a point of the pair's own.
    """
    (p, _, na), (q, begin, nb) = _flat(a), _flat(b)
    of = np.repeat(np.arange(len(na)), na)
    size, out = nb[of], np.zeros(len(na))
    ends = np.cumsum(size)
    at = 0
    while at < len(of):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + BLOCK, "right")))
        own = np.arange(at, to)
        i = np.repeat(own, size[own])
        j = np.repeat(begin[of[own]] - ends[own] + size[own] + before, size[own]) + np.arange(len(i))
        at = to
        ex1, ex2, fx1, fx2 = p[i, 0], p[i, 2], q[j, 0], q[j, 2]
        low = np.maximum(np.minimum(ex1, ex2), np.minimum(fx1, fx2))
        wide = np.minimum(np.maximum(ex1, ex2), np.maximum(fx1, fx2)) - low
        met = np.flatnonzero(wide > 0)
        if not len(met):
            continue
        i, j, low, wide = i[met], j[met], low[met], wide[met]
        (ex1, ey1, ex2, ey2), (fx1, fy1, fx2, fy2) = p[i].T, q[j].T
        ground = q[begin[of[i]], 1]
        ey1, ey2, fy1, fy2 = ey1 - ground, ey2 - ground, fy1 - ground, fy2 - ground
        up, vp = (ey2 - ey1) / (ex2 - ex1), (fy2 - fy1) / (fx2 - fx1)
        e, f = ey1 + (low - ex1) * up, fy1 + (low - fx1) * vp
        g, h = e + wide * up, f + wide * vp
        d, k = np.abs(e - f), np.abs(g - h)
        apart = np.where((e > f) == (g > h), d + k, (d * d + k * k) / np.maximum(d + k, 1e-300))
        below = wide * (e + f + g + h - apart) / 4
        out += np.bincount(of[i], np.where((ex1 > ex2) == (fx1 > fx2), below, -below), len(out))
    return out


def rings_of(edges: np.ndarray) -> Rings:
    """Rings of directed boundary pieces: outer ones turn left, holes right; each starts at its least point, and vertices on a straight side are left out."""
    out_of: dict[tuple, list[tuple]] = {}
    for x1, y1, x2, y2 in edges.tolist():
        out_of.setdefault((x1, y1), []).append((x2, y2))
    used, rings = set(), []
    for x1, y1, x2, y2 in sorted(edges.tolist()):
        p, q = (x1, y1), (x2, y2)
        if (p, q) in used:
            continue
        ring = []
        while (p, q) not in used:
            used.add((p, q))
            ring.append(p)
            back = math.atan2(p[1] - q[1], p[0] - q[0])
            turn = lambda r, q=q, back=back: (back - math.atan2(r[1] - q[1], r[0] - q[0])) % (2 * math.pi) or 2 * math.pi
            ahead = [r for r in out_of.get(q, ()) if (q, r) not in used]
            if not ahead:
                break
            p, q = q, min(ahead, key=turn)
        rings.append(_straightened(ring))
    return sorted(r for r in rings if len(r) > 2)


def _straightened(ring: list[tuple[float, float]]) -> list[tuple[float, float]]:
    n = len(ring)
    bends = []
    for i, (x, y) in enumerate(ring):
        (px, py), (qx, qy) = ring[i - 1], ring[(i + 1) % n]
        ax, ay, bx, by = x - px, y - py, qx - x, qy - y
        if abs(ax * by - ay * bx) > 1e-9 * (math.hypot(ax, ay) * math.hypot(bx, by)) or ax * bx + ay * by < 0:
            bends.append((x, y))
    if not bends:
        return []
    least = bends.index(min(bends))
    return bends[least:] + bends[:least]


def _numbers(*columns: np.ndarray) -> np.ndarray:
    """A number for each row, the same for rows that are alike, in the rows' order."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    numbers = np.empty(len(order), np.int64)
    numbers[order] = np.cumsum(new)
    return numbers


def _following(edges: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The place of the piece that follows each one, sorted by group and ends, as far to the left as possible; -1 where none leaves its end."""
    m = len(edges)
    node = _numbers(np.tile(group, 2), *np.concatenate([edges[:, :2], edges[:, 2:]]).T)
    leave = np.bincount(node[:m], minlength=2 * m)
    begin, ways = (np.cumsum(leave) - leave)[node[m:]], leave[node[m:]]
    after = np.where(ways > 0, begin, -1)
    many = np.flatnonzero(ways > 1)
    i = np.repeat(many, ways[many])
    j = np.repeat(begin[many], ways[many]) + np.arange(len(i)) - np.repeat(np.cumsum(ways[many]) - ways[many], ways[many])
    back = np.arctan2(edges[i, 1] - edges[i, 3], edges[i, 0] - edges[i, 2])
    turn = (back - np.arctan2(edges[j, 3] - edges[j, 1], edges[j, 2] - edges[j, 0])) % (2 * math.pi)
    order = np.lexsort((np.where(turn == 0, 2 * math.pi, turn), i))
    after[many] = j[order][np.flatnonzero(np.r_[True, i[order][1:] != i[order][:-1]])] if len(i) else j
    return after


def _places(after: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The first piece of each one's ring and its place from there, by pointer doubling; rings have `longest` pieces at most."""
    own = np.arange(len(after))
    first, to = own, after
    rounds = range(int(longest).bit_length())
    for _ in rounds:
        first, to = np.minimum(first, first[to]), to[to]
    steps = (first != own).astype(np.int64)
    to = np.where(steps > 0, after, own)
    for _ in rounds:
        steps, to = steps + steps[to], to[to]
    return first, np.where(first == own, 0, np.bincount(first, minlength=len(own))[first] - steps)


def ring_points(edges: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points of the rings of all groups' directed pieces, the sizes of the rings and their groups; rings as rings_of gives them, in order.

    Each piece is followed by one, so all rings are walked at once. Only groups in which some piece isn't
    followed by just one, as rounding may leave them, are walked a piece at a time.
    """
    order = np.lexsort((*edges.T[::-1], group))
    edges, group = edges[order], group[order]
    m = len(edges)
    after = _following(edges, group)
    wrong = (after < 0) | (np.bincount(after[after >= 0], minlength=m) != 1)
    odd = np.unique(group[wrong])
    plain = ~np.isin(group, odd)
    size = np.bincount(np.cumsum(np.r_[True, group[1:] != group[:-1]])) if m else np.zeros(1, int)
    ring, place = _places(np.where(plain, after, np.arange(m)), size.max())
    order = np.lexsort((place, ring))
    order = order[plain[order]]
    xy, ring, of = edges[order, :2], ring[order], group[order]
    # only bends stay
    new = np.flatnonzero(np.r_[True, ring[1:] != ring[:-1]]) if len(ring) else np.zeros(0, int)
    last = np.r_[new[1:], len(ring)] - 1 if len(ring) else new
    before, behind = np.arange(len(ring)) - 1, np.arange(len(ring)) + 1
    before[new], behind[last] = last, new
    a, b = xy - xy[before], xy[behind] - xy
    across, along = np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]), (a * b).sum(axis=1)
    bend = (across > 1e-9 * (np.hypot(*a.T) * np.hypot(*b.T))) | (along < 0)
    xy, ring, of = xy[bend], ring[bend], of[bend]
    ring = _numbers(ring)
    size = np.bincount(ring)
    long = size[ring] > 2
    xy, ring, of = xy[long], _numbers(ring[long]), of[long]
    size = np.bincount(ring)
    new = np.cumsum(size) - size
    # each starts at its least point
    least = np.lexsort((*xy.T[::-1], ring))[new] - new
    place = (np.arange(len(ring)) - new[ring] - least[ring]) % size[ring]
    order = np.lexsort((place, ring))
    xy, of = xy[order], of[new]
    for g in odd:
        found = rings_of(edges[group == g])
        xy = np.concatenate([xy, *(np.array(r).reshape(-1, 2) for r in found)])
        size, of = np.r_[size, [len(r) for r in found]].astype(np.int64), np.r_[of, np.full(len(found), g)]
    new = np.cumsum(size) - size
    order = np.lexsort((*(xy[new + k, c] for k in (2, 1, 0) for c in (1, 0)), of))
    moved = size[order]
    points = np.repeat(new[order] - (np.cumsum(moved) - moved), moved) + np.arange(len(xy))
    return xy[points], moved, of[order]


def parts_by_group(edges: np.ndarray, group: np.ndarray, n: int, empty: bool = True) -> pa.ListArray:
    """The rings of n groups as shapes; those of groups without any are empty, or null."""
    xy, size, of = ring_points(edges, group)
    offsets = lambda ends: pa.array(np.asarray(ends, np.int32))
    rings = pa.ListArray.from_arrays(offsets(np.r_[0, np.cumsum(size)]), pa.StructArray.from_arrays([pa.array(c) for c in (xy[:, 0].copy(), xy[:, 1].copy())], ["x", "y"]))
    ends = np.searchsorted(of, np.arange(n + 1))
    return pa.ListArray.from_arrays(offsets(ends), rings, ARROW_PARTS, mask=None if empty else pa.array(ends[1:] == ends[:-1]))


def rings_by_group(edges: np.ndarray, group: np.ndarray, n: int) -> list[Rings]:
    xy, size, of = ring_points(edges, group)
    rings, ends = [list(map(tuple, r.tolist())) for r in np.split(xy, np.cumsum(size)[:-1])], np.searchsorted(of, np.arange(n + 1))
    return [rings[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _by_parts(measure: Callable[..., np.ndarray], *columns: pa.Array) -> np.ndarray:
    """What measure says of the columns' rows, ROWS at a time, so that memory doesn't grow with batches."""
    n = len(columns[0])
    return np.concatenate([np.zeros(0), *(measure(*(c.slice(i, ROWS) for c in columns)) for i in range(0, n, ROWS))])


def _in_parts(made: Callable[..., pa.Array], *columns: pa.Array) -> pa.Array:
    """What made gives for the columns' rows, ROWS at a time."""
    return pa.concat_arrays([made(*(c.slice(i, ROWS) for c in columns)) for i in range(0, max(len(columns[0]), 1), ROWS)])


def shapes_area(parts: str | Column, fill: str = "odd") -> Column:
    """Area of a shape, however its rings cross; 0 for none."""

    @F.arrow_udf("double")
    def area(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for shapes in batches:
            yield pa.array(_by_parts(lambda some: areas(*regions(some, fill), len(some)), shapes))

    return area(parts)


def overlay_area(a: str | Column, b: str | Column, operation: str = "intersection", fill: str = "odd") -> Column:
    """Area of the overlay of two shapes; a null shape is empty."""

    def measured(left: pa.Array, right: pa.Array) -> np.ndarray:
        (p, own), (q, other) = pieces_of(left, fill), pieces_of(right, fill)
        both = shared_areas(p, q)
        return {"intersection": both, "union": own + other - both, "difference": own - both, "symmetric": own + other - 2 * both}[operation]

    @F.arrow_udf("double")
    def area(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            yield pa.array(_by_parts(measured, left, right))

    return area(a, b)


def measured(parts: str | Column, fill: str = "odd") -> Column:
    """A shape's area, and its boundary as pieces_of gives it."""

    @F.arrow_udf("struct<area: double, pieces: array<double>>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for shapes in batches:
            some = [pieces_of(shapes.slice(i, ROWS), fill) for i in range(0, len(shapes), ROWS)]
            pieces = pa.concat_arrays([pa.array([], pa.list_(pa.float64())), *(p for p, _ in some)])
            yield pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0), *(area for _, area in some)])), pieces], ["area", "pieces"])

    # told to be nondeterministic so that filters on it aren't pushed down, which would work it out twice
    return made.asNondeterministic()(parts)


def pieces_shared(a: str | Column, b: str | Column) -> Column:
    """Area that two shapes share, both as pieces_of gives them."""

    @F.arrow_udf("double")
    def area(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            yield pa.array(shared_areas(left, right))

    return area.asNondeterministic()(a, b)


def overlay(a: str | Column, b: str | Column, operation: str = "intersection", fill: str = "odd") -> Column:
    """The overlay of two shapes as rings, as overlaid gives them."""
    return overlaid(a, b, operation, fill)["parts"]


def overlaid(a: str | Column, b: str | Column, operation: str = "intersection", fill: str = "odd") -> Column:
    """The overlay of two shapes: parts, its rings, outer ones turning left and holes right, none where nothing is left, and area."""

    def cut(left: pa.Array, right: pa.Array) -> pa.Array:
        edges, group = overlaid_edges(left, right, operation, fill)
        return pa.StructArray.from_arrays([parts_by_group(edges, group, len(left)), pa.array(areas(edges, group, len(left)))], ["parts", "area"])

    @F.arrow_udf(f"struct<parts: {PARTS}, area: double>")
    def made(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            yield _in_parts(cut, left, right)

    return made.asNondeterministic()(a, b)  # see measured


def repaired(parts: str | Column, fill: str = "odd") -> Column:
    """The shape with rings that neither cross nor touch along a side: bow ties come apart, spikes go, holes turn right. Null where nothing with an area is left."""

    @F.arrow_udf(PARTS)
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for shapes in batches:
            yield _in_parts(lambda some: parts_by_group(*regions(some, fill), len(some), empty=False), shapes)

    return made.asNondeterministic()(parts)  # see measured


def repaired_and_checked(parts: str | Column, fill: str = "odd") -> Column:
    """parts as repaired gives them, their area, and whether they are sound (repaired) and the shape was (sound); in one pass, so that a task needs one worker."""

    def checked(some: pa.Array) -> pa.Array:
        made = parts_by_group(*regions(some, fill), len(some), empty=False)
        columns = {"parts": made, "area": pa.array(areas(*regions(made, fill), len(made))), "repaired": pa.array(sound(made)), "sound": pa.array(sound(some))}
        return pa.StructArray.from_arrays(list(columns.values()), list(columns))

    @F.arrow_udf(f"struct<parts: {PARTS}, area: double, repaired: boolean, sound: boolean>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for shapes in batches:
            yield _in_parts(checked, shapes)

    return made.asNondeterministic()(parts)  # see measured


def is_valid(parts: str | Column) -> Column:
    """Whether a shape has rings, each of three points or more without a repeated one, that neither cross themselves or each other nor share a side."""

    @F.arrow_udf("boolean")
    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for shapes in batches:
            yield pa.array(_by_parts(sound, shapes).astype(bool))

    return told(parts)


def sound(shapes: pa.Array) -> np.ndarray:
    edges, group = edges_of(shapes)
    n, good = len(shapes), np.bincount(group, minlength=len(shapes)) > 0
    rings = shapes.flatten()
    few = pc.less(pc.fill_null(pc.list_value_length(rings), 0), 3).to_numpy(zero_copy_only=False)
    good[pc.list_parent_indices(shapes).to_numpy(zero_copy_only=False)[few]] = False
    points = _numbers(_ring_numbers(shapes), *edges[:, :2].T)
    good[group[np.bincount(points)[points] > 1]] = False  # a ring comes back to a point
    pieces, _, of = cut_edges(edges, np.zeros(len(edges), np.int64), group)
    back = (pieces[:, 0] > pieces[:, 2]) | ((pieces[:, 0] == pieces[:, 2]) & (pieces[:, 1] > pieces[:, 3]))
    sides = _numbers(of, *np.where(back[:, None], pieces[:, [2, 3, 0, 1]], pieces).T)
    good[of[np.bincount(sides)[sides] > 1]] = False  # two sides lie on each other
    # a vertex may touch a side from within; a crossing cuts both sides at a point that is no vertex
    points = _numbers(np.r_[group, of], *np.concatenate([edges[:, :2], pieces[:, :2]]).T)
    known = np.zeros(len(points) + 1, bool)
    known[points[: len(edges)]] = True
    good[of[~known[points[len(edges) :]]]] = False
    return good[:n]


def _ring_numbers(shapes: pa.Array) -> np.ndarray:
    """The ring of each of the shapes' edges, as edges_of gives them."""
    rings = shapes.flatten()
    numbered = pa.ListArray.from_arrays(pa.array(np.arange(len(rings) + 1, dtype=np.int32)), rings)
    return edges_of(numbered)[1]
