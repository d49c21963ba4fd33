"""Overlay, repair, dissolving and chains of made shapes against rasters and plain walks."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoweld.functions import overlay as O
from geoweld.operators import chains as C
from geoweld.operators import shapes as S

SHAPE = "id long, parts array<array<struct<x:double,y:double>>>"
LINES = "key long, x1 double, y1 double, x2 double, y2 double"


def arrow(shapes):
    return pa.array([None if s is None else [[{"x": float(x), "y": float(y)} for x, y in r] for r in s] for s in shapes], O.ARROW_PARTS)


def layer(spark, *shapes):
    return spark.createDataFrame([(i, None if s is None else [[(float(x), float(y)) for x, y in r] for r in s]) for i, s in enumerate(shapes)], SHAPE)


def rect(x1, y1, x2, y2, back=False):
    ring = [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]
    return ring[::-1] if back else ring


def raster(rings, n=26):
    """Which unit cells' middles are inside an odd number of times."""
    grid = np.zeros((n, n), bool)
    for ring in rings:
        for i in range(n):
            for j in range(n):
                x, y = i + 0.5, j + 0.5
                for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
                    if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                        grid[i, j] ^= True
    return grid


def made(rng):
    out = []
    for _ in range(rng.randrange(4)):
        x, y, w, h = rng.randrange(16), rng.randrange(16), rng.randrange(1, 8), rng.randrange(1, 8)
        ell = [(x, y), (x + w + 1, y), (x + w + 1, y + 1), (x + 1, y + 1), (x + 1, y + h + 1), (x, y + h + 1)]
        out.append(ell[:: rng.choice([1, -1])] if rng.random() < 0.4 else rect(x, y, x + w, y + h, rng.random() < 0.5))
    return out


@pytest.mark.parametrize("operation", ["intersection", "union", "difference", "symmetric"])
def test_overlay_of_rings_that_meet_in_every_way(operation):
    rng, n = random.Random(operation), 120
    a, b = [made(rng) for _ in range(n)], [made(rng) for _ in range(n)]
    edges, group = O.overlaid_edges(arrow(a), arrow(b), operation)
    area, rings = O.areas(edges, group, n), O.rings_by_group(edges, group, n)
    for i in range(n):
        want = O.OPERATIONS[operation](raster(a[i]), raster(b[i]))
        assert area[i] == pytest.approx(want.sum()) and (raster(rings[i]) == want).all()


def test_areas_of_crooked_shapes_add_up():
    rng = random.Random(5)
    crooked = lambda: [[(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(rng.randrange(3, 9))]]
    a, b = [crooked() for _ in range(60)], [crooked() for _ in range(60)]
    size = lambda x, y, op: O.areas(*O.overlaid_edges(arrow(x), arrow(y), op), 60)
    own = [O.areas(*O.regions(arrow(x)), 60) for x in (a, b)]
    both = size(a, b, "intersection")
    assert size(a, b, "union") + both == pytest.approx(own[0] + own[1]) and size(a, b, "difference") + both == pytest.approx(own[0])
    rings = O.rings_by_group(*O.overlaid_edges(arrow(a), arrow(b), "intersection"), 60)
    assert O.areas(*O.regions(arrow(rings)), 60) == pytest.approx(both) and all(O.sound(arrow(rings)) | (both < 1e-9))


def test_repair_and_soundness(spark):
    bow, spike = [[(0, 0), (2, 2), (2, 0), (0, 2)]], [[(0, 0), (4, 0), (4, 4), (2, 4), (2, 8), (2, 4), (0, 4)]]
    nested, twice = [rect(0, 0, 4, 4), rect(1, 1, 2, 2)], [rect(0, 0, 2, 2), rect(1, 1, 3, 3)]
    odd = [None, [], [[(0, 0), (1, 1)]], [[(0, 0), (1, 1), (2, 2)]], [rect(0, 0, float("inf"), 1)]]
    df = layer(spark, bow, spike, nested, twice, *odd)
    got = {r.id: r for r in S.repaired(df.withColumn("was", O.is_valid("parts"))).withColumn("area", O.shapes_area("parts")).withColumn("now", O.is_valid("parts")).collect()}
    assert {i: (r.was, r.now, r.area, len(r.parts)) for i, r in got.items()} == {0: (False, True, 2.0, 2), 1: (False, True, 16.0, 1), 2: (True, True, 15.0, 2), 3: (False, True, 6.0, 2)}
    assert S.repaired(layer(spark, twice), "nonzero").select(O.shapes_area("parts").alias("a")).first().a == 7.0


def test_rings_that_meet_at_their_least_point_stay_apart():
    tri = lambda *p: [(0, 0), *p]
    shapes = arrow([[tri((2, -2), (2, -1)), tri((2, 1), (2, 2))], []])
    made = O.parts_by_group(*O.regions(shapes), 2, empty=False)
    assert [p and [[(q["x"], q["y"]) for q in r] for r in p] for p in made.to_pylist()] == [[tri((2, -2), (2, -1)), tri((2, 1), (2, 2))], None]
    assert O.sound(made).tolist() == [True, False]


def test_rings_walked_at_once_equal_those_walked_one_by_one():
    rng = random.Random(13)
    crooked = [[[(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(rng.randrange(3, 12))] for _ in range(rng.randrange(3))] for _ in range(200)]
    edges, group = O.regions(arrow(crooked))
    open_ = np.array([(0.0, 0.0, 2.0, 0.0), (2.0, 0.0, 2.0, 2.0), (2.0, 2.0, 0.0, 1.0)])  # as rounding may leave them
    edges, group = np.concatenate([edges, open_]), np.r_[group, [200] * 3]
    assert O.rings_by_group(edges, group, 201) == [O.rings_of(edges[group == g]) for g in range(201)]
    assert O.rings_by_group(np.zeros((0, 4)), np.zeros(0, int), 2) == [[], []]


def test_repair_and_clipping_need_one_pass_of_python(spark):
    shapes = layer(spark, [[(0, 0), (2, 2), (2, 0), (0, 2)]], [rect(1, 1, 3, 3)]).repartition(3, "id")
    plans = [S.repaired_and_checked(shapes).select("id", "area", "sound", "repaired", F.size("parts")), S.clipped(shapes, shapes, 4.0, "size").select("id", "mask", "size")]
    for df in plans:
        assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(map(tuple, plans[0].collect())) == [(0, 2.0, False, True, 2), (1, 4.0, True, True, 1)]
    assert {(r.id, r["mask"]): r["size"] for r in plans[1].collect()} == pytest.approx({(0, 0): 2.0, (0, 1): 0.5, (1, 0): 0.5, (1, 1): 4.0})


def test_joins_and_clips_of_shapes(spark):
    a, b = layer(spark, [rect(0, 0, 6, 6), rect(2, 2, 4, 4)], None, [rect(50, 50, 51, 51)]), layer(spark, [rect(1, 1, 5, 5)], [rect(2, 2, 4, 4)], [rect(6, 0, 8, 6)])
    got = S.similar_shapes(a, b, 4.0).collect()
    assert [(r.a_id, r.b_id, r.shared, r.similarity) for r in got] == [(0, 0, 12.0, 0.75)]
    cut = S.clipped(a.withColumn("name", F.lit("x")), b, 4.0)
    assert cut.columns == ["id", "parts", "name", "mask"] and [(r.id, r["mask"], len(r.parts)) for r in cut.collect()] == [(0, 0, 2)]


def test_shared_areas_are_not_cut_and_not_worked_out_twice(spark, monkeypatch):
    rng = random.Random(11)
    some = lambda: [[(rng.randrange(9) + rng.random() * rng.randrange(2), rng.randrange(9)) for _ in range(rng.randrange(3, 8))] for _ in range(rng.randrange(3))]
    a, b = (pa.array([[[{"x": 1e3 + x, "y": 4e3 + y} for x, y in r] for r in some()] for _ in range(300)], O.ARROW_PARTS) for _ in range(2))
    want = {(k, fill): O.areas(*O.overlaid_edges(a, b, k, fill), 300) for k in O.OPERATIONS for fill in O.FILLS}
    monkeypatch.setattr(O, "BLOCK", 50)
    for fill in O.FILLS:
        (p, own), (q, other) = O.pieces_of(a, fill), O.pieces_of(b, fill)
        both = O.shared_areas(p, q)
        assert np.abs(both - want["intersection", fill]).max() < 1e-6 and np.abs(own + other - both - want["union", fill]).max() < 1e-6
    shapes = layer(spark, [rect(0, 0, 6, 6)], [rect(9, 9, 12, 12)])
    plan = S.similar_shapes(shapes, shapes, 4.0).select("a_id", "similarity")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 or plan.count("area(") == 1


def test_dissolved_layer_equals_its_raster(spark):
    rng = random.Random(3)
    shapes, grid = [], np.zeros((28, 28), bool)
    for _ in range(40):
        x, y, w, h = rng.randrange(18), rng.randrange(18), rng.randrange(2, 8), rng.randrange(2, 8)
        shapes.append([rect(x, y, x + w, y + h, rng.random() < 0.5)] + ([rect(x + 1, y + 1, x + w - 1, y + h - 1)] if min(w, h) > 3 else []))
        grid |= raster(shapes[-1], 28)
    boundary = S.dissolved_boundary(layer(spark, *shapes, None, shapes[0]), 5.0)
    found = S.dissolved_measures(boundary).first()
    wide = np.pad(grid, 1)
    assert found.area == grid.sum() and found.length == (wide[1:] != wide[:-1]).sum() + (wide[:, 1:] != wide[:, :-1]).sum()
    rings = [[(p.x, p.y) for p in r.points] for r in S.dissolved_rings(boundary).collect()]
    assert (raster(rings, 28) == grid).all()


def test_dissolving_by_key_with_slanted_sides(spark):
    tri = lambda x: [[(x, 0), (x + 4, 0), (x + 2, 3)]]
    df = layer(spark, tri(0), tri(2), tri(0), tri(1.3), [rect(10, 10, 11, 11)]).withColumn("k", F.when(F.col("id") < 2, "a").when(F.col("id") < 4, "b"))
    got = {r.k: r.area for r in S.dissolved_measures(S.dissolved_boundary(df, 3.0, ["k"]), ["k"]).collect()}
    union = lambda p, q: O.areas(*O.overlaid_edges(arrow([p]), arrow([q]), "union"), 1)[0]
    assert got == pytest.approx({"a": union(tri(0), tri(2)), "b": union(tri(0), tri(1.3)), None: 1.0})


def test_dissolving_tests_no_shape_against_its_own_sides(spark, monkeypatch):
    asked = []
    join = S.grid_join
    monkeypatch.setattr(S, "grid_join", lambda left, right, *args, **more: asked.append((left.columns, join(left, right, *args, **more))) or asked[-1][1])
    df = layer(spark, [rect(0, 0, 4, 4)], [rect(2, 2, 6, 6)], [rect(2, 2, 6, 6)], [rect(20, 20, 22, 22)]).withColumn("k", F.when(F.col("id") < 3, "a"))
    got = {r.k: (r.area, r.length) for r in S.dissolved_measures(S.dissolved_boundary(df, 4.0, ["k"]), ["k"]).collect()}
    assert got == {"a": (28.0, 24.0), None: (4.0, 8.0)}
    columns, near = asked[-1]
    assert not {"x1", "y1", "x2", "y2"} & set(columns)  # pieces go there by their middles alone
    # two squares lie on each other, so their sides are the first's and meet the second too; the last meets nothing
    assert near.where("a_own = b_id").count() == 0 and near.where("a_own = 3").count() == 0 and near.count() > 0
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Join [row of the grid" in plan or "HashJoin" in plan


def test_dissolving_moves_whole_shapes_once(spark, monkeypatch):
    asked, join = [], S.grid_join
    monkeypatch.setattr(S, "grid_join", lambda left, right, *args, **more: asked.append((left.columns, right.columns)) or join(left, right, *args, **more))
    rng, shapes, keys = random.Random(12), [], []
    for k in range(60):  # slanted, equal, nested and touching ones; the first's sides are taken again by others
        own = []
        for _ in range(rng.randrange(1, 7)):
            (x1, y1), (x2, y2), (x3, y3) = t = [(float(rng.randrange(9)), float(rng.randrange(9))) for _ in range(3)]
            turn = (x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)
            if turn:
                own.append([t if turn > 0 else t[::-1]])
        shapes += own + own[:1]
        keys += [k] * len(own + own[:1])
    df = layer(spark, *shapes).join(spark.createDataFrame(list(enumerate(keys)), "id long, k long"), "id")
    boundary = S.dissolved_boundary(df, 4.0, ["k"])
    got = {r.k: (r.area, r.length) for r in S.dissolved_measures(boundary, ["k"]).collect()}
    assert len(asked) == 1 and not {"x1", "y1"} & set(asked[0][0] + asked[0][1])
    for k in set(keys):
        edges, group = O.regions(arrow([[r for shape, of in zip(shapes, keys, strict=True) if of == k for r in shape]]), "nonzero")
        assert got.pop(k) == pytest.approx((O.areas(edges, group, 1)[0], np.hypot(edges[:, 2] - edges[:, 0], edges[:, 3] - edges[:, 1]).sum()), abs=1e-6)
    assert not got
    rings = S.dissolved_rings(boundary, ["k"]).groupBy("k").agg(F.sum(F.size("points")).alias("n"))
    assert rings.join(boundary.groupBy("k").count(), "k").where("n <> count").count() == 0


def test_what_pairs_tell_of_sides_adds_up(monkeypatch):
    from geoweld.functions import dissolving as D

    monkeypatch.setattr(D, "BLOCK", 7)
    low, over, along = [rect(0, 0, 8, 4)], [rect(2, -2, 4, 1)], [rect(6, 0, 8, 9)]
    told = D._turns(arrow([low, low, low, low]), arrow([over, along, along, [rect(20, 0, 21, 1)]]), pa.array([False, False, True, True]), 1e-7).to_pylist()
    side = lambda turns: sorted((t["side"], t["share"], t["turn"]) for t in turns)
    assert (0, 0.25, 1) in side(told[0]) and (0, 0.5, -1) in side(told[0]) and told[3] == []
    # the side of a shape of a lesser id takes a shared one's place, but not that of a greater id
    assert [sum(t["turn"] > 0 for t in x) for x in told[1:3]] == [1, 3]
    shapes, cuts = arrow([low, None, low]), pa.array([told[0] + told[1], [], told[3]], D._turns(arrow([low]), arrow([over]), pa.array([False]), 1e-7).type)
    left = D._pieces(shapes, cuts, 9).to_pylist()
    assert sum(abs(p["x2"] - p["x1"]) + abs(p["y2"] - p["y1"]) for p in left[0]) == 24 - 2 - 2 and left[1] in (None, []) and len(left[2]) == 4


def test_chains(spark):
    rows = [(1, 0, 0, 1, 0), (1, 2, 0, 1, 0), (1, 2, 0, 3, 1), (1, 2, 0, 3, -1), (2, 0, 0, 1, 0), (2, 1, 1, 1, 0), (2, 1, 1, 0, 0), (3, 5, 5, 5, 5), (4, 1, 1, 2, 2), (4, 1, 1, 2, 2), (None, 1, 1, 2, 2)]
    df = spark.createDataFrame([(k, *map(float, r)) for k, *r in rows], LINES)
    got = {(r.key, r.part): [(p.x, p.y) for p in r.points] for r in C.merged_lines(df, ["key"]).collect()}
    assert got == {
        (1, 0): [(0, 0), (1, 0), (2, 0)], (1, 1): [(2, 0), (3, -1)], (1, 2): [(2, 0), (3, 1)], (2, 0): [(0, 0), (1, 0), (1, 1), (0, 0)],
        (4, 0): [(1, 1), (2, 2), (1, 1)], (None, 0): [(1, 1), (2, 2)],
    }
    assert C.chains(df.limit(0), ["key"]).count() == 0


def test_a_long_chain_and_a_long_ring(spark):
    rng, n = random.Random(8), 3000
    ring = [(np.cos(t), np.sin(t)) for t in np.linspace(0, 6.2, n)]
    steps = [(7, i, 0, i + 1, 0) for i in range(n)] + [(8, *p, *q) for p, q in zip(ring, ring[1:] + ring[:1], strict=True)]
    rng.shuffle(steps)
    df = spark.createDataFrame([(k, *map(float, r if rng.random() < 0.5 else (*r[2:], *r[:2]))) for k, *r in steps], LINES).repartition(4)
    made = C.chains(df, ["key"]).groupBy("key").agg(F.count_distinct("chain").alias("chains"), F.count("*").alias("n"), F.min("place").alias("low"), F.max("place").alias("high"))
    assert sorted(map(tuple, made.collect())) == [(7, 1, n, 0, n - 1), (8, 1, n, 0, n - 1)]
    line = C.chains(df.where("key = 7"), ["key"])
    assert line.where("x1 <> place OR x2 <> place + 1").count() == 0
