"""Lines of several vertices: matches, labels and residuals by hand, measures on odd lines."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geoweld.functions.polygons import line_length
from geoweld.operators import polylines as L

LINE = "id long, points array<struct<x:double,y:double>>"


def lines(spark, *rows):
    return spark.createDataFrame([(i, None if p is None else [(float(x), float(y)) for x, y in p]) for i, p in rows], LINE)


def to_segment(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
    return math.dist(p, (a[0] + t * dx, a[1] + t * dy))


def to_line(p, line):
    return min(to_segment(p, a, b) for a, b in zip(line, line[1:], strict=False))


def test_coverage_and_distances_equal_samples(spark):
    rng = random.Random(6)
    walk = lambda: [(x := 0, 0)] + [(x := x + rng.uniform(1, 9), rng.uniform(-6, 6)) for _ in range(rng.randrange(1, 6))]
    a, b = [(i, walk()) for i in range(12)], [(i, walk()) for i in range(12)]
    pairs = spark.createDataFrame([(i, i) for i in range(12)], "a_id long, b_id long")
    from geoweld.operators.lines import union_length

    got = {r.a_id: r.c for r in L.covered_parts(pairs, lines(spark, *a), lines(spark, *b), 3.0).select("a_id", union_length(F.col("parts")).alias("c")).collect()}
    both = lines(spark, *a).join(lines(spark, *b).withColumnRenamed("points", "q"), "id").select("id", L.line_hausdorff(F.col("points"), F.col("q")).alias("h"), L.vertex_hausdorff(F.col("points"), F.col("q")).alias("v"))
    far = {r.id: (r.h, r.v) for r in both.collect()}
    for (i, p), (_, q) in zip(a, b, strict=True):
        long = [math.dist(u, v) for u, v in zip(p, p[1:], strict=False)]
        hits, n = 0.0, 400
        for (u, v), d in zip(zip(p, p[1:], strict=False), long, strict=True):
            hits += d * sum(to_line((u[0] + (k + 0.5) / n * (v[0] - u[0]), u[1] + (k + 0.5) / n * (v[1] - u[1])), q) <= 3 for k in range(n)) / n
        assert got[i] == pytest.approx(hits / sum(long), abs=0.01)
        assert far[i][0] == pytest.approx(max(max(to_line(v, q) for v in p), max(to_line(v, p) for v in q)))
        one = lambda s, t: max(min(math.dist(u, v) for v in t) for u in s)
        assert far[i][1] == pytest.approx(max(one(p, q), one(q, p)))


def test_coverage_decides_and_distance_labels(spark):
    base = lines(spark, (1, [(0, 0), (50, 0), (100, 0)]), (2, None), (3, [(7, 7)]))
    other = lines(spark, (10, [(0, 1), (60, 2), (100, 1)]), (11, [(20, 3), (60, 3), (70, 4)]), (12, [(60, 2), (95, 2), (160, 2)]), (13, [(0, 40), (100, 40)]), (14, [(0, 1), (80, 1), (115, 30)]), (15, None))
    got = {(r.role, r.id, r.part): r for r in L.fused_lines(base, other, 30.0, 5.0, hausdorff=4.0, least=0.6).collect()}
    assert (got["base", 1, 0].label1, got["base", 1, 0].label2) == ("10", "11,14")
    assert {k for k in got if k[0] == "supplement"} == {("supplement", i, 0) for i in (12, 13, 15)}
    assert {k for k in got if k[0] == "residual"} == {("residual", 14, 1)}
    tail = [(p.x, p.y) for p in got["residual", 14, 1].points]
    assert tail[-1] == (115, 30) and tail[0][1] == pytest.approx(5.0, abs=1.0) and len(tail) == 2


def test_pieces_by_length(spark):
    df = lines(spark, (1, [(0, 0), (10, 0), (10, 13)]), (2, [(0, 0), (5, 0)]), (3, [(1, 1)]), (4, None), (5, [(0, 0), (0, 0)]))
    got = [(r.id, r.part, [(p.x, p.y) for p in r.points]) for r in L.split_by_length(df, 7.0).orderBy("id", "part").collect()]
    assert got == [(1, 0, [(0, 0), (7, 0)]), (1, 1, [(7, 0), (10, 0), (10, 4)]), (1, 2, [(10, 4), (10, 11)]), (1, 3, [(10, 11), (10, 13)]), (2, 0, [(0, 0), (5, 0)])]
    assert [r.part for r in L.split_by_length(df, 7.0, 2.0).where("id = 1").orderBy("part").collect()] == [0, 1, 2]
    total = L.split_by_length(df, 7.0).where("id = 1").agg(F.sum(line_length(F.col("points"))).alias("t")).first().t
    assert total == pytest.approx(23.0)


def test_only_pairs_with_like_boxes_are_looked_at(spark, monkeypatch):
    rng = random.Random(9)
    walk = lambda: [(x := rng.uniform(0, 60), y := rng.uniform(0, 60))] + [(x := x + rng.uniform(1, 9), y := y + rng.uniform(-3, 3)) for _ in range(rng.randrange(0, 6))]
    a, b = [(i, walk()) for i in range(80)] + [(80, None)], [(i, walk()) for i in range(80)]
    one = lambda s, t: max(min(math.dist(u, v) for v in t) for u in s)
    looked, inner = [], L.vertex_hausdorff
    monkeypatch.setattr(L, "vertex_hausdorff", lambda p, q: looked.append(True) or inner(p, q))
    got = {(r.a_id, r.b_id): r.hausdorff for r in L.lines_within(lines(spark, *a), lines(spark, *b), 30.0, 12.0, 12.0, 180.0, 0.0).collect()}
    want = {(i, j): max(one(p, q), one(q, p)) for i, p in a for j, q in b if p and min(len(p), len(q)) > 1 and max(one(p, q), one(q, p)) <= 12}
    assert looked and got == pytest.approx(want) and len(want) > 20


def test_matches_equal_all_pairs_and_lines_are_measured_once(spark, monkeypatch):
    rng = random.Random(4)
    walk = lambda: [(x := rng.uniform(0, 40), y := rng.uniform(0, 8))] + [(x := x + rng.uniform(4, 9), y := y + rng.uniform(-3, 3)) for _ in range(rng.randrange(1, 6))]
    a, b = [(i, walk()) for i in range(60)], [(i, walk()) for i in range(60)]
    from geoweld.operators.lines import union_length

    every = lines(spark, *a).select(F.col("id").alias("b_id")).crossJoin(lines(spark, *b).select(F.col("id").alias("a_id")))
    want = {(r.b_id, r.a_id): r.c for r in L.covered_parts(every, lines(spark, *b), lines(spark, *a), 5.0).select("a_id", "b_id", union_length(F.col("parts")).alias("c")).collect() if r.c >= 0.8}
    measured, inner = [], L.measured_lines
    monkeypatch.setattr(L, "measured_lines", lambda x: measured.append(1) or inner(x))
    got = L.matched_lines(lines(spark, *a), lines(spark, *b), 30.0, 5.0, 180.0, 0.0, 0.8, 4.0).collect()
    assert {(r.a_id, r.b_id): r.covered for r in got} == pytest.approx(want) and len(want) > 20 and len(measured) == 2
    p, q = dict(a), dict(b)
    far = lambda r: max(max(to_line(v, q[r.b_id]) for v in p[r.a_id]), max(to_line(v, p[r.a_id]) for v in q[r.b_id]))
    assert [r.hausdorff for r in got] == pytest.approx([far(r) for r in got]) and all(r.label == (1 if r.hausdorff <= 4 else 2) for r in got)


def test_distances_of_long_lines_by_blocks(spark, monkeypatch):
    import pyarrow as pa

    rng, kind = random.Random(2), pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    rows = [[[(rng.random(), rng.random()) for _ in range(rng.randrange(2, 30))] for _ in range(20)] for _ in range(2)]
    p, q = (pa.array([None, []] + [[{"x": x, "y": y} for x, y in r] for r in side], kind).slice(0) for side in rows)
    want = [max(to_line(v, t) for v in s) for s, t in zip(*rows, strict=True)]
    for most in (1, 7, 1 << 18):
        monkeypatch.setattr(L, "COMPARED", most)
        got = L._farthest(p, q)
        assert math.isnan(got[0]) and math.isnan(got[1]) and list(got[2:]) == pytest.approx(want) and list(L._farthest(p.slice(5), q.slice(5))) == pytest.approx(want[3:])
