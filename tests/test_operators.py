import difflib
import math
import random

import pytest
from pyspark.sql import functions as F

from geoweld.functions import geometry as G
from geoweld.functions import text as S
from geoweld.operators import catalog, chains, lines, matching, poi, quality, relational, tiling
from geoweld.operators.grid_join import grid_join, points

BOX = "id long, minx double, miny double, maxx double, maxy double"
SEGMENT = "id long, x1 double, y1 double, x2 double, y2 double"


def boxes(spark, *rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, *r in rows], BOX)


def segments(spark, *rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, *r in rows], SEGMENT)


def ids(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


@pytest.mark.parametrize("cell", [3.0, 17.0, 1000.0])
def test_grid_join_does_not_depend_on_the_cell(spark, cell):
    rng = random.Random(1)
    made = lambda: [(i, x := rng.uniform(-50, 50), y := rng.uniform(-50, 50), x + rng.uniform(0, 9), y + rng.uniform(0, 9)) for i in range(60)]
    a, b = made(), made()
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] - 2 <= q[3] and q[1] <= p[3] + 2 and p[2] - 2 <= q[4] and q[2] <= p[4] + 2)
    got = grid_join(boxes(spark, *a), boxes(spark, *b), cell, 2.0).select("a_id", "b_id").collect()
    assert sorted(map(tuple, got)) == want


def test_grid_join_with_nulls_and_nothing(spark):
    some = spark.createDataFrame([(1, None, 0.0, 1.0, 1.0), (2, 0.0, 0.0, 1.0, 1.0)], BOX)
    assert grid_join(some, some, 5.0).count() == 1
    assert grid_join(some, some.limit(0), 5.0).count() == 0


def test_grid_join_of_boxes_of_all_sizes(spark):
    rng = random.Random(4)
    def made(n):
        out = []
        for i in range(n):
            x, y, w, h = rng.uniform(-900, 900), rng.uniform(-900, 900), 10 ** rng.uniform(-1, 5), 10 ** rng.uniform(-1, 5)
            out.append((i, x, y, x + w, y + h))
        return out
    a, b = made(40), [*made(40), (90, -1e9, -1e9, 1e9, 1e9)]
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] - 2 <= q[3] and q[1] <= p[3] + 2 and p[2] - 2 <= q[4] and q[2] <= p[4] + 2)
    odd = boxes(spark, (100, float("-inf"), 0, 1, 1), (101, float("nan"), 0, 1, 1))
    for cell in (0.5, 40.0):
        got = grid_join(boxes(spark, *a).union(odd), boxes(spark, *b), cell, 2.0).select("a_id", "b_id").collect()
        assert sorted(map(tuple, got)) == want


def test_building_match(spark):
    a = boxes(spark, (1, 0, 0, 10, 10), (2, 20, 20, 30, 30))
    b = boxes(spark, (1, 1, 1, 9, 9), (2, 40, 40, 50, 50))
    layer = matching.merged_layer(a, b, matching.two_pass_matches(matching.similar_boxes(a, b, 10.0), 0.3))
    assert sorted((r.src, r.id or 0, r.ref_id or 0) for r in layer.collect()) == [("base", 2, 0), ("matched", 1, 1), ("other", 0, 2)]


def test_water_ratio_is_of_the_base(spark):
    a, b = boxes(spark, (1, 0, 0, 10, 10)), boxes(spark, (1, 1, 1, 9, 9))
    assert matching.similar_boxes(a, b, 10.0, "base").first().similarity == pytest.approx(0.64)


def test_poi_greedy_prefers_the_nearer_pair(spark):
    schema = "id long, x double, y double"
    a, b = spark.createDataFrame([(1, 0.0, 0.0), (2, 8.0, 0.0)], schema), spark.createDataFrame([(1, 3.0, 0.0)], schema)
    pairs = grid_join(points(a), points(b), 10.0, 10.0).withColumn("dist", G.distance(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y")))
    taken = matching.greedy_one_to_one(pairs.where("dist <= 10").select("a_id", "b_id", "dist"), "dist")
    assert [tuple(r) for r in taken.collect()] == [(1, 1, 3.0)]


def test_greedy_finishes_long_chains(spark):
    # each pair is nearer than the one before, so the rule takes every other one from the end
    rows = [(i // 2 + i % 2, i // 2, 1000.0 - i) for i in range(1000)]
    want = sorted((a, b, d) for a, b, d in rows if (999 - int(1000 - d)) % 2 == 0)
    df = spark.createDataFrame(rows, "a_id long, b_id long, dist double").withColumn("group", F.lit("x"))
    for most in (5000, 400):
        got = matching.greedy_one_to_one(df.repartition(3), "dist", most_pairs=most) if most == 5000 else matching.greedy_one_to_one(df.where("dist > 960"), "dist", most_pairs=20)
        assert sorted((r.a_id, r.b_id, r.dist) for r in got.collect()) == ([x for x in want] if most == 5000 else greedy_by_hand([r for r in rows if r[2] > 960]))


def greedy_by_hand(rows):
    a, b, out = set(), set(), []
    for x, y, d in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        if x not in a and y not in b:
            a.add(x)
            b.add(y)
            out.append((x, y, d))
    return sorted(out)


def test_ranks_and_quantiles_without_one_task(spark):
    rng = random.Random(6)
    values = [rng.choice([None, *range(12)]) for _ in range(200)]
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "i long, v double").withColumn("part", F.lit(1))
    got = relational.with_row_numbers(df.repartition(5), ["i"], "n").collect()
    assert all(r.n == r.i + 1 and r.part == 1 for r in got) and len(got) == 200
    known = sorted(v for v in values if v is not None)
    for q in (0.0, 0.25, 0.5, 0.95, 1.0):
        at = q * (len(known) - 1)
        lo, hi = known[math.floor(at)], known[math.ceil(at)]
        assert relational.exact_quantile(df, "v", q).first().quantile == pytest.approx(lo + (hi - lo) * (at - math.floor(at)))
    assert relational.exact_quantile(df.limit(0), "v", 0.5).first().quantile is None
    n, total = len(known), sum(known)
    assert quality.gini(df, "v").first().gini == pytest.approx(2 * sum((i + 1) * v for i, v in enumerate(known)) / (n * total) - (n + 1) / n, abs=1e-6)


def test_upsert_keeps_other_columns_and_is_fixed(spark):
    rows = [(1, 5, "a"), (1, 5, "b"), (2, 1, "c")]
    now = spark.createDataFrame(rows, "id long, v long, new string")
    change = spark.createDataFrame([(1, 5, "d"), (1, 5, "e"), (3, 0, "f")], "id long, v long, new string")
    got = sorted(map(tuple, relational.upserted(now, change, "id", "v").collect()))
    assert [r[0] for r in got] == [1, 2, 3] and got[0][2] in "de"
    assert got == sorted(map(tuple, relational.upserted(now.repartition(3), change.repartition(2), "id", "v").collect()))


def test_greedy_equals_the_sequential_rule(spark):
    rng = random.Random(4)
    rows = sorted({(rng.randrange(12), rng.randrange(12)): float(rng.randrange(5)) for _ in range(60)}.items())
    free_a, free_b, want = set(range(12)), set(range(12)), []
    for d, a, b in sorted((d, a, b) for (a, b), d in rows):
        if a in free_a and b in free_b:
            want.append((a, b, d))
            free_a.discard(a)
            free_b.discard(b)
    df = spark.createDataFrame([(a, b, d) for (a, b), d in rows], "a_id long, b_id long, dist double")
    assert sorted(map(tuple, matching.greedy_one_to_one(df, "dist").collect())) == sorted(want)
    assert matching.greedy_one_to_one(df.limit(0), "dist").count() == 0


def test_priority_cascade(spark):
    first, second = boxes(spark, (1, 0, 0, 10, 10)), boxes(spark, (7, 1, 1, 9, 9), (8, 50, 50, 60, 60))
    fused = matching.priority_cascade([("a", first), ("b", second)], 10.0, 0.3)
    assert sorted((r.source, r.id) for r in fused.collect()) == [("a", 1), ("b", 8)]


def test_coverage_and_residual(spark):
    base, supplement = segments(spark, (1, 0, 0, 10, 0)), segments(spark, (5, 0, 0, 15, 0))
    assert lines.coverage(supplement, base, 10.0, 0.5).first().covered == pytest.approx(10.5 / 15)
    left = lines.residuals(supplement, base, 10.0, 0.5, 1.0).collect()
    assert [(r.id, r.part) for r in left] == [(5, 1)] and left[0].x1 == pytest.approx(10.5) and left[0].x2 == pytest.approx(15)


def test_coverage_against_sampling(spark):
    rng = random.Random(8)
    for _ in range(3):
        s, b = [rng.uniform(0, 20) for _ in range(4)], [[rng.uniform(0, 20) for _ in range(4)] for _ in range(4)]
        got = lines.coverage(segments(spark, (1, *s)), segments(spark, *((i, *x) for i, x in enumerate(b))), 20.0, 3.0).first().covered

        def near(px, py, x1, y1, x2, y2):
            dx, dy = x2 - x1, y2 - y1
            t = max(0, min(1, ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy)))
            return math.hypot(px - x1 - t * dx, py - y1 - t * dy) <= 3

        n = 20000
        at = ((s[0] + k / n * (s[2] - s[0]), s[1] + k / n * (s[3] - s[1])) for k in range(n + 1))
        assert got == pytest.approx(sum(any(near(*p, *x) for x in b) for p in at) / (n + 1), abs=1e-3)


def test_duplicates_snapping_and_turns(spark):
    base = segments(spark, (1, 0, 0, 10, 0))
    assert ids(lines.duplicate_supplements(segments(spark, (3, 0, 1, 10, 1), (4, 0, 40, 10, 40)), base, 10.0)) == [3]
    ends = {r.end: r for r in lines.snapped_endpoints(segments(spark, (3, 2, 5, 2, 90)), base, 10.0).collect()}
    assert (ends[1].x, ends[1].y, ends[1].snapped, ends[2].snapped) == (2.0, 0.0, True, False)
    made = spark.createDataFrame([(1, [(0.0, 0.0), (5.0, 0.0), (5.0, 5.0), (5.0, 9.0)])], "id long, points array<struct<x:double,y:double>>")
    assert [len(r.points) for r in lines.split_at_sharp_turns(made).orderBy("part").collect()] == [2, 3]


def test_suppression_in_order_and_chains(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "id long, other long")
    parts = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "id long, component long")
    assert ids(lines.suppressed_in_order(edges)) == [2]
    chain = spark.createDataFrame([(i, i + 1) for i in range(7)] + [(0, 6), (0, 1)], "id long, other long")
    assert ids(lines.suppressed_in_order(chain)) == [1, 3, 5, 6]
    assert lines.suppressed_in_order(chain.limit(0)).count() == 0
    made = spark.createDataFrame([(9, 0.0, 0.0, 1.0, 0.0), (9, 2.0, 0.0, 1.0, 0.0), (9, 7.0, 7.0, 8.0, 8.0)], "key long, x1 double, y1 double, x2 double, y2 double")
    assert sorted(len(r.points) for r in chains.merged_lines(made, ["key"]).collect()) == [2, 3]


def test_geohash(spark):
    row = spark.range(1).select(
        G.geohash(F.lit(-5.6), F.lit(42.6), 5).alias("h"), G.geohash_ring(F.lit(-5.6), F.lit(42.6), 5).alias("ring"), *(c.alias(k) for k, c in zip("xy", G.quadkey_tile(F.lit("213")), strict=True))
    ).first()
    assert row.h == "ezs42" and len(row.ring) == 9 and "ezs42" in row.ring and (row.x, row.y) == (3, 5)


def test_text_functions(spark):
    rows = [("Clinic",), ("",), (None,), ("  ",), ("NaN",)]
    df = spark.createDataFrame(rows, "name string")
    assert [r[0] for r in df.where(S.semantic_null(F.col("name")).isNotNull()).collect()] == ["Clinic"]
    one = spark.createDataFrame([("a|b, c", "Hôtel  de Ville", "School A", "school b")], "i string, t string, l string, r string")
    got = one.select(S.id_values(F.col("i")), S.folded(F.col("t")), S.name_score("l", "r")).first()
    assert got[0] == ["a|b, c", "a", "b", "c"] and got[1] == "hotel de ville"
    assert got[2] == difflib.SequenceMatcher(None, "school a", "school b").ratio()


def test_geohash_candidates_keep_zero_scores(spark):
    schema = "id long, name string, lon double, lat double"
    a, b = spark.createDataFrame([(1, "Clinic", 1.0, 1.0)], schema), spark.createDataFrame([(1, "Clinic", 1.0, 1.0), (2, None, 1.0, 1.0), (3, "Clonk", 1.0, 1.0)], schema)
    found = poi.geohash_candidates(a, b)
    assert sorted((r.b_id, r.score) for r in found.collect()) == [(1, 1.0), (2, 0.0)]
    assert [r.b_id for r in poi.matched_with_fallback(found, found.limit(0)).collect()] == [1]
    assert poi.matched_with_fallback(found.limit(0), found).count() == 1


def test_geohash_candidates_send_no_points_through_the_driver_and_score_once(spark):
    schema = "id long, name string, lon double, lat double"
    a = spark.createDataFrame([(1, "Clinic", 1.0, 1.0), (2, "School", 1.0, 1.0), (3, None, 1.00001, 1.0), (4, "Clinic", 5.0, 1.0)], schema)
    found = poi.geohash_candidates(a, a)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("ArrowEvalPython") == 1
    assert sorted(map(tuple, found.collect())) == [(1, 1, 1.0), (1, 3, 0.0), (2, 2, 1.0), (2, 3, 0.0), (3, 1, 0.0), (3, 2, 0.0), (3, 3, 0.0), (4, 4, 1.0)]


def test_topology_tiles_and_zones(spark):
    row = quality.line_topology(segments(spark, (1, 0, 0, 10, 0), (2, 10, 0, 20, 0), (3, 5, 5, 5, 5))).first()
    assert (row.zero_length, row.dangles) == (1, 2)
    tiles = tiling.partition_bbox(spark, (0.0, 0.0, 9.0, 4.0), 5.0, 1.0).collect()
    assert [t.tile_id for t in tiles] == ["tile_000_000", "tile_000_001"] and tiles[1].maxx == 9.0 and tiles[1].buffered.minx == 4.0
    assert tiling.tile_size_for(10, 10.0, 5000.0) == 1 and tiling.tile_size_for(10**6, 10**6, 5000.0) == 64
    pixels = spark.createDataFrame([(0.5, 0.5, 1.0), (1.5, 0.5, 3.0), (2.5, 0.5, 3.0), (0.5, 1.5, 0.0)], "x double, y double, value double")
    z = quality.zonal_statistics(boxes(spark, (1, 0, 0, 3, 2)), pixels, 2.0).first()
    assert (z.n, z.low, z.high, z.dominant) == (3, 1.0, 3.0, 3.0)


def test_catalog(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "source string, target string")
    assert catalog.transform_paths(e, "a", "d").first().path == ["a", "c", "d"]
    assert catalog.transform_paths(e, "a", "a").first().path == ["a"] and catalog.transform_paths(e, "d", "a").count() == 0
    goal = spark.createDataFrame([("d",)], "node string")
    assert {r.node: r.hops for r in catalog.upstream(e, goal).collect()} == {"d": 0, "c": 1, "b": 2, "a": 2}


def test_relational(spark):
    old, new = spark.createDataFrame([(1, 1, "x")], "k long, v long, s string"), spark.createDataFrame([(1, 1, "y"), (2, 0, "z")], "k long, v long, s string")
    assert sorted(map(tuple, relational.upserted(old, new, "k", "v").collect())) == [(1, 1, "y"), (2, 0, "z")]
    raw = spark.createDataFrame([("7",), (None,), ("x",)], "raw string")
    assert sorted(r.id for r in relational.with_minted_ids(raw, "raw", ["raw"]).collect()) == [7, 8, 9]
    got = relational.normalized_columns(spark.createDataFrame([(" ", "B")], "a string, b string"), {"name": ["a", "b"], "none": ["q"]}).first()
    assert (got["name"], got["none"]) == ("B", None)


def test_classes_of_relations_find_their_pairs_once(spark):
    from geoweld.operators.matching import relation_class

    sides = [(1, 10), (1, 11), (2, 12), (3, 13), (4, 13), (5, 14), (5, 15), (6, 15), (2, 12)]
    pairs = spark.createDataFrame([(a, [b]) for a, b in sides], "a_id long, bs array<long>").selectExpr("a_id", "explode(bs) AS b_id")
    made = relation_class(pairs)
    assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.a_id, r.b_id, r.relation) for r in made.collect())
    assert got == [(1, 10, "1:N"), (1, 11, "1:N"), (2, 12, "1:1"), (2, 12, "1:1"), (3, 13, "N:1"), (4, 13, "N:1"), (5, 14, "1:N"), (5, 15, "M:N"), (6, 15, "N:1")]


def test_joins_by_corners_equal_all_pairs_and_copy_less(spark):
    from geoweld.operators.assignment import labelled_pairs
    from geoweld.operators.grid_join import corner_join
    from geoweld.operators.line_cleanup import near_pairs
    from geoweld.operators.lines import line_candidates

    rng = random.Random(3)
    boxes = lambda: [(i, x := rng.uniform(-50, 50), y := rng.uniform(-50, 50), x + rng.uniform(0, 30), y + rng.uniform(0, 30)) for i in range(120)]
    a, b = boxes(), [*boxes(), (120, 0.0, 0.0, float("inf"), 1.0), (121, None, 0.0, 1.0, 1.0)]
    kind = "id long, minx double, miny double, maxx double, maxy double"
    made = corner_join(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), 9.0, 8.0)
    assert made.columns == [f"{k}_{c}" for k in "ab" for c in ("id", "minx", "miny", "maxx", "maxy")]
    want = {(p[0], q[0]) for p in a for q in b if None not in q and all(abs(u - v) <= 8 for u, v in zip(p[1:], q[1:], strict=True))}
    got = made.collect()
    assert {(r.a_id, r.b_id) for r in got} == want and len(got) == len(want) > 10
    assert {tuple(r[:5]) for r in got} <= set(a) and {tuple(r[5:]) for r in got} <= set(b)
    ends = "id long, x1 double, y1 double, x2 double, y2 double, name string"
    s, t = (spark.createDataFrame([(*r, "x") for r in rows[:120]], ends) for rows in (a, b))
    # directions are worked out for each line before they meet, and what isn't looked at isn't kept
    for df in (line_candidates(s, t, 40.0), labelled_pairs(s, t, 40.0)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "ATAN2" in plan and "ATAN2" not in plan[: plan.index("Join Inner")]
    assert near_pairs(s, t, 40.0).columns == [f"{k}_{c}" for k in "ab" for c in ("id", "x1", "y1", "x2", "y2")]
