"""Nearest neighbours, displacement, projection and intake against plain computations, over several batches."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from geoweld.functions import geometry as G
from geoweld.operators import line_cleanup, relational
from geoweld.operators import summaries as Y
from geoweld.operators.nearest import nearest_rows
from geoweld.streaming import events as E

BOX = "id long, minx double, miny double, maxx double, maxy double"


def test_nearest_rows_near_and_far(spark):
    rng = random.Random(2)
    place = lambda far: (rng.uniform(-far, far), rng.uniform(-far, far))
    boxes = [(i, x, y, x + rng.uniform(0, 3), y + rng.uniform(0, 3)) for i in range(400) for x, y in [place(30 if i % 3 else 900)]]
    asked = [(i, *place(50 if i % 2 else 1e5)) for i in range(60)]
    gap = lambda p, b: math.hypot(max(0, b[1] - p[1], p[1] - b[3]), max(0, b[2] - p[2], p[2] - b[4]))
    odd = [(900, None, 1.0, 2.0, 2.0), (901, float("nan"), 0.0, 1.0, 1.0)]
    points = spark.createDataFrame([*asked, (99, None, 1.0), (98, float("inf"), 0.0)], "id long, x double, y double")
    for k in (1, 5):
        got = nearest_rows(points, spark.createDataFrame(boxes + odd, BOX), 2.0, k).collect()
        want = {(p[0], r): (d, b) for p in asked for r, (d, b) in enumerate(sorted((gap(p, b), b[0]) for b in boxes)[:k], 1)}
        assert {(r.a_id, r.rank): r.b_id for r in got} == {key: b for key, (_, b) in want.items()} and len(got) == len(want)
        assert all(r.dist == pytest.approx(want[r.a_id, r.rank][0]) for r in got)
    assert nearest_rows(points, spark.createDataFrame(boxes[:2], BOX), 2.0, 5).count() == 120
    assert nearest_rows(points, spark.createDataFrame([], BOX), 2.0).count() == 0


def test_displaced_boxes_no_longer_overlap(spark):
    rng = random.Random(4)
    boxes = [(i, x := rng.randrange(120), y := rng.randrange(120), x + rng.randrange(2, 15), y + rng.randrange(2, 15)) for i in range(150)]
    boxes += [(200, 500, 500, 510, 510), (201, 500, 500, 510, 511), (202, 600, 600, 610, 610), (203, 608, 600, 618, 610)]
    df = spark.createDataFrame([(i, *map(float, b)) for i, *b in boxes], BOX)
    got = {r.id: r for r in Y.displaced_boxes(df, 20.0).collect()}
    assert 200 not in got and 201 in got and not got[201].moved  # covered by the larger one
    assert got[202].moved and got[202].minx == 597.0 and not got[203].moved
    kept = list(got.values())
    for i, a in enumerate(kept):
        for b in kept[:i]:
            assert max(0, min(a.maxx, b.maxx) - max(a.minx, b.minx)) * max(0, min(a.maxy, b.maxy) - max(a.miny, b.miny)) < 0.2
    size = {i: (c - a, d - b) for i, a, b, c, d in boxes}
    assert all((r.maxx - r.minx, r.maxy - r.miny) == pytest.approx(size[r.id]) for r in kept)


def test_transverse_mercator(spark):
    rows = [(lon, lat, zone) for zone in (1, 31, 32, 60) for lon in (zone * 6 - 186.0, zone * 6 - 183.0, zone * 6 - 180.5) for lat in (-80.0, -1.0, 0.0, 45.0, 83.5)]
    df = spark.createDataFrame(rows, "lon double, lat double, zone int").withColumn("south", F.col("lat") < 0)
    east, north = G.to_utm(F.col("lon"), F.col("lat"), F.col("zone"), F.col("south"))
    placed = df.withColumns({"e": east, "n": north})
    lon, lat = G.from_utm(F.col("e"), F.col("n"), F.col("zone"), F.col("south"))
    for r in placed.withColumns({"lon2": lon, "lat2": lat}).collect():
        assert r.lon2 == pytest.approx(r.lon, abs=1e-9) and r.lat2 == pytest.approx(r.lat, abs=1e-9)
        if r.lon == r.zone * 6 - 183:
            assert r.e == pytest.approx(500000)
            if r.lat == 45:
                assert r.n == pytest.approx(4984944.378 * 0.9996, abs=2e-3)  # length of the meridian
    one = spark.range(1).select(*G.box_to((F.lit(6.0), F.lit(40.0), F.lit(12.0), F.lit(50.0)), lambda x, y: G.to_utm(x, y, F.lit(32), F.lit(False)))).first()
    corners = spark.createDataFrame([(6.0, 50.0)], "x double, y double").select(G.to_utm(F.col("x"), F.col("y"), F.lit(32), F.lit(False))[1]).first()[0]
    assert one[3] == pytest.approx(corners) and one[1] < G_north(spark, 6.0, 40.0)  # the lower edge bulges down in the middle


def G_north(spark, lon, lat):
    return spark.range(1).select(G.to_utm(F.lit(lon), F.lit(lat), F.lit(32), F.lit(False))[1]).first()[0]


def test_intake_over_batches_and_again(spark, tmp_path):
    texts = [
        [{"k": 1, "v": "a"}, {"k": 1, "v": "b"}, "{broken", {"v": "no key"}, {"k": 3, "v": None}],
        [{"k": 1, "v": "late"}, {"k": 2, "v": "c"}, None, "[1]"],
        [{"k": 2, "v": "c"}, {"k": 4, "v": "d", "value": 7}],
    ]
    made = str(tmp_path / "in")
    for part in texts:
        rows = [(t if t is None or isinstance(t, str) else json.dumps(t),) for t in part]
        spark.createDataFrame(rows, "value string").coalesce(1).write.mode("append").parquet(made)
    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).parquet(made)
    run = lambda: E.intake(spark, stream, str(tmp_path / "out"), "k long, v string", "k", ["v"])
    show = lambda got: {n: sorted(map(str, df.drop("batch").collect())) for n, df in got.items()}
    got = run()
    first = show(got)
    assert sorted(r.k for r in got["taken"].collect()) == [1, 2, 4] and got["repeated"].count() == 3
    assert sorted(r.reason for r in got["refused"].collect()) == ["unreadable", "unreadable", "unreadable", "without k", "without v"]
    total = got["ledger"].agg(F.sum("taken"), F.sum("repeated"), F.sum("refused"), F.count("*")).first()
    assert tuple(total) == (3, 3, 5, 3)
    assert show(run()) == first  # nothing new, nothing twice


def test_exact_quantiles_by_key(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *map(float, range(9))])) for _ in range(200)] + [("only null", None), ("one", 5.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: (r.q0, r.q1) for r in relational.exact_quantiles(df, "v", (0.5, 0.95), ["k"]).collect()}
    for k in {k for k, v in rows if v is not None}:
        own = sorted(v for x, v in rows if x == k and v is not None)
        at = lambda s: (own[int(s * (len(own) - 1))], own[min(len(own) - 1, int(s * (len(own) - 1)) + 1)], s * (len(own) - 1) % 1)
        assert got[k] == pytest.approx(tuple(a + (b - a) * t for a, b, t in map(at, (0.5, 0.95))))
    assert set(got) == {k for k, v in rows if v is not None}
    assert relational.exact_quantiles(df.limit(0), "v", (0.5,)).first().q0 is None


def test_parts_beyond_ninety_nine_keep_their_line(spark):
    line = "id long, x1 double, y1 double, x2 double, y2 double"
    # a long supplement that a base line matches and that short base lines cover in a hundred and fifty places
    supplement = spark.createDataFrame([(7, 0.0, 0.0, 6000.0, 0.0)], line)
    base = spark.createDataFrame([(1, 0.0, 12.0, 6000.0, 12.0), *((10 + i, 40.0 * i, -2.0, 40.0 * i, 2.0) for i in range(150))], line)
    got = line_cleanup.conflated(base, supplement, 60.0).where("role <> 'base'").collect()
    assert {r.of for r in got} == {7} and {r.role for r in got} == {"residual"} and max(r.part for r in got) > 99


def test_tile_jobs_go_on_and_tell_lost_rows(spark, tmp_path):
    from geoweld.operators import tile_jobs as J
    from geoweld.operators.tiling import partition_bbox

    tiles, folder, schema = partition_bbox(spark, (0.0, 0.0, 40.0, 20.0), 10.0, 2.0), str(tmp_path / "job"), "tile_id string, id long, minx double, miny double, maxx double, maxy double"
    tried = []

    def build(some):
        ids = sorted(r.tile_id for r in some.collect())
        tried.append(ids)
        if len(tried) == 2:
            raise RuntimeError("broken off")
        b = F.col("buffered")
        return some.where("tile_id <> 'tile_001_003'").select("tile_id", F.lit(7).cast("long").alias("id"), b["minx"].alias("minx"), b["miny"].alias("miny"), b["maxx"].alias("maxx"), b["maxy"].alias("maxy"))

    with pytest.raises(RuntimeError):
        J.run_tiles(tiles, build, folder, 3)
    assert J.finished(spark, folder).count() == 3
    assert J.run_tiles(tiles, build, folder, 3) == 2 and J.run_tiles(tiles, build, folder, 3) == 0
    assert [len(x) for x in tried] == [3, 3, 3, 2] and tried[1] == tried[2]
    rows = J.tile_rows(spark, folder, schema)
    assert rows.count() == 7 and J.finished(spark, folder).count() == 8  # a tile without rows is done too
    whole = J.stitched(rows, tiles, "id")
    assert whole.count() == 1
    got = J.evidence(spark, folder, rows, whole).first()
    assert tuple(got) == (8, 3, 7, 7, 1)
    # rows of a batch that has no manifest don't count, rows that are missing do
    rows.limit(1).write.parquet(f"{folder}/rows/batch=orphan")
    assert J.tile_rows(spark, folder, schema).count() == 7
    spark.createDataFrame([("tile_009_009", 4, "gone")], J.MANIFEST).write.mode("append").parquet(f"{folder}/manifest")
    with pytest.raises(ValueError, match="tile_009_009"):
        J.tile_rows(spark, folder, schema)


def test_boxes_are_dealt_to_the_tiles_that_they_meet(spark):
    from geoweld.operators.tiling import dealt_to_tiles, partition_bbox

    rng = random.Random(2)
    corners = [(rng.uniform(-9, 60), rng.uniform(-9, 60)) for _ in range(200)] + [(7.3 * i, 7.3 * j) for i in range(7) for j in range(7)]
    boxes = spark.createDataFrame([(i, x, y, x + rng.choice((0, 1.5, 20)), y + rng.choice((0, 3, 9))) for i, (x, y) in enumerate(corners)], BOX)
    for whole, size, overlap in (((0.0, 0.0, 50.0, 30.0), 7.3, 2.1), ((-3.1, 0.1, 50.0, 30.0), 0.7, 0.0), ((0.0, 0.0, 0.0, 0.0), 5.0, 1.0)):
        b = F.col("buffered")
        near = partition_bbox(spark, whole, size, overlap).crossJoin(boxes.select("id", *(F.col(c).alias(f"its {c}") for c in G.BOX)))
        want = near.where(G.boxes_meet(tuple(b[c] for c in G.BOX), tuple(F.col(f"its {c}") for c in G.BOX))).select("id", "row", "col").collect()
        got = dealt_to_tiles(boxes, G.box(), whole, size, overlap).select("id", "row", "col").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want


def test_a_batch_of_tiles_moves_only_what_lies_near_it(spark, monkeypatch):
    from geoweld.plans import QUERIES, layers

    asked, similar = [], layers.similar_boxes
    monkeypatch.setattr(layers, "similar_boxes", lambda a, b, *args: asked.append((a.count(), b.count())) or similar(a, b, *args))
    got = QUERIES["tile_job_evidence"](spark, "/root/testdata/sf0.001").first()
    assert got.batches == len(asked) == 4 and got.rows_in_manifest == got.rows_written
    a, b = layers.base_boxes(spark, "/root/testdata/sf0.001").count(), layers.other_boxes(spark, "/root/testdata/sf0.001").count()
    # a fourth of the rows each, and those of the overlaps
    assert all(x < 0.5 * a and y < 0.5 * b for x, y in asked) and sum(x for x, _ in asked) >= a


def test_tiles_do_not_go_through_the_driver(spark, tmp_path):
    from geoweld.operators import tile_jobs as J
    from geoweld.operators.tiling import partition_bbox

    tiles = partition_bbox(spark, (0.0, 0.0, 20.0, 10.0), 10.0, 0.0)
    schema, folder = "tile_id string, id long, minx double, miny double, maxx double, maxy double", str(tmp_path / "job")
    assert J.run_tiles(tiles, lambda some: some.select("tile_id", F.lit(1).cast("long").alias("id"), *G.BOX), folder) == 1
    whole = J.stitched(J.tile_rows(spark, folder, schema), tiles, "id")
    assert whole.count() == 1
    plan = whole._jdf.queryExecution().executedPlan().toString()
    # only the one row of the tiles' upper ends is sent to all
    assert plan.count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in plan


def test_owned_rows_lie_in_one_tile(spark):
    from geoweld.operators import tile_jobs as J
    from geoweld.operators.tiling import partition_bbox

    tiles = partition_bbox(spark, (0.0, 0.0, 20.0, 10.0), 10.0, 0.0)
    boxes = [(i, x - 1.0, y - 1.0, x + 1.0, y + 1.0) for i, (x, y) in enumerate([(0.0, 0.0), (10.0, 5.0), (20.0, 10.0), (9.9, 10.0), (25.0, 5.0)])]
    rows = spark.createDataFrame([(t, *map(lambda v: v, b)) for t in ("tile_000_000", "tile_000_001") for b in boxes], f"tile_id string, {BOX}")
    assert sorted((r.id, r.tile_id[-1]) for r in J.owned(rows, tiles).collect()) == [(0, "0"), (1, "1"), (2, "1"), (3, "0")]


def test_a_manifest_is_not_written_by_one_task(spark, tmp_path):
    from geoweld.operators import tile_jobs as J

    tiles = spark.range(40).selectExpr("CAST(id AS STRING) AS tile_id")
    folder, was = str(tmp_path / "job"), {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(was, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        assert J.run_tiles(tiles, lambda some: some.where("tile_id <> '7'"), folder) == 1
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert len(list((tmp_path / "job" / "manifest").glob("*.parquet"))) > 1
    assert {r.tile_id: r.n for r in J.finished(spark, folder).collect()} == {str(i): int(i != 7) for i in range(40)}
