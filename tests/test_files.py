"""Rasters and shapefile bundles: round trips, windows, odd files."""

import io
import pathlib
import struct
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geoweld.operators.zonal import zonal_statistics
from geoweld.sources import rasters as R
from geoweld.sources import shapefiles as Z


@pytest.mark.parametrize(("dtype", "nodata"), [("u1", None), ("i2", -9), ("f4", -1.5), ("f8", 0)])
def test_tiff_round_trip(dtype, nodata):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 90, (37, 53)).astype(dtype)
    raw = R.tiff_bytes(values, 100.0, 500.0, 2.0, 4.0, nodata, 16)
    back = np.zeros((37, 53))
    for _, minx, miny, maxx, maxy, dx, dy, wide, high, none, own in R.tiff_blocks(raw):
        c, r = int((minx - 100) / 2), int((500 - maxy) / 4)
        back[r : r + high, c : c + wide] = own.reshape(high, wide)
        assert (dx, dy, none) == (2.0, 4.0, nodata) and (maxx - minx, maxy - miny) == (2 * wide, 4 * high)
    assert (back == values).all()
    some = [b[0] for b in R.tiff_blocks(raw, (100.0, 490.0, 110.0, 500.0))]
    assert some == [0]
    with pytest.raises(ValueError, match="TIFF"):
        list(R.tiff_blocks(b"II" + bytes(40)))


def test_pages_of_a_tiff_file_are_read_and_overviews_are_not():
    rng = np.random.default_rng(4)
    images = [(rng.integers(0, 9, (21, 21)).astype("u1"), 30.0 * k, 50.0) for k in range(3)]
    raw = R.tiff_pages(images, 1.0, 1.0, -12, 16)  # odd sizes, so that directories would begin at odd places
    found = list(R.tiff_blocks(raw))
    assert [b[0] for b in found] == list(range(12)) and [b[1] for b in found[::4]] == [0.0, 30.0, 60.0]
    for k, (values, *_) in enumerate(images):
        assert (found[4 * k][-1].reshape(16, 16) == values[:16, :16]).all() and (found[4 * k + 3][-1].reshape(5, 5) == values[16:, 16:]).all()
    assert [b[0] for b in R.tiff_blocks(raw, (61.0, 49.0, 62.0, 50.0))] == [8]
    # the second and third are no pages but smaller copies of the first, which other programs write
    second = struct.unpack_from("<I", raw, 10 + 12 * struct.unpack_from("<H", raw, 8)[0])[0]
    assert second % 2 == 0 and struct.unpack_from("<HHII", raw, second + 2) == (R.SUBFILE, 4, 1, R.PAGE)
    third = struct.unpack_from("<I", raw, second + 2 + 12 * struct.unpack_from("<H", raw, second)[0])[0]
    other = bytearray(raw)
    for at in (second, third):
        struct.pack_into("<I", other, at + 10, 1)
    assert [b[0] for b in R.tiff_blocks(bytes(other))] == [0, 1, 2, 3]
    struct.pack_into("<I", other, third + 2 + 12 * struct.unpack_from("<H", raw, third)[0], second)
    with pytest.raises(ValueError, match="circle"):
        list(R.tiff_blocks(bytes(other)))


def test_many_small_rasters_lie_in_few_files(spark, tmp_path):
    rows = [(f"r{k}", k // 4, k % 5, k % 3, 1.0 + k, 10.0 * k, 10.0) for k in range(10)]
    pixels = spark.createDataFrame(rows, "raster string, strip long, col int, row int, value double, left double, top double")
    wrote = R.write_rasters(pixels, str(tmp_path), "left", "top", 5, 2.0, "i2", 0, 16, "strip").collect()
    assert sorted(r.raster for r in wrote) == sorted(r[0] for r in rows) and len({r.path for r in wrote}) == len(list(tmp_path.glob("*.tif"))) == 3
    got = {(r.minx, r.maxy, *np.flatnonzero(r["values"]), max(r["values"])) for r in R.read_blocks(spark, str(tmp_path)).collect()}
    assert got == {(left, top, row * 5 + col, value) for _, _, col, row, value, left, top in rows}


def test_raster_heights_writes_fewer_files_than_rasters(spark):
    from geoweld.operators.components import shared_folder
    from geoweld.plans import QUERIES

    folder = pathlib.Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("rasters-*"))
    QUERIES["raster_heights"](spark, "/root/testdata/sf0.001")
    (new,) = set(folder.glob("rasters-*")) - before
    assert len(list(new.glob("*.tif"))) == 1  # of 75 squares, in 15 rows


def test_statistics_over_blocks_and_files(spark, tmp_path):
    rng = np.random.default_rng(5)
    grid = rng.integers(0, 6, (40, 40))
    pixels = pd.DataFrame([(f"r{c // 20}", c % 20, r, float(grid[r, c]), 20.0 * (c // 20), 40.0) for r in range(40) for c in range(40) if r < 20], columns=["raster", "col", "row", "value", "left", "top"])
    R.write_rasters(spark.createDataFrame(pixels), str(tmp_path), "left", "top", 20, 1.0, "i2", 0, 16).collect()
    blocks = R.read_blocks(spark, f"file://{tmp_path}")
    assert blocks.count() == 8 and R.read_blocks(spark, str(tmp_path), (0.0, 39.0, 1.0, 40.0)).count() == 1
    tri, hole = [[(3.0, 22.0), (37.0, 23.0), (20.0, 39.0)]], [[(1.0, 21.0), (39.0, 21.0), (39.0, 39.0), (1.0, 39.0)], [(5.0, 25.0), (30.0, 25.0), (30.0, 35.0), (5.0, 35.0)]]
    shapes = spark.createDataFrame([(1, tri), (2, hole), (3, None), (4, [[(900.0, 900.0), (901.0, 900.0), (901.0, 901.0)]])], "id long, parts array<array<struct<x:double,y:double>>>")
    got = {r.id: r for r in zonal_statistics(shapes, blocks, 16.0).collect()}
    for i, rings in ((1, tri), (2, hole)):
        own = []
        for r in range(20):
            for c in range(40):
                x, y, odd = c + 0.5, 40 - r - 0.5, False
                for ring in rings:
                    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
                        odd ^= (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay)
                if odd and grid[r, c]:
                    own.append(grid[r, c])
        most = max(set(own), key=lambda v: (own.count(v), v))
        assert (got[i].n, got[i].low, got[i].high, got[i].dominant) == (len(own), min(own), max(own), most) and got[i]["mean"] == pytest.approx(np.mean(own))
    assert (got[3].n, got[3].low, got[4].n, got[4].dominant) == (0, None, 0, None)
    assert zonal_statistics(shapes, blocks, 16.0, low=2.0, high=4.0).where("id = 2 AND low >= 2 AND high <= 4").count() == 1


def test_values_of_blocks_go_into_no_join(spark, tmp_path):
    pixels = pd.DataFrame([("r", c, r, 1.0 + (c + r) % 3, 0.0, 200.0) for r in range(200) for c in range(200)], columns=["raster", "col", "row", "value", "left", "top"])
    R.write_rasters(spark.createDataFrame(pixels), str(tmp_path), "left", "top", 200, 1.0, "i2", 0, 16).collect()
    blocks = R.read_blocks(spark, str(tmp_path))
    assert blocks.count() == 169  # more than leave a task together
    shapes = spark.createDataFrame([(i, [[(0.0, 0.0), (150.0 + i, 0.0), (150.0 + i, 90.0), (0.0, 90.0)]]) for i in range(40)], "id long, parts array<array<struct<x:double,y:double>>>")
    found = zonal_statistics(shapes, blocks, 16.0)
    assert {r.id: r.n for r in found.collect()} == {i: (150 + i) * 90 for i in range(40)}
    assert "b_values" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_bundle_round_trip(spark, tmp_path):
    square, inner = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]
    rows = [(1, [square, inner], "Tür", 2.5), (2, None, None, None), (3, [[(9.0, 9.0), (10.0, 9.0), (9.0, 11.0)]], "x" * 300, -1.0)]
    df = spark.createDataFrame(rows, "id long, parts array<array<struct<x:double,y:double>>>, name_of_the_thing string, name_of_the_other double").coalesce(1)
    wrote = Z.write_bundles(df, str(tmp_path), "polygon", 2).collect()
    assert [r.rows for r in wrote] == [2, 1]
    got = {int(r.attributes["id"]): r for r in Z.read_bundles(spark, f"file://{tmp_path}").collect()}
    assert [sorted((p.x, p.y) for p in ring) for ring in got[1].parts] == [sorted(square), sorted(inner)] and got[1].kind == "polygon"
    assert got[1].attributes == {"id": "1", "name_of_th": "Tür", "name_of__1": "2.5"} and got[2].parts == [] and got[2].attributes == {"id": "2"}
    assert len(got[3].attributes["name_of_th"]) == 254
    assert {int(r.attributes["id"]) for r in Z.read_bundles(spark, str(tmp_path), (8.5, 8.5, 9.5, 9.5)).collect()} == {2, 3}
    assert Z.numbered(Z.read_bundles(spark, str(tmp_path)), "name_of__1").agg(F.sum("value")).first()[0] == 1.5


@pytest.mark.parametrize(("kind", "parts"), [("point", [[(3, 4)]]), ("line", [[(0, 0), (1, 2)], [(5, 5), (6, 6), (7, 5)]])])
def test_other_kinds_of_shapes(kind, parts):
    raw = Z.bundle_bytes(kind, [parts, None], {"n": [1, None]})
    first, second = Z.bundle_rows(raw)
    assert first == (1, kind, [[(float(x), float(y)) for x, y in p] for p in parts], {"n": "1"}) and second == (2, None, [], {})


@pytest.mark.parametrize("name", ["../x.shp", "/x.shp", "a/../../x.shp", "..\\x.shp", "C:\\x.shp"])
def test_unsafe_members_are_refused(name):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr(name, b"")
    with pytest.raises(Z.UnsafeArchive):
        list(Z.bundle_rows(out.getvalue()))


def test_archives_without_a_whole_layer():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("a.shp", struct.pack(">i", 9994))
    with pytest.raises(ValueError, match="no layer"):
        list(Z.bundle_rows(out.getvalue()))
    assert Z.field_names(["abcdefghijk", "abcdefghijx", "ABCDEFGHIJ", "ok"]) == ["abcdefghij", "abcdefgh_1", "ABCDEFGH_2", "ok"]
