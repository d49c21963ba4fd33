"""Rasters as blocks: tiled TIFF files with a place on the ground, of one image or of several pages.

A file's bytes come from Spark's binary reader, so rasters may lie wherever Spark reads. Each task decodes
its files and gives one row a block: its place, pixel size and values. Blocks off the asked
window are never decoded; a file's own bounds, which its header tells, leave out the whole file. Files are uncompressed, of one band, little-endian or big-endian.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: minx to maxy are a block's bounds; rows of values go from the top down. nodata is null where the file names none.
BLOCK = "path string, block int, minx double, miny double, maxx double, maxy double, dx double, dy double, width int, height int, nodata double, values array<double>"
#: Blocks of a file that leave a task together.
BATCH = 64
#: Tags of a TIFF file, and the formats of samples by (kind, bits). Fixed by the standard.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, COUNTS = 256, 257, 258, 259, 262, 273, 277, 279
SUBFILE, PAGE = 254, 2
STRIP_ROWS, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, KIND, PIXEL_SCALE, TIE_POINT, NO_DATA = 278, 322, 323, 324, 325, 339, 33550, 33922, 42113
DTYPES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
FIELDS = {1: "B", 2: "c", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}


def tiff_bytes(values: np.ndarray, left: float, top: float, dx: float, dy: float, nodata: float | None = None, tile: int = 64) -> bytes:
    """A tiled TIFF file of one band, whose upper left corner is at (left, top)."""
    return tiff_pages([(values, left, top)], dx, dy, nodata, tile)


def tiff_pages(images: Sequence[tuple[np.ndarray, float, float]], dx: float, dy: float, nodata: float | None = None, tile: int = 64) -> bytes:
    """A TIFF file of tiled images of one band, each (values, left, top) with a place of its own; several are marked as pages."""
    made, at = [struct.pack("<2sHI", b"II", 42, 8)], 8
    for k, image in enumerate(images):
        made.append(_page(*image, dx, dy, nodata, tile, at, len(images) > 1, k + 1 == len(images)))
        at += len(made[-1])
    return b"".join(made)


def _page(values: np.ndarray, left: float, top: float, dx: float, dy: float, nodata: float | None, tile: int, at: int, paged: bool, last: bool) -> bytes:
    """The directory and the blocks of an image that begins at a place of its file; the next one follows at once."""
    height, width = values.shape
    dtype = values.dtype.newbyteorder("<")
    down, across = -(-height // tile), -(-width // tile)
    padded = np.zeros((down * tile, across * tile), dtype)
    padded[:height, :width] = values
    blocks = [padded[r * tile : (r + 1) * tile, c * tile : (c + 1) * tile].tobytes() for r in range(down) for c in range(across)]
    kind = {"u": 1, "i": 2, "f": 3}[dtype.kind]
    tags: list[tuple[int, int, tuple]] = [(SUBFILE, 4, (PAGE,))] if paged else []
    tags += [
        (WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (8 * dtype.itemsize,)), (COMPRESSION, 3, (1,)), (PHOTOMETRIC, 3, (1,)), (SAMPLES, 3, (1,)), (TILE_WIDTH, 3, (tile,)), (TILE_HEIGHT, 3, (tile,)),
        (TILE_OFFSETS, 4, tuple([0] * len(blocks))), (TILE_COUNTS, 4, tuple(map(len, blocks))), (KIND, 3, (kind,)), (PIXEL_SCALE, 12, (dx, dy, 0.0)), (TIE_POINT, 12, (0.0, 0.0, 0.0, left, top, 0.0)),
    ]
    if nodata is not None:
        tags.append((NO_DATA, 2, tuple(bytes([c]) for c in f"{nodata!r}\0".encode())))
    more = at + 2 + 12 * len(tags) + 4
    sizes = [struct.calcsize(f"<{len(v)}{FIELDS[t]}") for _, t, v in tags]
    first = more + sum(n for n in sizes if n > 4)
    first += first % 2  # directories begin at even places, so blocks' bytes are made even too
    ends = np.cumsum([first, *(len(b) + len(b) % 2 for b in blocks)]).tolist()
    tags = [(k, t, tuple(ends[:-1]) if k == TILE_OFFSETS else v) for k, t, v in tags]
    head, data = struct.pack("<H", len(tags)), b""
    for (k, t, v), n in zip(tags, sizes, strict=True):
        raw = struct.pack(f"<{len(v)}{FIELDS[t]}", *v)
        head += struct.pack("<HHI", k, t, len(v)) + (raw.ljust(4, b"\0") if n <= 4 else struct.pack("<I", more + len(data)))
        data += raw if n > 4 else b""
    head += struct.pack("<I", 0 if last else ends[-1])
    return (head + data).ljust(first - at, b"\0") + b"".join(b.ljust(len(b) + len(b) % 2, b"\0") for b in blocks)


def tiff_images(raw: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and tags of the first image of a TIFF file and of those after it that are marked as pages, not as its overviews or masks."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack_from(f"{order}H", raw, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(f"{order}I", raw, 4)
    seen: set[int] = set()
    while at or not seen:
        if at in seen:
            raise ValueError("images of a TIFF file that follow each other in a circle")
        (n,) = struct.unpack_from(f"{order}H", raw, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", raw, at + 2 + 12 * k)
            if kind in FIELDS:
                form = f"{order}{count}{FIELDS[kind]}"
                place = at + 10 + 12 * k
                if struct.calcsize(form) > 4:
                    (place,) = struct.unpack_from(f"{order}I", raw, place)
                tags[tag] = struct.unpack_from(form, raw, place)
        if not seen or tags.get(SUBFILE, (0,))[0] == PAGE:
            yield order, tags
        seen.add(at)
        end = at + 2 + 12 * n
        (at,) = struct.unpack_from(f"{order}I", raw, end) if len(raw) >= end + 4 else (0,)


def tiff_blocks(raw: bytes, window: tuple[float, float, float, float] | None = None) -> Iterator[tuple]:
    """Rows of BLOCK but path: the blocks of a file that meet the window, with the part of edge blocks that belongs to the image. A page's blocks are numbered on from those before."""
    before = 0
    for order, tags in tiff_images(raw):
        offsets = tags[TILE_OFFSETS if TILE_OFFSETS in tags else OFFSETS]
        yield from _image_blocks(raw, order, tags, offsets, before, window)
        before += len(offsets)


def _image_blocks(raw: bytes, order: str, tags: dict[int, tuple], offsets: tuple[int, ...], before: int, window: tuple[float, float, float, float] | None) -> Iterator[tuple]:
    if tags.get(COMPRESSION, (1,))[0] != 1 or tags.get(SAMPLES, (1,))[0] != 1:
        raise ValueError("only uncompressed TIFF files of one band are read")
    width, height = tags[WIDTH][0], tags[HEIGHT][0]
    dtype = np.dtype(order + DTYPES[tags.get(KIND, (1,))[0], tags[BITS][0]])
    (dx, dy), (_, _, _, left, top, _) = tags[PIXEL_SCALE][:2], tags[TIE_POINT][:6]
    text = b"".join(tags.get(NO_DATA, ())).split(b"\0")[0].strip()
    nodata = float(text) if text else None
    tiled = TILE_OFFSETS in tags
    across, down = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(height, tags.get(STRIP_ROWS, (height,))[0]))
    of_row = -(-width // across)
    for block, offset in enumerate(offsets):
        r, c = divmod(block, of_row)
        wide, high = min(across, width - c * across), min(down, height - r * down)
        minx, maxy = left + c * across * dx, top - r * down * dy
        maxx, miny = minx + wide * dx, maxy - high * dy
        if window and not (minx <= window[2] and window[0] <= maxx and miny <= window[3] and window[1] <= maxy):
            continue
        rows = down if tiled else high
        values = np.frombuffer(raw, dtype, rows * across, offset).reshape(rows, across)[:high, :wide]
        yield before + block, minx, miny, maxx, maxy, dx, dy, wide, high, nodata, values.astype(float).ravel()


def read_blocks(spark: SparkSession, path: str, window: tuple[float, float, float, float] | None = None) -> DataFrame:
    """BLOCK rows of all TIFF files under a path that meet the window (minx, miny, maxx, maxy). A file that can't be read is an error."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("block", pa.int32()), *((n, pa.float64()) for n in ("minx", "miny", "maxx", "maxy", "dx", "dy")), ("width", pa.int32()), ("height", pa.int32()), ("nodata", pa.float64()), ("values", pa.list_(pa.float64()))])
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = tiff_blocks(raw.as_py(), window)
                while some := list(islice(rows, BATCH)):
                    *plain, values = zip(*some, strict=True)
                    ends = np.cumsum([0, *map(len, values)])
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values)))
                    yield pa.RecordBatch.from_arrays([*(pa.array(v, f.type) for v, f in zip(([name] * len(some), *plain), list(schema)[:-1], strict=True)), lists], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(decode, BLOCK)


def put_file(folder: str, name: str, raw: bytes) -> str:
    """Write a file under another name and move it into place; folder is a URI that pyarrow knows or a path. Gives its path."""
    place = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
    system, root = fs.FileSystem.from_uri(place)
    system.create_dir(root)
    with system.open_output_stream(f"{root}/.{name}.part") as out:
        out.write(raw)
    system.move(f"{root}/.{name}.part", f"{root}/{name}")
    return f"{root}/{name}"


def write_rasters(pixels: DataFrame, folder: str, left: str, top: str, size: int, pixel: float, dtype: str = "f4", nodata: float | None = None, tile: int = 64, file: str | None = None) -> DataFrame:
    """Write each raster of pixels (raster, col, row, value; left and top are columns of the raster's corner) of size times size pixels as a TIFF image; gives raster and path.

    Pixels without a row hold nodata. Each raster has a file of its own, or file names a column that tells which rasters are pages of one; a task holds those of a
    file. Where rasters are many and small, files should hold many, as the driver lists all files that are read. A file is moved into place as a whole, so a task that runs again replaces it.
    """

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        names, images = [], []
        for name, own in pdf.groupby("raster", sort=True):
            values = np.full((size, size), 0 if nodata is None else nodata, dtype)
            values[own["row"], own["col"]] = own["value"]
            names.append(str(name))
            images.append((values, float(own[left].iloc[0]), float(own[top].iloc[0])))
        path = put_file(folder, f"raster-{pdf['file'].iloc[0]}.tif", tiff_pages(images, pixel, pixel, nodata, tile))
        return pd.DataFrame({"raster": names, "path": path})

    named = pixels.select("raster", "col", "row", "value", left, top, F.col(file or "raster").alias("file"))
    return named.groupBy("file").applyInPandas(write, "raster string, path string")
