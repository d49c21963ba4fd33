"""Shapefile bundles: .shp, .shx and .dbf of one layer in a ZIP archive, as source and sink.

Archives come from Spark's binary reader, so they may lie wherever Spark reads, and are never
unpacked to disk; a layer is written as many archives, one a task at a time. Coordinates are plane; attributes are text and numbers.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweld.functions.overlay import ARROW_PARTS, PARTS
from geoweld.sources.rasters import put_file

#: Kinds of shapes by number, and the suffixes that a layer must have. Fixed by the format.
NOTHING, POINT, LINE, POLYGON = 0, 1, 3, 5
KINDS = {"point": POINT, "line": LINE, "polygon": POLYGON}
NEEDED = (".shp", ".shx", ".dbf")
#: Longest name of a field and longest text in one, in bytes.
NAME_BYTES, TEXT_BYTES, NUMBER_BYTES = 10, 254, 24
SHAPES = f"path string, record int, kind string, parts {PARTS}, attributes map<string,string>"


class UnsafeArchive(ValueError):
    """An archive with a member that would leave the folder it is unpacked to."""


def field_names(names: Sequence[str]) -> list[str]:
    """Names cut to what a file holds; ones that come out alike end in a number."""
    out: list[str] = []
    for name in names:
        cut, k = name.encode()[:NAME_BYTES].decode(errors="ignore"), 0
        while cut.lower() in {x.lower() for x in out}:
            k += 1
            cut = name.encode()[: NAME_BYTES - len(str(k)) - 1].decode(errors="ignore") + f"_{k}"
        out.append(cut)
    return out


def _inside(p: tuple[float, float], ring: list[tuple[float, float]]) -> bool:
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ay > p[1]) != (by > p[1]) and p[0] < ax + (p[1] - ay) * (bx - ax) / (by - ay):
            odd = not odd
    return odd


def _turned(rings: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Closed rings, outer ones clockwise and holes the other way, as the format wants them."""
    out = []
    for i, ring in enumerate(rings):
        ring = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring
        middle = ((ring[0][0] + ring[1][0]) / 2, (ring[0][1] + ring[1][1]) / 2) if len(ring) > 1 else ring[0]
        hole = sum(_inside(middle, r) for k, r in enumerate(rings) if k != i) % 2 == 1
        left = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) > 0
        ring = ring[::-1] if left != hole else ring
        out.append([*ring, ring[0]])
    return out


def bundle_bytes(kind: str, shapes: Sequence[list | None], attributes: dict[str, Sequence], name: str = "layer") -> bytes:
    """A ZIP archive of a layer's shapes (rings or lines of (x, y), None for none) and attributes (texts or numbers, None for null)."""
    records, bounds = [], [float("inf"), float("inf"), float("-inf"), float("-inf")]
    for parts in shapes:
        parts = [[(float(x), float(y)) for x, y in p] for p in parts or () if p]
        points = [p for part in parts for p in part]
        if not points:
            records.append(struct.pack("<i", NOTHING))
            continue
        box = (min(x for x, _ in points), min(y for _, y in points), max(x for x, _ in points), max(y for _, y in points))
        bounds = [*map(min, bounds[:2], box[:2]), *map(max, bounds[2:], box[2:])]
        if kind == "point":
            records.append(struct.pack("<i2d", POINT, *points[0]))
            continue
        parts = _turned(parts) if kind == "polygon" else parts
        points = [p for part in parts for p in part]
        starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
        records.append(struct.pack(f"<i4d2i{len(parts)}i{2 * len(points)}d", KINDS[kind], *box, len(parts), len(points), *starts, *(v for p in points for v in p)))
    shape, index, at = b"", b"", 50
    for k, content in enumerate(records, 1):
        index += struct.pack(">2i", at, len(content) // 2)
        shape += struct.pack(">2i", k, len(content) // 2) + content
        at += 4 + len(content) // 2
    box = [v if abs(v) != float("inf") else 0.0 for v in bounds]
    head = lambda words: struct.pack(">i", 9994) + bytes(20) + struct.pack(">i", words) + struct.pack("<2i8d", 1000, KINDS[kind], *box, 0, 0, 0, 0)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr(f"{name}.shp", head(50 + len(shape) // 2) + shape)
        archive.writestr(f"{name}.shx", head(50 + len(index) // 2) + index)
        archive.writestr(f"{name}.dbf", _table_bytes(attributes, len(records)))
        archive.writestr(f"{name}.cpg", "UTF-8")
    return out.getvalue()


def _table_bytes(attributes: dict[str, Sequence], n: int) -> bytes:
    columns = []
    for name, values in zip(field_names(list(attributes)), attributes.values(), strict=True):
        numeric = all(v is None or isinstance(v, (int, float)) for v in values)
        texts = [b"" if v is None else (repr(v) if numeric else str(v)).encode()[: NUMBER_BYTES if numeric else TEXT_BYTES] for v in values]
        texts = [t.decode(errors="ignore").encode() for t in texts]
        columns.append((name.encode(), b"N" if numeric else b"C", NUMBER_BYTES if numeric else max(1, *map(len, texts), 1), texts))
    size = 1 + sum(w for _, _, w, _ in columns)
    head = struct.pack("<4BIHH20x", 3, 124, 1, 1, n, 33 + 32 * len(columns), size)
    for name, kind, width, _ in columns:
        head += struct.pack("<11sc4xBB14x", name, kind, width, 0)
    rows = b"".join(b" " + b"".join(texts[i].rjust(w) if kind == b"N" else texts[i].ljust(w) for _, kind, w, texts in columns) for i in range(n))
    return head + b"\r" + rows + b"\x1a"


def checked_members(archive: zipfile.ZipFile) -> list[str]:
    """The members' names; an error if one of them leads out of the archive's own folder."""
    names = archive.namelist()
    for name in names:
        pieces = name.replace("\\", "/").split("/")
        if name.startswith(("/", "\\")) or ".." in pieces or (len(pieces[0]) == 2 and pieces[0][1] == ":"):
            raise UnsafeArchive(f"unsafe member {name!r}")
    return names


def bundle_rows(raw: bytes, window: tuple[float, float, float, float] | None = None) -> Iterator[tuple[int, str | None, list, dict]]:
    """record, kind, parts and attributes of the shapes that meet the window, of the first whole layer of an archive. Records without a shape meet every window."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        names = checked_members(archive)
        known = {n.lower(): n for n in names}
        bases = sorted(n[:-4] for n in names if n.lower().endswith(".shp") and all(n[:-4].lower() + s in known for s in NEEDED))
        if not bases:
            raise ValueError("no layer with .shp, .shx and .dbf in the archive")
        shp, dbf = (archive.read(known[bases[0].lower() + s]) for s in (".shp", ".dbf"))
    n, first, size = struct.unpack_from("<IHH", dbf, 4)
    fields, at = [], 1
    for k in range((first - 33) // 32):
        name, kind, width = struct.unpack_from("<11sc4xB", dbf, 32 + 32 * k)
        fields.append((name.split(b"\0")[0].decode(), at, at + width))
        at += width
    place, record = 100, 0
    while place + 8 <= len(shp):
        number, words = struct.unpack_from(">2i", shp, place)
        content = place + 8
        place, record = content + 2 * words, record + 1
        (shape,) = struct.unpack_from("<i", shp, content)
        kind, parts = next((k for k, v in KINDS.items() if v == shape), None), []
        if shape == POINT:
            x, y = struct.unpack_from("<2d", shp, content + 4)
            box = (x, y, x, y)
            parts = [[(x, y)]]
        elif shape in (LINE, POLYGON):
            box = struct.unpack_from("<4d", shp, content + 4)
        elif shape != NOTHING:
            raise ValueError(f"shapes of kind {shape} aren't read")
        if window and shape != NOTHING and not (box[0] <= window[2] and window[0] <= box[2] and box[1] <= window[3] and window[1] <= box[3]):
            continue
        if shape in (LINE, POLYGON):
            n_parts, n_points = struct.unpack_from("<2i", shp, content + 36)
            starts = [*struct.unpack_from(f"<{n_parts}i", shp, content + 44), n_points]
            flat = struct.unpack_from(f"<{2 * n_points}d", shp, content + 44 + 4 * n_parts)
            points = list(zip(flat[::2], flat[1::2], strict=True))
            parts = [points[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
            parts = [p[:-1] if shape == POLYGON and len(p) > 1 and p[0] == p[-1] else p for p in parts]
        row = dbf[first + (record - 1) * size : first + record * size] if record <= n else b""
        values = {name: row[a:b].decode("utf-8", "replace").strip() for name, a, b in fields}
        yield record, kind, parts, {k: v for k, v in values.items() if v}


def read_bundles(spark: SparkSession, path: str, window: tuple[float, float, float, float] | None = None) -> DataFrame:
    """SHAPES rows of all archives under a path: shapes that meet the window (minx, miny, maxx, maxy). Archives that are unsafe or hold no layer are an error."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("record", pa.int32()), ("kind", pa.string()), ("parts", ARROW_PARTS), ("attributes", pa.map_(pa.string(), pa.string()))])
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = [(name, r, k, [[{"x": x, "y": y} for x, y in p] for p in parts], list(a.items())) for r, k, parts, a in bundle_rows(raw.as_py(), window)]
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 10_000], strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(decode, SHAPES)


def write_bundles(layer: DataFrame, folder: str, kind: str, rows_a_file: int = 50_000) -> DataFrame:
    """Write a layer (parts and attributes) as archives of up to rows_a_file shapes each; gives path and rows of every file.

    Names of attributes are cut to ten bytes. A file is named by its task and moved into place, so a task that runs again replaces it.
    """
    names = [c for c in layer.columns if c != "parts"]

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, k = [], 0
        for pdf in batches:
            held.append(pdf)
            while (whole := sum(map(len, held))) >= rows_a_file:
                rows = pd.concat(held)
                yield store(rows.iloc[:rows_a_file], part, k)
                held, k = [rows.iloc[rows_a_file:]], k + 1
                if whole == rows_a_file:
                    held = []
        if sum(map(len, held)):
            yield store(pd.concat(held), part, k)

    def store(pdf: pd.DataFrame, part: int, k: int) -> pd.DataFrame:
        shapes = [None if parts is None else [[(p["x"], p["y"]) for p in part] for part in parts] for parts in pdf["parts"]]
        attributes = {c: [None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in pdf[c]] for c in names}
        return pd.DataFrame({"path": [put_file(folder, f"layer-{part:05d}-{k:05d}.zip", bundle_bytes(kind, shapes, attributes))], "rows": [len(pdf)]})

    return layer.mapInPandas(write, "path string, rows long")


def numbered(shapes: DataFrame, name: str) -> DataFrame:
    """The rows of SHAPES with an attribute as a number, `value`."""
    return shapes.withColumn("value", F.col("attributes")[name].try_cast("double"))
