"""Statistics of raster values within shapes, over many blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweld.functions.geometry import BOX
from geoweld.functions.overlay import BLOCK, ROWS, edges_of
from geoweld.operators.grid_join import grid_join
from geoweld.operators.shapes import with_bounds

#: Blocks of a file that a task works on in one go.
TOGETHER = 16
#: Partial counts of a shape in a block.
COUNTS = "id long, value double, n long"


def _pixels_inside(block: dict, low: np.ndarray, high: np.ndarray, shapes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The shape and the value of each pixel of a block whose middle lies inside an odd number of a shape's rings; nodata is left out.

    low and high are the shapes' bounds (x, y). All shapes are looked at together, each at the pixels with a value in its bounds alone, some at a time.
    """
    wide, high_up = block["width"], block["height"]
    xs = block["minx"] + (np.arange(wide) + 0.5) * block["dx"]
    ys = block["maxy"] - (np.arange(high_up) + 0.5) * block["dy"]
    values = np.asarray(block["values"], float)
    fine = np.isfinite(values) if block["nodata"] is None else np.isfinite(values) & (values != block["nodata"])
    at = np.flatnonzero(fine)
    row_start = np.searchsorted(at, np.arange(high_up + 1) * wide)  # pixels with a value, row by row
    x, y, values = xs[at % wide], ys[at // wide], values[at]
    # rows go down, so the first is that of the highest y
    top, bottom = np.searchsorted(-ys, -high[:, 1], "left"), np.searchsorted(-ys, -low[:, 1], "right")
    start, size = row_start[top], np.maximum(row_start[np.maximum(bottom, top)] - row_start[top], 0)
    edges, of = edges_of(shapes)
    edges, of = edges[edges[:, 1] != edges[:, 3]], of[edges[:, 1] != edges[:, 3]]
    n_edges = np.bincount(of, minlength=len(shapes))
    first = np.cumsum(n_edges) - n_edges
    found, ends, done = [], np.cumsum(size), 0
    while done < len(size):
        before = ends[done - 1] if done else 0
        to = max(done + 1, int(np.searchsorted(ends, before + BLOCK, "right")))
        own = np.repeat(np.arange(done, to), size[done:to])
        pixel = np.arange(len(own)) - np.repeat(ends[done:to] - size[done:to] - before, size[done:to]) + start[own]
        done = to
        near = (x[pixel] >= low[own, 0]) & (x[pixel] <= high[own, 0])
        own, pixel = own[near], pixel[near]
        for i in range(0, len(own), BLOCK // 8):
            s, p = own[i : i + BLOCK // 8], pixel[i : i + BLOCK // 8]
            odd = np.zeros(len(s), bool)
            for k in range(int(n_edges[s].max(initial=0))):  # the k-th edge of each
                has = np.flatnonzero(n_edges[s] > k)
                ax, ay, bx, by = edges[first[s[has]] + k].T
                px, py = x[p[has]], y[p[has]]
                odd[has] ^= ((ay > py) != (by > py)) & (px < ax + (py - ay) * (bx - ax) / (by - ay))
            found.append((s[odd], values[p[odd]]))
    return tuple(np.concatenate([np.zeros(0, kind), *(f[i] for f in found)]) for i, kind in ((0, np.int64), (1, float)))


def _counted(shapes: pa.Table, blocks: pa.Table) -> pa.Table:
    """How often each value stands in each shape's pixels of each of a few blocks of one file."""
    schema = pa.schema([("id", pa.int64()), ("value", pa.float64()), ("n", pa.int64())])
    made = [schema.empty_table()]
    if not shapes.num_rows or not blocks.num_rows:
        return made[0]
    shapes = shapes.sort_by("block").combine_chunks()
    numbers = shapes.column("block").to_numpy()
    of_block = {b["block"]: b for b in blocks.drop_columns(["values"]).to_pylist()}
    for number, values in zip(blocks.column("block").to_pylist(), blocks.column("values"), strict=True):
        block = of_block[number] | {"values": values.values.to_numpy()}
        begin, end = np.searchsorted(numbers, [number, number + 1])
        for some in shapes.slice(begin, end - begin).to_batches(max_chunksize=ROWS):
            low, high = (np.stack([some.column(f"a_{c}").to_numpy(zero_copy_only=False) for c in names], axis=1) for names in (("minx", "miny"), ("maxx", "maxy")))
            own, values = _pixels_inside(block, low, high, some.column("a_parts"))
            order = np.lexsort((values, own))
            own, values = own[order], values[order]
            new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (values[1:] != values[:-1])]) if len(own) else own
            ids = some.column("a_id").to_numpy(zero_copy_only=False)[own[new]]
            made.append(pa.table([pa.array(ids, pa.int64()), pa.array(values[new]), pa.array(np.diff(np.r_[new, len(own)]), pa.int64())], schema=schema))
    return pa.concat_tables(made)


def zonal_statistics(shapes: DataFrame, blocks: DataFrame, cell: float, low: float | None = None, high: float | None = None) -> DataFrame:
    """id, n, low, high, mean, dominant of the pixels whose middle lies in each shape (id, parts), left and lower sides included; shapes without any have n 0 and nulls.

    Each block gives partial counts of values, which add up over blocks; of values that are equally frequent the
    highest is dominant. Values of nodata, infinite ones and ones outside low and high don't count. A
    pixel that several rasters have counts each time. cell should be about a block's side.
    """
    placed = with_bounds(shapes.select("id", "parts"))
    # shapes go to their blocks, so a block's values are moved once, however many shapes lie on it
    met = grid_join(placed, blocks.select("path", "block", *BOX), cell).select("a_id", *(f"a_{c}" for c in BOX), "a_parts", F.col("b_path").alias("path"), F.col("b_block").alias("block"))
    some = F.floor(F.col("block") / TOGETHER).alias("some")
    counts = met.groupBy("path", some).cogroup(blocks.groupBy("path", some)).applyInArrow(_counted, COUNTS)
    for bound, test in ((low, ">="), (high, "<=")):
        counts = counts if bound is None else counts.where(f"value {test} {bound}")
    each = counts.groupBy("id", "value").agg(F.sum("n").alias("n"))
    total = each.groupBy("id").agg(
        F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
        F.max_by("value", F.struct("n", "value")).alias("dominant"),
    )
    return shapes.select("id").join(total, "id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
