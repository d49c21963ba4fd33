"""The k nearest boxes of any point, however far they are.

Boxes lie in grid cells by their middles, cells in cells four times as wide, and so on up to a
few. Every cell knows how many boxes it holds and the box around them. From the
top down each point keeps the cells that may hold one of its k nearest: those no farther than the distance within which
cells known so far hold k boxes for certain. The points meet the cells below, in the end the
boxes, by equi-joins, so no point looks at more than a few cells a level, be its neighbours near or far.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweld.functions.geometry import BOX
from geoweld.operators.components import checkpointed

#: Cells of one level that lie in one cell of the next, along a side.
FANOUT = 4
#: Cells at the top at most.
TOP_CELLS = 64


def _least(x: Column, y: Column) -> Column:
    """Squared distance from a point to the box minx, miny, maxx, maxy."""
    dx = F.greatest(F.lit(0.0), F.col("minx") - x, x - F.col("maxx"))
    dy = F.greatest(F.lit(0.0), F.col("miny") - y, y - F.col("maxy"))
    return dx * dx + dy * dy


def _most(x: Column, y: Column) -> Column:
    """Squared distance to the box's farthest corner."""
    dx, dy = F.greatest(F.abs(F.col("minx") - x), F.abs(F.col("maxx") - x)), F.greatest(F.abs(F.col("miny") - y), F.abs(F.col("maxy") - y))
    return dx * dx + dy * dy


def _summed(cells: DataFrame) -> DataFrame:
    return cells.groupBy("cx", "cy").agg(F.sum("n").alias("n"), F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


def nearest_rows(points: DataFrame, boxes: DataFrame, cell: float, k: int = 1) -> DataFrame:
    """a_id, b_id, dist, rank of the k boxes (id, minx, miny, maxx, maxy) nearest to each point (id, x, y), all if there are fewer; ties go to the smaller b_id.

    cell should hold a few boxes. Points and boxes with a null or infinite coordinate take no part.
    """
    finite = lambda cols: " AND ".join(f"abs({c}) < double('infinity')" for c in cols)
    middle = [F.floor((F.col(f"min{c}") + F.col(f"max{c}")) / 2 / cell).alias(f"c{c}") for c in "xy"]
    placed = checkpointed(boxes.where(finite(BOX)).select(F.col("id").alias("b_id"), *BOX, *middle))
    levels = [checkpointed(_summed(placed.withColumn("n", F.lit(1).cast("long"))))]
    while levels[-1].count() > TOP_CELLS:
        up = levels[-1].withColumns({c: F.floor(F.col(c) / FANOUT) for c in ("cx", "cy")})
        levels.append(checkpointed(_summed(up)))
    asked = points.where(finite("xy")).select(F.col("id").alias("a_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))

    def near(found: DataFrame) -> DataFrame:
        """The cells (n, bounds) of each point that may hold one of its k nearest."""
        x, y = F.col("x"), F.col("y")
        made = found.withColumns({"least": _least(x, y), "most": _most(x, y)})
        upto = made.withColumn("held", F.sum("n").over(Window.partitionBy("a_id").orderBy("most", "cx", "cy")))
        bound = F.min(F.when(F.col("held") >= k, F.col("most"))).over(Window.partitionBy("a_id"))
        return upto.withColumn("bound", bound).where(F.col("bound").isNull() | (F.col("least") <= F.col("bound"))).select("a_id", "x", "y", "cx", "cy")

    top = levels.pop()
    kept = near(asked.crossJoin(F.broadcast(top)))  # TOP_CELLS rows
    while levels:
        below = levels.pop().withColumns({"px": F.floor(F.col("cx") / FANOUT), "py": F.floor(F.col("cy") / FANOUT)})
        kept = near(checkpointed(kept).withColumnsRenamed({"cx": "px", "cy": "py"}).join(below, ["px", "py"]))
    each = checkpointed(kept).join(placed, ["cx", "cy"]).select("a_id", "b_id", F.sqrt(_least(F.col("x"), F.col("y"))).alias("dist"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("a_id").orderBy("dist", "b_id")))
    return ranked.where(F.col("rank") <= k)
