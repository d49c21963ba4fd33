"""Spatial joins by grid cells.

Both sides' boxes are exploded into the cells of a grid and meet by an equi-join on
the cell, which Spark shuffles, sorts and splits where skewed like any other. A pair
that meets in several cells is kept in one only, the one with the lower left
corner of the common box, so no distinct is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweld.functions.geometry import box, boxes_meet
from geoweld.operators.naming import first_rows


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))


#: Cells that a box covers in a direction at most, but for one at either end; larger ones lie in a grid of so much larger cells.
MOST_CELLS = 64
#: The columns of level and cell, under names that no layer has.
LEVEL, AT = "level of the grid", ("column of the grid", "row of the grid")


def _celled(df: DataFrame, prefix: str, cell: float, radius: float) -> DataFrame:
    """df prefixed, with the level of each row's own grid: the finest in which its box isn't too long."""
    x1, y1, x2, y2 = box(prefix)
    cells = F.greatest(F.greatest(x2 - x1, y2 - y1) + 2 * radius, F.lit(0.0)) / cell
    level = F.greatest(F.lit(0), F.ceil(F.log(float(MOST_CELLS), F.greatest(cells, F.lit(1.0))) - 1)).cast("int")
    # null where the box isn't finite; a filter would be pushed down and carry the box's expressions along
    size = F.abs(x1) + F.abs(y1) + F.abs(x2) + F.abs(y2)
    return prefixed(df, prefix).withColumn(f"{prefix}{LEVEL}", F.when(size < float("inf"), level))


def _at_levels(own: DataFrame, other: DataFrame, prefix: str, cell: float, radius: float) -> DataFrame:
    """own once for each cell that its box meets, in its own grid and in each coarser one that a row of other uses."""
    theirs = f"{'b_' if prefix == 'a_' else 'a_'}{LEVEL}"
    # at most one level for each six doublings of a box, so a few numbers
    used = F.broadcast(other.select(F.col(theirs).alias("used")).distinct().agg(F.sort_array(F.collect_set("used")).alias("used")))
    mine = F.col(f"{prefix}{LEVEL}")
    levels = F.when(mine.isNotNull(), F.array_distinct(F.concat(F.array(mine), F.filter(F.col("used"), lambda v: v > mine))))
    dealt = own.crossJoin(used).withColumn(LEVEL, F.explode(levels)).drop("used")
    x1, y1, x2, y2 = box(prefix)
    size = cell * F.pow(F.lit(float(MOST_CELLS)), F.col(LEVEL))
    over = lambda low, high: F.sequence(F.floor((low - radius) / size), F.floor((high + radius) / size))
    return dealt.withColumn(AT[0], F.explode(over(x1, x2))).withColumn(AT[1], F.explode(over(y1, y2)))


def grid_join(left: DataFrame, right: DataFrame, cell: float, radius: float = 0.0, keep: Column | None = None) -> DataFrame:
    """Pairs of rows whose boxes meet once the left one is widened by radius; columns a_* and b_*.

    Both sides have minx, miny, maxx, maxy; rows with a null or infinite one there match nothing. keep is a
    further predicate over a_* and b_*. cell should be about the size of a box
    plus twice the radius: smaller cells mean more copies, larger ones more pairs to test. A box that is longer than
    MOST_CELLS cells goes to a grid of larger cells, so none makes more than about MOST_CELLS squared copies; boxes
    of different grids meet in the coarser one.
    """
    l, r = _celled(left, "a_", cell, radius), _celled(right, "b_", cell, 0.0)  # noqa: E741
    a, b = box("a_"), box("b_")
    wide = (a[0] - radius, a[1] - radius, a[2] + radius, a[3] + radius)
    # each side is also dealt to the coarser grids that the other one uses, which are few
    l, r = _at_levels(l, r, "a_", cell, radius), _at_levels(r, l, "b_", cell, 0.0)  # noqa: E741
    size = cell * F.pow(F.lit(float(MOST_CELLS)), F.col(LEVEL))
    first = (F.col(AT[0]) == F.floor(F.greatest(wide[0], b[0]) / size)) & (F.col(AT[1]) == F.floor(F.greatest(wide[1], b[1]) / size))
    coarser = F.col(LEVEL) == F.greatest(f"a_{LEVEL}", f"b_{LEVEL}")
    # a sort-merge join compares by the first column alone where it can, so that which tells most rows apart, the grid's row, comes first
    cells = [AT[1], AT[0], LEVEL]
    r = r.withColumnsRenamed({c: f"b_{c} of the cell" for c in cells})
    met = reduce(Column.__and__, [F.col(c) == F.col(f"b_{c} of the cell") for c in cells])
    if keep is not None:
        met &= keep
    pairs = l.join(r, met & coarser & boxes_meet(wide, b) & first)
    return pairs.drop(*cells, *(f"b_{c} of the cell" for c in cells), f"a_{LEVEL}", f"b_{LEVEL}")


def corner_join(left: DataFrame, right: DataFrame, cell: float, most: float, keep: Column | None = None) -> DataFrame:
    """Pairs of rows whose boxes lie no farther apart than `most` at any side; columns a_* and b_*.

    Shapes within a Hausdorff distance are such pairs. They meet by their lower left corners alone, so that each row of right lies in one cell.
    """
    upper = {"maxx": "upper x of the box", "maxy": "upper y of the box"}
    made = [df.withColumns({name: F.col(c) for c, name in upper.items()} | {"maxx": F.col("minx"), "maxy": F.col("miny")}) for df in (left, right)]
    pairs = grid_join(*made, cell, most)
    for name in upper.values():
        pairs = pairs.where(F.abs(F.col(f"a_{name}") - F.col(f"b_{name}")) <= most)
    pairs = pairs.select(*(F.col(f"{k}_{upper.get(c, c)}").alias(f"{k}_{c}") for k, df in (("a", left), ("b", right)) for c in df.columns))
    return pairs if keep is None else pairs.where(keep)


def best_per(df: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order, which should be total."""
    return first_rows(df, [key] if isinstance(key, str) else key, order)


def nearest_within(left: DataFrame, right: DataFrame, cell: float, radius: float, distance: Column, tie: Column) -> DataFrame:
    """For each left row (by a_id) the right one at the least distance, at most radius; the column is `dist`."""
    pairs = grid_join(left, right, cell, radius).withColumn("dist", distance).where(F.col("dist") <= radius)
    return best_per(pairs, "a_id", F.col("dist"), tie)


def points(df: DataFrame) -> DataFrame:
    """df with x and y as boxes without extent."""
    return df.withColumns({"minx": F.col("x"), "miny": F.col("y"), "maxx": F.col("x"), "maxy": F.col("y")})
