"""Jobs over tiles that can be broken off and go on.

Tiles are worked on in batches. A batch's rows are written to a folder of their own, and after them its
manifest: the tiles and how many rows each has. Spark's writers put files in
place by renaming, so a manifest's files are there whole or not at all; each line of one tells of a tile whose rows are all
written, so it holds without the others, and rows of tiles without one don't count. A restart looks at the manifests and runs only the tiles that none lists. Before tiles are put
together the rows are counted again and compared.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweld.functions.geometry import BOX
from geoweld.operators.naming import first_rows, row_digest
from geoweld.operators.relational import with_row_numbers

MANIFEST = "tile_id string, n long, batch string"
#: How tiles are joined: they are short rows, but as many as the area asks for, so they don't go through the driver.
JOIN = "merge"


def finished(spark: SparkSession, folder: str) -> DataFrame:
    """tile_id, n, batch of the tiles that are done; of one done twice, as by jobs side by side, the first batch in order counts."""
    try:
        found = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    except AnalysisException:  # no batch has ended yet
        found = spark.createDataFrame([], MANIFEST)
    return first_rows(found, ["tile_id"], ["batch"])


def run_tiles(tiles: DataFrame, build: Callable[[DataFrame], DataFrame], folder: str, batch_tiles: int = 1000, most_batches: int | None = None, order: Sequence[str] = ("tile_id",)) -> int:
    """Work on the tiles (tile_id, ...) that aren't done yet, and tell how many batches it took.

    build makes the rows, with tile_id, of a DataFrame of tiles, in one plan over all of a batch's. A job ends early after most_batches, or when
    build fails; called again it goes on. Tiles without rows are done too. Batches take the tiles in their order, which should be total; where that is
    by place, a batch's tiles lie together, and build can leave out what is far from all of them before it moves anything.
    """
    spark = tiles.sparkSession
    left = tiles.hint(JOIN).join(finished(spark, folder).select("tile_id"), "tile_id", "left_anti")
    numbered = with_row_numbers(left, order, "number").withColumn("turn", F.floor((F.col("number") - 1) / batch_tiles)).drop("number")
    turns = numbered.agg(F.max("turn")).first()[0]
    turns = 0 if turns is None else int(turns) + 1
    for turn in range(turns if most_batches is None else min(turns, most_batches)):
        batch = uuid.uuid4().hex
        some = numbered.where(F.col("turn") == turn).drop("turn")
        place = f"{folder}/rows/batch={batch}"
        build(some).write.parquet(place)
        counts = spark.read.parquet(place).groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"))
        done = some.select("tile_id").hint(JOIN).join(counts, "tile_id", "left").select("tile_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
        # as many files as it takes: put into one partition, the join before it would run in one task, whose sorts keep their memory until it ends
        done.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{folder}/manifest")
    return turns


def tile_rows(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of all tiles that are done, with tile_id; an error if they aren't as many as the manifests say."""
    done = finished(spark, folder)
    rows = spark.read.schema(f"{schema}, batch string").parquet(f"{folder}/rows").hint(JOIN).join(done.select("tile_id", "batch"), ["tile_id", "batch"], "left_semi").drop("batch")
    counts = rows.groupBy("tile_id").agg(F.count(F.lit(1)).alias("found"))
    wrong = done.hint(JOIN).join(counts, "tile_id", "left").where(F.col("n") != F.coalesce("found", F.lit(0))).limit(5).collect()
    if wrong:
        raise ValueError(f"tiles whose rows aren't those of their manifest: {[(r['tile_id'], r['n'], r['found']) for r in wrong]}")
    return rows


def owned(rows: DataFrame, tiles: DataFrame) -> DataFrame:
    """The rows, with a box, whose middle lies in their own tile: left and lower side included, the others too where no tile follows."""
    t = tiles.select("tile_id", *(F.col(c).alias(f"tile {c}") for c in BOX))
    edges = tiles.agg(F.max("maxx").alias("top x"), F.max("maxy").alias("top y"))
    inside = F.lit(True)
    for c in "xy":
        at = (F.col(f"min{c}") + F.col(f"max{c}")) / 2
        inside &= (at >= F.col(f"tile min{c}")) & ((at < F.col(f"tile max{c}")) | ((at == F.col(f"tile max{c}")) & (F.col(f"tile max{c}") == F.col(f"top {c}"))))
    return rows.hint(JOIN).join(t, "tile_id").crossJoin(F.broadcast(edges)).where(inside).select(*rows.columns)


def stitched(rows: DataFrame, tiles: DataFrame, key: str) -> DataFrame:
    """The rows of all tiles put together: each from the tile that owns it, and once for each key, the row of the smallest digest."""
    mine = owned(rows, tiles)
    return first_rows(mine, [key], [row_digest(mine)])


def evidence(spark: SparkSession, folder: str, rows: DataFrame, whole: DataFrame) -> DataFrame:
    """One row: tiles done, batches, rows written and rows after they were put together."""
    done = finished(spark, folder).agg(F.count(F.lit(1)).alias("tiles"), F.count_distinct("batch").alias("batches"), F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("rows_in_manifest"))
    counts = [df.agg(F.count(F.lit(1)).alias(name)) for df, name in ((rows, "rows_written"), (whole, "rows_stitched"))]
    return done.crossJoin(counts[0]).crossJoin(counts[1])
