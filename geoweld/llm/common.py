"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweld.operators.components import checkpointed, shared_folder  # noqa: F401
from geoweld.operators.naming import free_name  # noqa: F401

#: While texts go to Python and the result is kept at once: batches of a few MB, however long the texts are.
SMALL_BATCHES = {"spark_sql_execution_arrow_maxBytesPerBatch": "4194304"}

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for a null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


@contextmanager
def session_settings(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Runtime settings of Spark SQL, underscores for dots, that hold within."""
    names = {k.replace("_", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
