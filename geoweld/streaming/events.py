"""Micro-batch intake, windows and timeouts over a stream of events."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from geoweld.operators.components import checkpointed, shared_folder
from geoweld.operators.naming import first_rows


def deduplicated(stream: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each key; a key is remembered until the watermark passes it."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, at: str, key: str, size: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Count and sum of `value` for each window and key; late rows beyond the watermark are left out."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, size, slide) if slide else F.window(at, size), key).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")
    )


def sessions(stream: DataFrame, at: str, key: str, gap: str, delay: str = "1 hour") -> DataFrame:
    """Count of rows for each session of a key: rows no more than gap apart."""
    return stream.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("session"), key).agg(F.count(F.lit(1)).alias("n"))


def run_available(spark: SparkSession, source: DataFrame, plan: Callable[[DataFrame], DataFrame], mode: str, keys: list[str] | None = None) -> DataFrame:
    """What plan makes of all that source's stream has now: written to Parquet in the shared folder and read back.

    In complete mode a batch takes the place of the one before. In update mode each batch has a folder of its own, which a batch that is
    run again replaces, and the row of each of keys from the latest batch holds.
    """
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys of its rows")
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    made = plan(source)
    writer = made.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        started = writer.outputMode("append").format("parquet").option("path", f"{folder}/rows").start()
    else:
        of_batch = (lambda n: f"/batch={n}") if mode == "update" else (lambda n: "")
        started = writer.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/rows{of_batch(n)}")).start()
    started.awaitTermination()
    if mode == "update":
        rows = spark.read.parquet(f"{folder}/rows")
        return first_rows(rows, keys, [F.col("batch").desc()]).select(*made.columns)
    return spark.read.schema(made.schema).parquet(f"{folder}/rows")


def intake(spark: SparkSession, source: DataFrame, folder: str, schema: str, key: str, required: Sequence[str]) -> dict[str, DataFrame]:
    """What the JSON texts (value) that source's stream has now come to: taken, refused, repeated and ledger.

    The given text is `document` there. One that can't be read, or lacks a required field, is refused with its reason; of texts with one key the
    first in order is taken and the others are repeated, ones taken by earlier batches included. Every batch writes
    all of it, and its counts into the ledger, to folders of its own, which it replaces when it is run again, and looks at batches before it only; so
    a batch that breaks off and runs again changes nothing. Later calls with the folder go on where the last one ended.
    """
    broken = "what can't be read"
    fields = T.StructType.fromDDL(schema)
    readable = T.StructType([*fields.fields, T.StructField(broken, T.StringType())])
    places = {name: f"{folder}/{name}" for name in ("taken", "refused", "repeated", "ledger")}

    def batch(df: DataFrame, n: int) -> None:
        read = df.select(F.col("value").alias("document"), F.from_json("value", readable, {"columnNameOfCorruptRecord": broken}).alias("row"))
        row = lambda c: F.col("row")[c]
        reason = F.when(F.col("document").isNull() | row(broken).isNotNull() | F.col("row").isNull(), F.lit("unreadable"))
        for c in dict.fromkeys((key, *required)):
            reason = reason.when(row(c).isNull(), F.lit(f"without {c}"))
        told = checkpointed(read.withColumn("reason", reason))
        told.where("reason IS NOT NULL").select("document", "reason").write.mode("overwrite").parquet(f"{places['refused']}/batch={n}")
        good = told.where("reason IS NULL").select("document", *(row(c).alias(c) for c in fields.names))
        turn = F.row_number().over(Window.partitionBy(key).orderBy("document"))
        numbered = good.withColumn("turn", turn)
        if n:
            kept = spark.read.schema(f"{schema}, batch long").parquet(places["taken"]).where(F.col("batch") < n).select(key).distinct()
            numbered = numbered.join(kept.withColumn("known", F.lit(True)), key, "left")
        else:
            numbered = numbered.withColumn("known", F.lit(None).cast("boolean"))
        numbered = checkpointed(numbered)
        fresh = F.col("known").isNull() & (F.col("turn") == 1)
        numbered.where(fresh).select(*fields.names).write.mode("overwrite").parquet(f"{places['taken']}/batch={n}")
        numbered.where(~fresh).select("document", key).write.mode("overwrite").parquet(f"{places['repeated']}/batch={n}")
        counts = numbered.agg(F.count_if(fresh).alias("taken"), F.count_if(~fresh).alias("repeated")).crossJoin(told.agg(F.count_if(F.col("reason").isNotNull()).alias("refused")))
        counts.write.mode("overwrite").parquet(f"{places['ledger']}/batch={n}")

    source.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
    schemas = {"taken": schema, "refused": "document string, reason string", "repeated": f"document string, {key} {fields[key].dataType.simpleString()}", "ledger": "taken long, repeated long, refused long"}
    return {name: spark.read.schema(f"{schemas[name]}, batch long").parquet(place) for name, place in places.items()}


def due_and_expired(jobs: DataFrame, now: str) -> DataFrame:
    """jobs with `state`: expired once its window has ended, else due from its next retry on, else waiting."""
    t = F.lit(now).cast("timestamp")
    state = F.when(F.col("window_ends") <= t, "expired").when(F.col("next_retry") <= t, "due").otherwise("waiting")
    return jobs.withColumn("state", state)


def timed_out(stream: DataFrame, run: str, at: str, seconds: int, delay: str) -> DataFrame:
    """run_id, last_seen of each run of whose events none came within so many seconds of event time after the last, as the watermark passes it.

    The state of a run is the time of its last event; its timer moves on with each of them, and
    an event after a timeout starts it anew.
    """
    micros = F.unix_micros(at)

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"run_id": [key[0]], "last": [last]})
            return
        last = max(int(pdf["micros"].max()) for pdf in batches)
        if state.exists:
            last = max(last, state.get[0])
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + 1000 * seconds, state.getCurrentWatermarkMs() + 1))

    seen = stream.withWatermark(at, delay).select(F.col(run).alias("run_id"), F.col(at).alias("at"), micros.alias("micros"))
    found = seen.groupBy("run_id").applyInPandasWithState(watch, "run_id long, last long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("run_id", F.timestamp_micros("last").alias("last_seen"))


def stale(runs: DataFrame, now: str, seconds: int = 300) -> DataFrame:
    """Runs whose last sign of life is at least that old, the oldest first."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last_seen")
    return runs.withColumn("age", age).where(F.col("age") >= seconds).orderBy("last_seen", "run_id")
