"""Structured Streaming over an event log: windows, sessions, deduplication, upserted snapshots and stateful cadence.

Event-time windows go beyond what run logs need; snapshots and cadence are their streaming forms. Every query runs with
availableNow over the files that are there, keeps its state and offsets in the shared folder, and can be run again from
its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators import metrics
from lodestone.session import scratch
from lodestone.ship import ship
from lodestone.sources import files


def read(spark: SparkSession, path: str, clock: str = "ts") -> DataFrame:
    """A stream over Parquet files of one schema; the clock becomes an instant, as watermarks ask for.

    The path goes in as a pattern, since a stream takes a single file no other way; a pattern finds folders, too.
    """
    schema = spark.read.parquet(path).schema
    path = path.rstrip("/")
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]").withColumn(clock, F.col(clock).cast("timestamp"))


def finished(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], None]) -> None:
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", scratch(stream.sparkSession, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()


def complete(stream: DataFrame) -> DataFrame:
    """The last state of an aggregating stream: each batch replaces the table, under a name of its own."""
    spark, top = stream.sparkSession, scratch(stream.sparkSession, "table")
    last: list[str] = []

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/{number}")
        last.append(f"{top}/{number}")

    finished(stream, "complete", each)
    return spark.read.parquet(last[-1]) if last else spark.createDataFrame([], stream.schema)


def updated(stream: DataFrame, *key: str) -> DataFrame:
    """The last state of each key of an aggregating stream: a batch writes the rows that it changed, and a batch that is run
    again replaces its own. State behind the watermark is freed."""
    spark, top = stream.sparkSession, scratch(stream.sparkSession, "table")
    finished(stream, "update", lambda batch, number: batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{top}/{number}"))
    if not files.exists(top):
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(stream.schema.add("_batch", "long")).parquet(f"{top}/*")
    return metrics.latest(rows, list(key), ["_batch"]).drop("_batch")


def appended(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that a stream has put out; a batch that is run again replaces its own rows."""
    spark, top = stream.sparkSession, scratch(stream.sparkSession, "table")
    finished(stream, mode, lambda batch, number: batch.write.mode("overwrite").parquet(f"{top}/batch={number}"))
    return spark.read.schema(stream.schema).parquet(f"{top}/batch=*")


def window_counts(events: DataFrame, key: str, size: str = "1 day", late: str = "2 days") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", size), key).agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return rows.select(F.col("window.start").alias("start"), key, "events", "value")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("events"))
    return rows.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def distinct(events: DataFrame, *key: str, late: str = "40 days") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(key))


def snapshot(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last record of each key, kept as a table that every batch is merged into; a record that comes again changes nothing."""
    spark, top = events.sparkSession, scratch(events.sparkSession, "snapshot")
    now: list[str] = []

    def each(batch: DataFrame, number: int) -> None:
        rows = metrics.latest(batch, key, order)
        if now:
            rows = metrics.latest(spark.read.parquet(now[-1]).unionByName(rows), key, order)
        rows.write.mode("overwrite").parquet(f"{top}/{number}")
        now.append(f"{top}/{number}")

    finished(events, "append", each)
    return spark.read.parquet(now[-1]) if now else spark.createDataFrame([], events.schema)


def cadence(events: DataFrame, key: str, clock: str, every_steps: int, every_seconds: float) -> DataFrame:
    """(key, step, clock, reason) of the steps at which a run saves; the state of a run is three numbers."""
    ship(events.sparkSession)

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        step, saved, at = state.get if state.exists else (0, None, None)
        out = []
        for c in pd.concat(batches).sort_values([clock, "event_id"])[clock]:
            c = c.timestamp()
            saved = c if saved is None else saved
            if at is not None and c < at:
                raise ValueError(f"the clock of {group[0]} goes back")
            step, at = step + 1, c
            due, late = step % every_steps == 0, c - saved >= every_seconds
            if due or late:
                saved = c
                out.append((str(group[0]), step, c, "step" if due else "time"))
        state.update((step, saved, at))
        yield pd.DataFrame(out, columns=[key, "step", "clock", "reason"])

    rows = events.select(key, clock, "event_id").groupBy(key)
    return rows.applyInPandasWithState(run, f"{key} string, step long, clock double, reason string", "step long, saved double, at double", "append", GroupStateTimeout.NoTimeout)
