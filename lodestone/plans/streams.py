"""Streaming queries over the events, each run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.catalog import ORACLES, query
from lodestone.streaming import events


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.read(spark, f"{sf_dir}/events.parquet")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS events, round(sum(value), 6) AS value FROM events GROUP BY ALL")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events.updated(events.window_counts(_events(spark, sf_dir), "event_type"), "start", "event_type")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events", F.round("value", 6).alias("value"))


@query("""
    WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events),
         s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events FROM s GROUP BY user_id, session""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events.complete(events.sessions(_events(spark, sf_dir), "user_id"))
    return out.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")), "events")


@query("SELECT user_id, event_type, count(*) AS seen FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event of each user and type."""
    rows = events.appended(events.distinct(_events(spark, sf_dir), "user_id", "event_type"))
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("seen"))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def stream_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.snapshot(_events(spark, sf_dir).select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@query(ORACLES["checkpoint_cadence"])
def stream_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.appended(events.cadence(_events(spark, sf_dir), "user_id", "ts", 10, 172_800)).withColumn("clock", F.round("clock", 3))
