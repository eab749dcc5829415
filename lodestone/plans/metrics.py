"""Queries on event logs: users stand for runs, and the order of their events for steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.catalog import query
from lodestone.operators import metrics
from lodestone.session import table

_STEPS = "st AS (SELECT user_id, event_id, event_type, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)"


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts", step.alias("step"))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def latest_per_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@query("""
    WITH s AS (SELECT user_id, date_diff('day', TIMESTAMP '2000-01-01', ts) - min(date_diff('day', TIMESTAMP '2000-01-01', ts)) OVER () + 1 AS step FROM events),
         d AS (SELECT DISTINCT user_id, step FROM s)
    SELECT user_id, count(*) AS steps, min(step) = 1 AND max(step) = count(*) AS contiguous FROM d GROUP BY user_id""")
def step_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a user was active on every day from the first one on."""
    events = table(spark, sf_dir, "events")
    first = events.agg(F.to_date(F.min("ts")).alias("first"))
    days = events.crossJoin(F.broadcast(first)).select("user_id", (F.datediff("ts", "first") + 1).cast("long").alias("step")).distinct()  # one row
    return metrics.gaps(days, "user_id", "step")


@query("SELECT ceil(event_id / 500.0)::BIGINT AS window, min(event_id) AS first_step, max(event_id) AS last_step, count(*) AS steps FROM events GROUP BY 1")
def telemetry_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.count_windows(table(spark, sf_dir, "events"), "event_id", 500)


@query("""
    SELECT event_id, 'train/' || tag AS tag, v AS value FROM (
        SELECT event_id, 'value' AS tag, value AS v FROM events UNION ALL SELECT event_id, 'double_value', value * 2 FROM events
        UNION ALL SELECT event_id, 'purchase_value', CASE WHEN event_type = 'purchase' THEN value END FROM events) WHERE v IS NOT NULL""")
def metrics_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "value", (F.col("value") * 2).alias("double_value"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("purchase_value"))
    return metrics.unpivoted(rows, "event_id", ["value", "double_value", "purchase_value"])


@query(f"WITH {_STEPS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY step DESC) AS n FROM st) SELECT user_id, round(avg(value), 9) AS mean_last_100, count(*) AS values FROM r WHERE n <= 100 GROUP BY user_id")
def mean_last_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.last_n_mean(_steps(spark, sf_dir), "user_id", "step", "value", 100).withColumn("mean_last_100", F.round("mean_last_100", 9))


@query(f"WITH {_STEPS} SELECT user_id, arg_min(value, step) AS first, arg_max(value, step) AS final, round(avg(value), 9) AS mean, count(*) AS steps FROM st GROUP BY user_id")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.run_summary(_steps(spark, sf_dir), "user_id", "step", "value").withColumn("mean", F.round("mean", 9))


@query("""
    SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) AS events,
           count(*) FILTER (WHERE event_type = 'purchase') = 1 AS one_purchase FROM events GROUP BY user_id""")
def event_lifecycle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_ = lambda t: F.count_if(F.col("event_type") == t)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(is_("click").alias("clicks"), is_("purchase").alias("purchases"), F.count("*").alias("events"), (is_("purchase") == 1).alias("one_purchase"))


@query(f"""
    WITH RECURSIVE {_STEPS}, c AS (SELECT user_id, step, epoch_us(ts) / 1e6 AS clock FROM st),
         f AS (SELECT user_id, step, clock, step % 10 = 0 AS due, false AS late, clock AS saved FROM c WHERE step = 1
               UNION ALL SELECT c.user_id, c.step, c.clock, c.step % 10 = 0, c.clock - f.saved >= 172800, CASE WHEN c.step % 10 = 0 OR c.clock - f.saved >= 172800 THEN c.clock ELSE f.saved END
               FROM f JOIN c ON c.user_id = f.user_id AND c.step = f.step + 1)
    SELECT user_id::VARCHAR AS user_id, step, round(clock, 3) AS clock, CASE WHEN due THEN 'step' ELSE 'time' END AS reason FROM f WHERE due OR late""")
def checkpoint_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _steps(spark, sf_dir).withColumn("clock", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return metrics.cadence(rows, "user_id", "step", "clock", 10, 172_800).withColumn("clock", F.round("clock", 3))


@query("SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k, event_id % 3 = 0 AS strict FROM events")
def json_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties by a closed schema; a second key makes a record invalid."""
    events = table(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(F.concat(F.rtrim(F.regexp_replace("props", r"\}\s*$", "")), F.lit(', "extra": 1}')))
    return events.select("event_id", F.from_json("props", "k long")["k"].alias("k"), metrics.parsed(line, "k long").isNotNull().alias("strict"))


@query("SELECT user_id, greatest(max(ts), max(CASE WHEN event_type = 'click' THEN ts END), max(CASE WHEN event_type = 'purchase' THEN ts END)) AS reported FROM events GROUP BY user_id")
def report_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda t: F.max(F.when(F.col("event_type") == t, F.col("ts")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.greatest(F.max("ts"), of("click"), of("purchase")).alias("reported"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS recorded_at_utc FROM events")
def utc_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")).alias("recorded_at_utc"))


@query("""
    WITH s AS (SELECT user_id, count(*) AS steps, sum(value) AS tokens, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM events GROUP BY user_id)
    SELECT user_id, steps, round(tokens * steps / seconds, 9) AS tokens_per_second FROM s WHERE seconds > 0""")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("steps"), F.sum("value").alias("tokens"), ((F.max(micros) - F.min(micros)) / 1e6).alias("seconds"))
    return s.filter("seconds > 0").select("user_id", "steps", F.round(F.col("tokens") * F.col("steps") / F.col("seconds"), 9).alias("tokens_per_second"))
