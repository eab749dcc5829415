"""Queries through files: what sinks have written to the shared folder is checked, read back and compared with its table."""

from __future__ import annotations

import atexit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import commands
from lodestone.catalog import byte_id, query
from lodestone.operators import shards
from lodestone.plans.shards import _PACKED, _packed
from lodestone.session import drop, scratch, table
from lodestone.sources import records, sinks


def _folder(spark: SparkSession, tag: str) -> str:
    path = scratch(spark, tag)
    atexit.register(drop, path)
    return path


@query("SELECT doc_id AS ordinal, strlen(text)::INTEGER AS bytes, sha256(text) AS sha256 FROM documents")
def sample_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of all documents, written with hashes and a manifest, verified whole and read again."""
    path = _folder(spark, "sample")
    sinks.write_sample(table(spark, sf_dir, "documents"), path, "doc_id", "text")
    return records.checked_sample(spark, path).select("ordinal", F.octet_length("text").alias("bytes"), F.sha2("text", 256).alias("sha256"))


@query(f"""
    WITH RECURSIVE {_PACKED},
         b AS (SELECT doc_id, list_sum(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: {byte_id("('0x' || h)::INTEGER")})) + 2 AS ids FROM documents)
    SELECT split, shard, sum(tokens)::BIGINT AS tokens, sum(ids)::BIGINT AS sum_of_ids FROM packed JOIN b USING (doc_id) GROUP BY ALL""")
def shard_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' byte ids in 16-bit shards, verified whole and read again in pieces."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_append(shards.byte_tokens(F.col("text")), shards.EOS).alias("ids"), F.sha2(F.concat_ws(":", "doc_id", "text"), 256).alias("hash"))
    rows = docs.join(_packed(spark, sf_dir).select("split", "doc_id", "shard", "start"), "doc_id")
    path = _folder(spark, "shards")
    sinks.write_shards(rows, path, 264, document="hash", tokenizer="0" * 64)
    pieces = records.token_shards(spark, path, 4096).select("split", "shard", F.size("tokens").alias("n"), F.aggregate("tokens", F.lit(0).cast("long"), lambda s, x: s + x).alias("s"))
    return pieces.groupBy("split", "shard").agg(F.sum("n").cast("long").alias("tokens"), F.sum("s").cast("long").alias("sum_of_ids"))


@query("SELECT event_id, event_type, user_id FROM events")
def record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as canonical JSON lines with a digest over all of them, read again by a closed schema."""
    path = _folder(spark, "records")
    sinks.write_records(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), path, "event_id")
    return records.json_lines(spark, f"{path}/records", "event_id long, event_type string, user_id long")


@query("SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 100")
def first_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred records of a log in the order of its files and lines; the limit is the scan's own."""
    path = _folder(spark, "records")
    sinks.write_records(table(spark, sf_dir, "events").select("event_id", "event_type"), path, "event_id")
    return records.json_lines(spark, f"{path}/records", "event_id long, event_type string", max_records=100)


@query("""
    WITH s AS (SELECT event_id // 3 + 1 AS optimizer_step, arg_max(event_id, event_id) AS last FROM events GROUP BY 1)
    SELECT optimizer_step, (last % 100) / 8.0 AS loss, last + 1 AS tokens_consumed, 1::BIGINT AS measurement_optimizer_steps FROM s""")
def metric_log_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's log of canonical lines, three for each step, whose last one counts, as a typed series."""
    n = F.col("event_id")
    fields = {"event": F.lit("optimizer_step"), "recorded_at_utc": F.lit("2026-01-01T00:00:00Z"), "optimizer_step": F.floor(n / 3) + 1, "loss": (n % 100) / F.lit(8.0), "learning_rate": F.lit(0.001), "gradient_norm": F.lit(1.0), "tokens_consumed": n + 1, "elapsed_seconds": F.lit(0.5), "tokens_per_second": F.lit(16.0)}
    log, series = _folder(spark, "log"), _folder(spark, "series")
    sinks.write_records(table(spark, sf_dir, "events").select(*(c.alias(name) for name, c in fields.items())), log, "tokens_consumed")
    commands.materialize_metrics(spark, f"{log}/records", series)
    return spark.read.parquet(series).select("optimizer_step", "loss", "tokens_consumed", "measurement_optimizer_steps")


@query("SELECT l_orderkey, l_linenumber, o_totalprice AS reference FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def reference_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that were put by with what they were made from, and are looked up many to one."""
    path, binding = _folder(spark, "cache"), {"model": "a", "pairs": "orders"}
    sinks.write_cache(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("reference")), path, binding)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(records.read_cache(spark, path, binding), "l_orderkey")
