"""Text records: accounting, exact deduplication, byte budgets, hash splits and their statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ordered import running_sum
from lodestone.session import saved

SPLITS = ("train", "validation", "test")


@dataclass(frozen=True)
class SplitPolicy:
    seed: int = 1337
    buckets: int = 10_000
    validation: int = 100
    test: int = 100


def size(text: Column) -> Column:
    """UTF-8 bytes."""
    return F.octet_length(text).cast("long")


def content_hash(text: Column) -> Column:
    """Lower-case SHA-256 of the UTF-8 bytes."""
    return F.sha2(text, 256)


def is_hash(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-f]{64}\\z"), F.lit(False))


def split_bucket(digest: Column, policy: SplitPolicy) -> Column:
    """The first 8 bytes of SHA-256 of "seed:hash", big-endian and unsigned, modulo the number of buckets."""
    seeded = F.sha2(F.concat(F.lit(f"{policy.seed}:"), digest), 256)
    return (F.conv(F.substring(seeded, 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(policy.buckets)).cast("long")


def split_of(bucket: Column, policy: SplitPolicy) -> Column:
    return F.when(bucket < policy.validation, "validation").when(bucket < policy.validation + policy.test, "test").otherwise("train")


def hash_split(df: DataFrame, text: str, policy: SplitPolicy) -> DataFrame:
    """content_hash, bucket and split of every row; a row's split depends on its content alone."""
    rows = df.withColumn("content_hash", content_hash(F.col(text)))
    return rows.withColumn("bucket", split_bucket(F.col("content_hash"), policy)).withColumn("split", split_of(F.col("bucket"), policy))


def first_occurrences(df: DataFrame, text: str, order: str) -> DataFrame:
    """Non-empty rows whose content no row before them in `order` has, one of each content. Only hash and order are shuffled to find them.

    Of copies that share an order, too, one stays, whichever comes; whole rows are shuffled only where there are such.
    """
    rows = df.filter(F.octet_length(text) > 0).withColumn("_hash", content_hash(F.col(text)))
    first = F.min(F.struct(F.col(order), F.col("_n"))).alias("_first")
    keys = rows.groupBy("_hash", order).agg(F.count("*").alias("_n")).groupBy("_hash").agg(first).select("_hash", F.col(f"_first.{order}").alias(order), "_first._n")
    keys = saved(keys, "contents")
    kept = rows.join(keys.select("_hash", order), ["_hash", order], "left_semi")
    return (kept if keys.filter("_n > 1").isEmpty() else kept.dropDuplicates(["_hash"])).select(*df.columns)


def flagged(df: DataFrame, text: str, order: str) -> DataFrame:
    """(order, bytes, empty, duplicate, kept): what becomes of each row when empty and repeated contents are passed over."""
    rows = df.select(order, size(F.coalesce(F.col(text), F.lit(""))).alias("bytes"), content_hash(F.col(text)).alias("content_hash"))
    first = rows.filter("bytes > 0").groupBy("content_hash").agg(F.min(order).alias("_first"))
    rows = rows.join(first, "content_hash", "left")
    return rows.select(order, "content_hash", "bytes", (F.col("bytes") == 0).alias("empty"), ((F.col("bytes") > 0) & (F.col(order) > F.col("_first"))).alias("duplicate"), ((F.col("bytes") > 0) & (F.col(order) == F.col("_first"))).alias("kept"))


def budget_prefix(df: DataFrame, text: str, order: str, target: int) -> DataFrame:
    """Kept rows in source order while the bytes before them are fewer than the target: (order, content_hash, bytes, cumulative)."""
    kept = saved(flagged(df, text, order).filter("kept"), "kept")  # read several times
    return running_sum(kept, order, F.col("bytes"), "cumulative").filter(F.col("cumulative") - F.col("bytes") < target).select(order, "content_hash", "bytes", "cumulative")


def budget_accounting(df: DataFrame, text: str, order: str, target: int) -> DataFrame:
    """One row: what a scan that stops at the row reaching the target has seen. Rows behind it are never counted."""
    rows = saved(flagged(df, text, order), "flagged")
    cut = running_sum(rows.filter("kept"), order, F.col("bytes"), "cumulative").filter(F.col("cumulative") >= target).agg(F.min(order).alias("_cut"))
    seen = rows.crossJoin(F.broadcast(cut)).filter(F.col("_cut").isNull() | (F.col(order) <= F.col("_cut")))  # one row
    count = lambda c: F.count_if(F.col(c)).cast("long")
    return seen.agg(F.count("*").alias("scanned"), count("kept").alias("kept"), count("duplicate").alias("duplicates"), count("empty").alias("empties"), F.coalesce(F.sum(F.when(F.col("kept"), F.col("bytes"))), F.lit(0)).cast("long").alias("kept_bytes"), (F.max(order) + 1).alias("next_index"))


def cap_prefix(df: DataFrame, text: str, order: str, cap: int, most_documents: int | None = None) -> DataFrame:
    """Rows in order up to a document limit whose running bytes stay within the cap; the first row always."""
    rows = df.select(order, size(F.col(text)).alias("bytes"))
    if most_documents is not None:
        rows = rows.orderBy(order).limit(most_documents)
    rows = running_sum(saved(rows, "sizes"), order, F.col("bytes"), "cumulative")
    return rows.filter((F.col("cumulative") <= cap) | (F.col("cumulative") == F.col("bytes")))


def split_statistics(df: DataFrame, tokens: Column, cap: int) -> DataFrame:
    """Documents, bytes and tokens of each split, in the fixed order, with zeros for empty splits."""
    spark = df.sparkSession
    names = spark.createDataFrame([(k, s) for k, s in enumerate(SPLITS)], "position int, split string")
    own = df.groupBy("split").agg(F.count("*").alias("documents"), F.sum(tokens).alias("tokens"), F.max(tokens).alias("largest"))
    out = F.broadcast(names).join(own, "split", "left")  # three rows
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("position", "split", zero("documents"), zero("tokens"), zero("largest"), F.ceil(F.coalesce(F.col("tokens"), F.lit(0)) / cap).cast("long").alias("least_files"))


def storage_guard(df: DataFrame, text: str, order: str, limit: int, every: int) -> DataFrame:
    """Bytes written when each `every`-th kept document is checked, and whether they are within the limit."""
    rows = saved(flagged(df, text, order).filter("kept").withColumn("_one", F.lit(1)), "kept")
    rows = running_sum(saved(running_sum(rows, order, F.col("bytes"), "written"), "written"), order, F.col("_one"), "documents")
    return rows.filter(F.col("documents") % every == 0).select("documents", "written", (F.col("written") <= limit).alias("within"))


def manifest_checks(manifests: DataFrame, members: DataFrame) -> DataFrame:
    """Invariants of build manifests (split, tokens, bytes, scanned, kept, duplicates, empties, filename) and of their
    members (split, content_hash): counted by key first, so no manifest's members ever meet in one task."""
    name = F.col("filename")
    counts = members.groupBy("split", "content_hash").agg(F.count("*").alias("_n"))
    hashes = counts.groupBy("split").agg((F.max("_n") == 1).alias("unique_hashes"), F.min(is_hash(F.col("content_hash"))).alias("valid_hashes"))
    return manifests.join(hashes, "split", "left").select(
        "split",
        (F.col("bytes") == 2 * F.col("tokens")).alias("bytes_match"),
        (F.col("scanned") == F.col("kept") + F.col("duplicates") + F.col("empties")).alias("rows_match"),
        (~name.contains("/") & ~name.contains("\\") & (name != "")).alias("plain_name"),
        F.coalesce("unique_hashes", F.lit(True)).alias("unique_hashes"),
        F.coalesce("valid_hashes", F.lit(True)).alias("valid_hashes"),
    )
