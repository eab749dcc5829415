"""Queries on text records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.catalog import query
from lodestone.operators import text
from lodestone.session import table

POLICY = text.SplitPolicy(seed=1337, buckets=100, validation=10, test=10)
TARGET, CAP = 500_000, 300_000

_SPLIT = """
    h AS (SELECT doc_id, sha256(text) AS content_hash, strlen(text)::BIGINT AS bytes FROM documents WHERE strlen(text) > 0),
    s AS (SELECT *, (('0x' || substr(sha256('1337:' || content_hash), 1, 16))::UBIGINT % 100)::BIGINT AS bucket FROM h),
    split AS (SELECT *, CASE WHEN bucket < 10 THEN 'validation' WHEN bucket < 20 THEN 'test' ELSE 'train' END AS split FROM s)"""
_FLAGGED = """
    r AS (SELECT doc_id, sha256(text) AS content_hash, strlen(coalesce(text, ''))::BIGINT AS bytes FROM documents),
    k AS (SELECT *, bytes = 0 AS empty, bytes > 0 AND row_number() OVER (PARTITION BY content_hash, bytes > 0 ORDER BY doc_id) = 1 AS kept FROM r)"""


@query("""
    SELECT count(*) AS total, count(*) FILTER (WHERE text IS NULL) AS missing, count(*) FILTER (WHERE strlen(text) = 0) AS empty,
           count(*) FILTER (WHERE strlen(text) > 0) AS usable, coalesce(sum(strlen(text)), 0)::BIGINT AS bytes FROM documents""")
def text_row_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.octet_length("text")
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("total"), F.count_if(F.col("text").isNull()).alias("missing"), F.count_if(t == 0).alias("empty"), F.count_if(t > 0).alias("usable"), F.coalesce(F.sum(t), F.lit(0)).cast("long").alias("bytes"))


@query("""
    WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents),
         v AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN h WHEN 1 THEN upper(h) WHEN 2 THEN substr(h, 1, 63) ELSE 'z' || substr(h, 2) END AS value FROM h)
    SELECT doc_id, value, regexp_full_match(value, '[0-9a-f]{64}') AS valid FROM v""")
def hash_format_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = text.content_hash(F.col("text"))
    kind = F.col("doc_id") % 4
    value = F.when(kind == 0, h).when(kind == 1, F.upper(h)).when(kind == 2, F.substring(h, 1, 63)).otherwise(F.concat(F.lit("z"), F.substring(h, 2, 63)))
    return table(spark, sf_dir, "documents").select("doc_id", value.alias("value"), text.is_hash(value).alias("valid"))


@query(f"""
    WITH {_FLAGGED},
         c AS (SELECT *, sum(bytes) OVER (ORDER BY doc_id) AS cumulative FROM k WHERE kept),
         cut AS (SELECT min(doc_id) AS cut FROM c WHERE cumulative >= {TARGET}),
         seen AS (SELECT k.* FROM k, cut WHERE cut IS NULL OR doc_id <= cut)
    SELECT count(*) AS scanned, count(*) FILTER (WHERE kept) AS kept, count(*) FILTER (WHERE NOT kept AND NOT empty) AS duplicates, count(*) FILTER (WHERE empty) AS empties,
           coalesce(sum(bytes) FILTER (WHERE kept), 0)::BIGINT AS kept_bytes, max(doc_id) + 1 AS next_index FROM seen""")
def sample_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.budget_accounting(table(spark, sf_dir, "documents"), "text", "doc_id", TARGET)


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash FROM documents WHERE strlen(text) > 0 GROUP BY ALL ORDER BY 1")
def exact_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.first_occurrences(table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query(f"""
    WITH {_FLAGGED}, c AS (SELECT *, sum(bytes) OVER (ORDER BY doc_id)::BIGINT AS cumulative FROM k WHERE kept)
    SELECT doc_id, content_hash, bytes, cumulative FROM c WHERE cumulative - bytes < {TARGET}""")
def byte_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.budget_prefix(table(spark, sf_dir, "documents"), "text", "doc_id", TARGET)


@query(f"""
    WITH c AS (SELECT doc_id, strlen(text)::BIGINT AS bytes, sum(strlen(text)) OVER (ORDER BY doc_id)::BIGINT AS cumulative, row_number() OVER (ORDER BY doc_id) AS n FROM documents)
    SELECT doc_id, bytes, cumulative FROM c WHERE n <= 500 AND (cumulative <= {CAP} OR n = 1)""")
def corpus_cap_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.cap_prefix(table(spark, sf_dir, "documents"), "text", "doc_id", CAP, 500)


@query(f"WITH {_SPLIT} SELECT doc_id, content_hash, bucket, split FROM split")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").filter(F.octet_length("text") > 0)
    return text.hash_split(rows, "text", POLICY).select("doc_id", "content_hash", "bucket", "split")


@query(f"""
    WITH {_SPLIT}, d AS (SELECT *, bytes + 1 AS tokens FROM split QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) = 1)
    SELECT position, n.split, count(doc_id) AS documents, coalesce(sum(tokens), 0)::BIGINT AS tokens, coalesce(max(tokens), 0)::BIGINT AS largest, ceil(coalesce(sum(tokens), 0) / 100000.0)::BIGINT AS least_files
    FROM (VALUES (0, 'train'), (1, 'validation'), (2, 'test')) n(position, split) LEFT JOIN d ON n.split = d.split GROUP BY ALL""")
def split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact deduplication, hash split and statistics in one plan: a single shuffle of (hash, size)."""
    rows = table(spark, sf_dir, "documents").filter(F.octet_length("text") > 0)
    distinct = rows.groupBy(text.content_hash(F.col("text")).alias("content_hash")).agg(F.first(text.size(F.col("text"))).alias("bytes"))
    split = text.split_of(text.split_bucket(F.col("content_hash"), POLICY), POLICY)
    return text.split_statistics(distinct.withColumn("split", split), F.col("bytes") + 1, 100_000)


@query(f"""
    WITH {_FLAGGED}, c AS (SELECT row_number() OVER (ORDER BY doc_id) AS documents, sum(bytes) OVER (ORDER BY doc_id)::BIGINT AS written FROM k WHERE kept)
    SELECT documents, written, written <= 1000000 AS within FROM c WHERE documents % 50 = 0""")
def storage_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.storage_guard(table(spark, sf_dir, "documents"), "text", "doc_id", 1_000_000, 50)


@query(f"""
    WITH {_SPLIT}, m AS (SELECT split, count(*) AS documents, sum(bytes + 1)::BIGINT AS tokens, list(content_hash ORDER BY doc_id) AS hashes, sum(bytes) AS b FROM split GROUP BY split)
    SELECT split, split <> 'test' AS bytes_match, split <> 'validation' AS rows_match, split <> 'test' AS plain_name,
           len(list_distinct(hashes)) = len(hashes) AS unique_hashes, true AS valid_hashes FROM m""")
def manifest_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three manifests, one with wrong bytes and a folder in its name, one whose rows don't add up."""
    rows = text.hash_split(table(spark, sf_dir, "documents").filter(F.octet_length("text") > 0), "text", POLICY)
    made = rows.groupBy("split").agg(F.count("*").alias("kept"), F.sum(text.size(F.col("text")) + 1).alias("tokens"))
    wrong = F.when(F.col("split") == "test", 1).otherwise(0)
    lost = F.when(F.col("split") == "validation", 1).otherwise(0)
    return text.manifest_checks(made.withColumns({"bytes": 2 * F.col("tokens") + wrong, "scanned": F.col("kept") + 7 + lost, "duplicates": F.lit(4), "empties": F.lit(3), "filename": F.concat(F.when(wrong == 1, "a/").otherwise(""), F.col("split"), F.lit("-00000.json"))}), rows)


@query("SELECT doc_id, upper(lpad(printf('%x', strlen(text)), 16, '0')) AS prefix FROM documents")
def length_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 8-byte big-endian length that goes before a document in a stream digest."""
    return table(spark, sf_dir, "documents").select("doc_id", F.hex(F.unhex(F.lpad(F.hex(text.size(F.col("text"))), 16, "0"))).alias("prefix"))


@query("""
    SELECT doc_id, text AS body, lang, source, n_chars FROM documents WHERE lang = 'en' AND n_chars > 1000""")
def columnar_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five columns; both predicates reach the Parquet scan."""
    return table(spark, sf_dir, "documents").filter((F.col("lang") == "en") & (F.col("n_chars") > 1000)).select("doc_id", F.col("text").alias("body"), "lang", "source", "n_chars")
