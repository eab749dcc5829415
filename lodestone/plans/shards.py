"""Queries on token shards. Tokens are bytes here, and one end token a document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.catalog import byte_id, query
from lodestone.operators import shards, text
from lodestone.plans.text import _SPLIT, POLICY
from lodestone.session import table

CAP, LENGTH, SEED, WORLD = 400_000, 4096, 19, 3

_PACKED = f"""
    {_SPLIT.strip()}, n AS (SELECT split, doc_id, bytes + 1 AS tokens, row_number() OVER (PARTITION BY split ORDER BY doc_id) AS i FROM split),
    packed AS (SELECT split, doc_id, tokens, i, 0::BIGINT AS shard, 0::BIGINT AS start, tokens AS fill FROM n WHERE i = 1
               UNION ALL SELECT n.split, n.doc_id, n.tokens, n.i, CASE WHEN p.fill + n.tokens > {CAP} THEN p.shard + 1 ELSE p.shard END,
                                CASE WHEN p.fill + n.tokens > {CAP} THEN 0 ELSE p.fill END, CASE WHEN p.fill + n.tokens > {CAP} THEN n.tokens ELSE p.fill + n.tokens END
               FROM packed p JOIN n ON n.split = p.split AND n.i = p.i + 1),
    sizes AS (SELECT split, shard, count(*) AS documents, sum(tokens)::BIGINT AS tokens FROM packed GROUP BY ALL)"""
_WINDOWS = f"{_PACKED}, win AS (SELECT split, shard, unnest(range(0, tokens - {LENGTH} + 1, {LENGTH})) AS start FROM sizes WHERE tokens >= {LENGTH} AND split = 'train')"


def _order(epoch: int) -> str:
    return f"""SELECT *, row_number() OVER (ORDER BY digest, stable_id) - 1 AS position FROM
        (SELECT split, shard, start, shard || ':' || start AS stable_id, sha256('{SEED}:{epoch}:' || shard || ':' || start) AS digest FROM win)"""


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.hash_split(table(spark, sf_dir, "documents").filter(F.octet_length("text") > 0), "text", POLICY)
    return shards.next_fit(rows.select("split", "doc_id", (text.size(F.col("text")) + 1).alias("tokens")), "split", "doc_id", "tokens", CAP, oversized=True)


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.windows(shards.shard_sizes(_packed(spark, sf_dir).filter("split = 'train'"), "split", "doc_id", "tokens"), LENGTH)


@query(f"WITH RECURSIVE {_PACKED} SELECT split, doc_id, tokens, shard, start FROM packed")
def next_fit_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


@query(f"WITH RECURSIVE {_PACKED} SELECT split, shard, documents, tokens, sum(documents) OVER (PARTITION BY split ORDER BY shard)::BIGINT AS next_document FROM sizes")
def document_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_sizes(_packed(spark, sf_dir), "split", "doc_id", "tokens")


@query(f"WITH RECURSIVE {_WINDOWS} SELECT split, shard, start FROM win")
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir)


@query(f"WITH RECURSIVE {_WINDOWS} SELECT stable_id, digest, position FROM ({_order(0)})")
def hash_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shuffled(_windows(spark, sf_dir), SEED, 0).select("stable_id", "digest", "position")


@query(f"WITH RECURSIVE {_WINDOWS} SELECT stable_id, position % {WORLD} AS rank, position // {WORLD} AS local_index FROM ({_order(0)})")
def rank_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.strided(shards.shuffled(_windows(spark, sf_dir), SEED, 0), WORLD).select("stable_id", "rank", "local_index")


@query(f"""
    WITH RECURSIVE {_WINDOWS}, o AS (SELECT 0 AS epoch, * FROM ({_order(0)}) UNION ALL SELECT 1 AS epoch, * FROM ({_order(1)})),
         r AS (SELECT *, position // {WORLD} AS local_index FROM o WHERE position % {WORLD} = 1),
         m AS (SELECT count(*) AS n FROM r WHERE epoch = 0),
         p AS (SELECT epoch, stable_id, local_index, epoch * n + local_index - (n - 5) AS place FROM r, m)
    SELECT epoch, stable_id, local_index, place // 4 AS batch, place % 4 AS row FROM p WHERE place >= 0 AND place < 12""")
def cursor_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of four from a cursor five windows before an epoch's end."""
    wins = _windows(spark, sf_dir)
    epochs = reduce(DataFrame.unionByName, (shards.strided(shards.shuffled(wins, SEED, e), WORLD).withColumn("epoch", F.lit(e)) for e in (0, 1)))
    n = epochs.filter("epoch = 0 and rank = 1").count()
    return shards.cursor_batches(epochs, 1, 0, n - 5, 4, 3, WORLD).select("epoch", "stable_id", "local_index", "batch", "row")


@query(f"""
    WITH RECURSIVE {_WINDOWS}, o AS (SELECT stable_id, position % {WORLD} AS rank FROM ({_order(0)}))
    SELECT rank, count(*) AS windows, count(DISTINCT stable_id) AS distinct_windows, (SELECT count(*) FROM win) AS all_windows FROM o GROUP BY rank""")
def rank_partition_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks are disjoint and cover all windows where their counts add up and none repeats."""
    wins = _windows(spark, sf_dir)
    ranks = shards.strided(shards.shuffled(wins, SEED, 0), WORLD)
    own = ranks.groupBy("rank").agg(F.count("*").alias("windows"), F.countDistinct("stable_id").alias("distinct_windows"))
    return own.crossJoin(F.broadcast(wins.agg(F.count("*").alias("all_windows"))))  # one row


@query("""
    WITH b AS (SELECT doc_id, n_chars, doc_id // 256 AS bucket FROM documents), p AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n_chars, doc_id) - 1 AS place FROM b)
    SELECT doc_id, n_chars, bucket, place::INTEGER AS place, place // 8 AS batch FROM p""")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.length_buckets(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 256, 8)


@query(f"SELECT doc_id, n::INTEGER + 1 AS tokens, 2 AS last_token, {byte_id('b')} AS first_token FROM (SELECT doc_id, strlen(text) AS n, ('0x' || substr(hex(encode(text)), 1, 2))::INTEGER AS b FROM documents WHERE strlen(text) > 0)")
def eos_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte ids and the end id; shown by length, first and last id. An empty text has no first id and no row."""
    rows = table(spark, sf_dir, "documents").filter(F.octet_length("text") > 0)
    ids = rows.select("doc_id", F.array_append(shards.byte_tokens(F.col("text")), shards.EOS).alias("ids"))
    return ids.select("doc_id", F.size("ids").alias("tokens"), F.element_at("ids", -1).alias("last_token"), F.element_at("ids", 1).alias("first_token"))


@query("SELECT doc_id, bool_or(c > 255) AS out_of_range FROM (SELECT doc_id, unnest(list_transform(string_split(text, ''), lambda x: unicode(x))) AS c FROM documents) GROUP BY doc_id")
def token_bound_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document holds a token outside a vocabulary of 256; tokens are code points here."""
    points = F.transform(F.split("text", ""), lambda c: F.ascii(c))
    return table(spark, sf_dir, "documents").filter(F.length("text") > 0).select("doc_id", F.exists(points, lambda t: t >= 256).alias("out_of_range"))


@query("""
    WITH c AS (SELECT o_orderkey AS optimizer_step, o_orderpriority = '1-URGENT' AS is_best FROM orders),
         r AS (SELECT *, row_number() OVER (ORDER BY optimizer_step DESC) AS n, is_best AND row_number() OVER (PARTITION BY is_best ORDER BY optimizer_step DESC) = 1 AS kept_as_best FROM c)
    SELECT optimizer_step, is_best, kept_as_best FROM r WHERE n <= 3 OR kept_as_best""")
def checkpoint_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.retained(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("optimizer_step"), (F.col("o_orderpriority") == "1-URGENT").alias("is_best")), 3)
