"""Queries on selections and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.catalog import query
from lodestone.operators import selection
from lodestone.session import table

_VALID = "n_chars >= 200 and lang is not null"
_QUOTAS = """
    src AS (SELECT source, count(*) AS available_examples, CASE WHEN source IN ('src0', 'src1') THEN 0.25 WHEN source < 'src2' THEN 0.5 ELSE 1.0 END AS weight FROM documents GROUP BY source),
    m AS (SELECT *, 100 * (available_examples * weight::DECIMAL(20,10))::DECIMAL(38,6) / sum(available_examples * weight::DECIMAL(20,10)) OVER () AS exact FROM src),
    f AS (SELECT *, floor(exact)::BIGINT AS fl, exact - floor(exact) AS rest FROM m),
    quotas AS (SELECT source, available_examples, weight::DOUBLE AS weight, (fl + CASE WHEN row_number() OVER (ORDER BY round(rest::DOUBLE, 9) DESC, source) <= 100 - sum(fl) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM f)"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.when(F.col("source").isin("src0", "src1"), 0.25).when(F.col("source") < "src2", 0.5).otherwise(1.0)
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("available_examples")).withColumn("weight", weight)


@query("SELECT doc_id, source, sha256('2027:' || source || ':' || doc_id) AS digest FROM documents ORDER BY digest, source, doc_id LIMIT 100")
def hash_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.hash_topn(table(spark, sf_dir, "documents").select("doc_id", "source"), 100, 2027, "source", "doc_id")


@query(f"WITH {_QUOTAS} SELECT source, available_examples, weight, quota FROM quotas")
def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.largest_remainder(_sources(spark, sf_dir), 100, "source")


@query(f"""
    WITH {_QUOTAS}, r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents WHERE n_chars >= 200 AND lang IS NOT NULL)
    SELECT source, doc_id, rank::INTEGER AS rank, quota FROM r JOIN quotas USING (source) WHERE rank <= quota""")
def quota_first_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotas = selection.largest_remainder(_sources(spark, sf_dir), 100, "source")
    return selection.first_valid(table(spark, sf_dir, "documents"), quotas, "source", "doc_id", F.expr(_VALID)).select("source", "doc_id", "rank", "quota")


@query(f"""
    WITH {_QUOTAS}, d AS (SELECT doc_id, source, coalesce(n_chars >= 200 AND lang IS NOT NULL, false) AS valid FROM documents),
         r AS (SELECT *, row_number() OVER (PARTITION BY source, valid ORDER BY doc_id) AS rank FROM d),
         c AS (SELECT source, count(*) AS selected, max(doc_id) AS last, any_value(quota) AS quota FROM r JOIN quotas USING (source) WHERE valid AND rank <= quota GROUP BY source)
    SELECT source, selected, count(*) AS scanned, count(*) FILTER (WHERE NOT valid) AS rejected FROM d JOIN c USING (source) WHERE selected < quota OR doc_id <= last GROUP BY source, selected""")
def quota_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotas = selection.largest_remainder(_sources(spark, sf_dir), 100, "source")
    return selection.quota_scan(table(spark, sf_dir, "documents"), quotas, "source", "doc_id", F.expr(_VALID))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def holdout_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.holdout(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id")


@query("""
    WITH p AS (SELECT DISTINCT lang, source FROM documents), r AS (SELECT DISTINCT lang, source FROM documents WHERE doc_id % 37 = 0 UNION SELECT 'xx', 'src0')
    (SELECT *, 'missing' AS problem FROM (SELECT * FROM p EXCEPT SELECT * FROM r)) UNION ALL (SELECT *, 'extra' AS problem FROM (SELECT * FROM r EXCEPT SELECT * FROM p))""")
def plan_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned cells are all pairs of language and source; realised are those of some runs, and one that no plan has."""
    docs = table(spark, sf_dir, "documents").select("lang", "source", "doc_id")
    realized = docs.filter("doc_id % 37 = 0").select("lang", "source").unionByName(spark.createDataFrame([("xx", "src0")], "lang string, source string"))
    return selection.completeness(docs.select("lang", "source"), realized)


@query("""
    WITH f AS (SELECT DISTINCT 'shard-' || (doc_id % 40) AS name FROM documents WHERE doc_id % 40 <> 7), m AS (SELECT 'shard-' || i AS name FROM range(0, 38) t(i))
    SELECT coalesce(f.name, m.name) AS name, CASE WHEN m.name IS NULL THEN 'not listed' ELSE 'no file' END AS problem FROM f FULL JOIN m ON f.name = m.name WHERE f.name IS NULL OR m.name IS NULL""")
def orphan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("shard-"), c.cast("string")).alias("name")
    files = table(spark, sf_dir, "documents").filter("doc_id % 40 <> 7").select(name(F.col("doc_id") % 40))
    return selection.orphans(files, spark.range(38).select(name(F.col("id"))), "name")


@query("SELECT content_hash, count(DISTINCT shard) AS shards FROM (SELECT sha256(text) AS content_hash, doc_id % 8 AS shard FROM documents) GROUP BY 1 HAVING count(DISTINCT shard) > 1")
def cross_shard_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that several shards hold: pairs are made distinct first, then counted."""
    pairs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_hash"), (F.col("doc_id") % 8).alias("shard")).distinct()
    return pairs.groupBy("content_hash").agg(F.count("*").alias("shards")).filter("shards > 1")


@query("SELECT user_id, event_type, count(*) AS rows FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.repeated(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("""
    WITH d AS (SELECT 0 AS source_position, doc_id AS record, lang AS origin FROM documents WHERE lang = 'fr' UNION ALL SELECT 1, doc_id, lang FROM documents WHERE lang = 'de')
    SELECT source_position, record, origin, row_number() OVER (PARTITION BY source_position ORDER BY record)::INTEGER AS place FROM d""")
def mix_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractions joined in the order of their sources; the place counts inside a source."""
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents")
    part = lambda k, lang: docs.filter(F.col("lang") == lang).select(F.lit(k).alias("source_position"), F.col("doc_id").alias("record"), F.col("lang").alias("origin"))
    return part(0, "fr").unionByName(part(1, "de")).withColumn("place", F.row_number().over(Window.partitionBy("source_position").orderBy("record")))


_RANKED = """
    g AS (SELECT p_brand AS name, avg(l_discount) AS loss, avg(l_quantity) AS throughput FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
    k AS (SELECT *, row_number() OVER (ORDER BY round(loss, 9), name)::INTEGER AS position FROM g)"""


@query(f"""
    WITH {_RANKED}, s AS (SELECT *, row_number() OVER (ORDER BY round(throughput, 9) DESC, name) AS speed FROM k)
    SELECT name, round(loss, 9) AS loss, round(throughput, 9) AS throughput, position FROM s WHERE position <= 3 OR speed = 1""")
def finalist_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.operators.reports import ranked

    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    groups = rows.groupBy(F.col("p_brand").alias("name")).agg(F.round(F.avg("l_discount"), 9).alias("loss"), F.round(F.avg("l_quantity"), 9).alias("throughput"))
    return selection.finalists(ranked(groups, "loss", "name"), 3)


@query("""
    WITH c AS (SELECT vec_id, i - 1 AS index, embedding[i]::DOUBLE AS confidence FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
         r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY confidence, index) AS low, row_number() OVER (PARTITION BY vec_id ORDER BY confidence DESC, index) AS high FROM c)
    SELECT vec_id, index::INTEGER AS index, confidence, low <= 4 AS lowest, high <= 4 AS highest FROM r WHERE low <= 4 OR high <= 4""")
def confidence_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("index", "confidence"))
    return selection.confidence_extremes(rows, "vec_id", "index", "confidence", 4)
