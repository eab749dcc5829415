"""Queries on the byte-pair tokenizer. Where SQL can't say a result, tests compare it with a naive version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.catalog import byte_id, query
from lodestone.functions import canonical
from lodestone.functions.symbols import BYTE_IDS, BYTES_FROM, byte_symbols
from lodestone.operators import digest, tokenizer
from lodestone.operators.chat import SPECIAL_IDS
from lodestone.operators.shards import byte_tokens
from lodestone.session import table

#: A run of white space is cut before its last character by a mark, as this engine's patterns can't look ahead.
_SEGMENTS = r"""
    m AS (SELECT doc_id, regexp_replace(text, '(\s+)(\s\S)', '\1' || chr(1) || '\2', 'g') AS t FROM documents),
    seg AS (SELECT doc_id, unnest(regexp_extract_all(t, '''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\x01\p{L}\p{N}]+|\s+')) AS segment FROM m)"""


@query(f"WITH {_SEGMENTS} SELECT doc_id, count(*)::INTEGER AS segments, sum(strlen(segment))::BIGINT AS bytes FROM seg GROUP BY doc_id")
def pretokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", tokenizer.pretokens(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").alias("segments"), F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x)).alias("bytes"))


@query(f"WITH {_SEGMENTS} SELECT segment, count(*) AS frequency FROM seg GROUP BY segment")
def segment_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.segment_frequencies(table(spark, sf_dir, "documents"), "text")


_COUNTS = f"""
    {_SEGMENTS.strip()}, f AS (SELECT hex(encode(segment)) AS h, count(*) AS frequency FROM seg GROUP BY segment),
    p AS (SELECT frequency, {byte_id("x")} AS "left", {byte_id("y")} AS "right" FROM (SELECT frequency, ('0x' || substr(h, 2 * i + 1, 2))::INTEGER AS x, ('0x' || substr(h, 2 * i + 3, 2))::INTEGER AS y FROM (SELECT *, unnest(range(0, length(h) // 2 - 1)) AS i FROM f))),
    counts AS (SELECT "left", "right", sum(frequency)::BIGINT AS count FROM p GROUP BY ALL)"""


@query(f"WITH {_COUNTS} SELECT * FROM counts")
def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.pair_counts(tokenizer.segment_frequencies(table(spark, sf_dir, "documents"), "text"))


@query(f'WITH {_COUNTS} SELECT * FROM counts ORDER BY count DESC, "left", "right" LIMIT 1')
def best_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.best_pair(tokenizer.pair_counts(tokenizer.segment_frequencies(table(spark, sf_dir, "documents"), "text")))


@query(f"WITH {_SEGMENTS} SELECT segment, count(*) AS frequency, ((strlen(segment) + strlen(replace(segment, 'en', ''))) // 2)::INTEGER AS ids FROM seg GROUP BY segment")
def merge_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of ids that are left of each segment when "e" and "n" are merged."""
    rows = tokenizer.segment_frequencies(table(spark, sf_dir, "documents"), "text")
    ids = tokenizer.merged(byte_tokens(F.col("segment")), BYTE_IDS[ord("e")], BYTE_IDS[ord("n")], 264)
    return rows.select("segment", "frequency", F.size(ids).alias("ids"))


def _trained(spark: SparkSession, sf_dir: str) -> tokenizer.BytePairs:
    return tokenizer.train(table(spark, sf_dir, "documents"), "text", 264 + 200)


@query()
def bpe_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _trained(spark, sf_dir)
    return spark.createDataFrame([(k, a, b, 264 + k, bytes(pairs.vocabulary[264 + k])) for k, (a, b) in enumerate(pairs.merges)], "rank int, left int, right int, new_id int, bytes binary")


@query()
def bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pretokens first, and back again."""
    pairs = _trained(spark, sf_dir)
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", tokenizer.encoded(spark, pairs, F.col("text")).alias("ids"))
    return rows.select("doc_id", F.size("ids").alias("tokens"), (tokenizer.decoded(spark, pairs, F.col("ids")) == F.col("text")).alias("round_trip"))


@query()
def bpe_encode_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text at once, as shards are built, and the end id."""
    pairs = _trained(spark, sf_dir)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array_append(tokenizer.encoded(spark, pairs, F.col("text"), whole=True), 2).alias("ids"))
    return rows.select("doc_id", F.size("ids").alias("tokens"), F.exists("ids", lambda t: t >= 264 + 200).alias("out_of_range"))


@query()
def bpe_special(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered conversations with their control strings as ids, and back again."""
    from lodestone.operators import chat

    pairs = _trained(spark, sf_dir)
    rows = chat.conversations(table(spark, sf_dir, "conversations")).select("conv_id", chat.rendered(F.col("messages")).alias("text"))
    rows = rows.select("conv_id", "text", tokenizer.encoded(spark, pairs, F.col("text"), special=tuple(SPECIAL_IDS)).alias("ids"))
    controls = F.size(F.filter("ids", lambda t: t < 8))
    return rows.select("conv_id", F.size("ids").alias("tokens"), controls.alias("controls"), (tokenizer.decoded(spark, pairs, F.col("ids"), render_special=True) == F.col("text")).alias("round_trip"))


@query("""
    SELECT count(*) AS documents, sha256(unhex(string_agg(lpad(lower(to_hex(strlen(coalesce(text, '')))), 16, '0') || hex(encode(coalesce(text, ''))), '' ORDER BY doc_id))) AS sha256 FROM documents""")
def stream_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.stream_digest(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT event_id, event_id % 3 = 0 AS canonical FROM events")
def canonical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines of a log are in canonical form: a third have a blank too many, a third have their keys in the wrong order."""
    kind = F.col("event_id") % 3
    line = F.when(kind == 0, F.format_string('{"event":"%s","step":%d}', "event_type", "event_id")).when(kind == 1, F.format_string('{"event": "%s","step":%d}', "event_type", "event_id")).otherwise(F.format_string('{"step":%d,"event":"%s"}', "event_id", "event_type"))
    from lodestone.ship import ship

    ship(spark)
    return table(spark, sf_dir, "events").select("event_id", canonical.is_canonical(line).alias("canonical"))


@query("""
    WITH t AS (SELECT '{"first":"<|bos|>","last":"<|eos|>","special_tokens":{"<|assistant|>":5,"<|bos|>":1,"<|end|>":6,"<|eos|>":2,"<|mask|>":7,"<|pad|>":0,"<|system|>":3,"<|user|>":4},"turn":"<|{role}|>{content}<|end|>","version":1}' AS template)
    SELECT template, sha256(template) AS sha256 FROM t""")
def template_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity of the chat template: SHA-256 of its canonical JSON."""
    template = {"special_tokens": SPECIAL_IDS, "turn": "<|{role}|>{content}<|end|>", "first": "<|bos|>", "last": "<|eos|>", "version": 1}
    return spark.createDataFrame([(canonical.canonical(template), canonical.digest(template))], "template string, sha256 string")


@query("""
    WITH b AS (SELECT i::INTEGER AS byte, i BETWEEN 33 AND 126 OR i BETWEEN 161 AND 172 OR i BETWEEN 174 AND 255 AS shown FROM range(0, 256) t(i)),
         c AS (SELECT byte, CASE WHEN shown THEN byte ELSE 255 + row_number() OVER (PARTITION BY shown ORDER BY byte) END AS point FROM b)
    SELECT byte, chr(point::INTEGER) AS symbol, (row_number() OVER (ORDER BY point) - 1)::INTEGER AS place FROM c""")
def byte_symbol_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, the printable characters that stand for them, and their places in the order of those."""
    return spark.createDataFrame([(b, s, BYTE_IDS[b] - BYTES_FROM) for b, s in enumerate(byte_symbols())], "byte int, symbol string, place int")


@query("""
    SELECT s::BIGINT::INTEGER AS seed, r::INTEGER AS rank, sha256('{"layers":6,"rank":0,"seed":' || s || '}') AS sha256 FROM range(1, 3) a(s), range(0, 2) b(r)""")
def config_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations whose rank is left out of their identity: all ranks have one hash."""
    own = [{"seed": s, "layers": 6, "rank": r, "compile": False} for s in (1, 2) for r in (0, 1)]
    return spark.createDataFrame([(c["seed"], c["rank"], canonical.config_digest(c, {"compile": False}, {"rank": 0})) for c in own], "seed int, rank int, sha256 string")
