"""Queries on conversations. Tokens are bytes here. Arrays of ids are shown by SHA-256 of the comma-joined ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.catalog import byte_id, query
from lodestone.operators import chat
from lodestone.session import table

MAX, BUDGET = 1024, 1022

_BYTES = f"""
    t AS (SELECT conv_id, turn, role, text, CASE WHEN strlen(text) = 0 THEN [] ELSE list_transform(string_split(rtrim(regexp_replace(hex(encode(text)), '(..)', '\\1 ', 'g')), ' '), lambda h: {byte_id("('0x' || h)::INTEGER")}) END AS b FROM conversations),
    i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, CASE role WHEN 'system' THEN 3 WHEN 'user' THEN 4 ELSE 5 END AS rid FROM t),
    blk AS (SELECT *, [rid] || b || [6] AS ids, CASE WHEN role = 'assistant' THEN [-100] || b || [6] ELSE list_transform([rid] || b || [6], lambda x: -100) END AS lab FROM i)"""
_GRAMMAR = "regexp_full_match(string_agg(role, ',' ORDER BY turn), '(system,)?user(,assistant,user)*(,assistant)?|system')"
_RESERVED = "regexp_matches(text, '<\\|(pad|bos|eos|system|user|assistant|end|mask)\\|>')"
#: Every seventh conversation gets a reserved string, every fifth loses its first turn.
_SPOILT = "spoilt AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 7 = 3 AND turn = 1 THEN text || '<|end|>' ELSE text END AS text FROM conversations WHERE NOT (conv_id % 5 = 2 AND turn = 0))"


def _digest(ids: Column) -> Column:
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)


def _own(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversations(table(spark, sf_dir, "conversations"))


def _spoilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("not (conv_id % 5 = 2 and turn = 0)")
    return chat.conversations(rows.withColumn("text", F.expr("case when conv_id % 7 = 3 and turn = 1 then concat(text, '<|end|>') else text end")))


@query(f"WITH {_SPOILT} SELECT conv_id, NOT bool_or({_RESERVED}) AS clean FROM spoilt GROUP BY conv_id")
def chat_control_token_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spoilt(spark, sf_dir).select("conv_id", chat.is_clean(F.col("messages")).alias("clean"))


@query(f"WITH {_SPOILT} SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, {_GRAMMAR} AS legal FROM spoilt GROUP BY conv_id")
def conversation_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spoilt(spark, sf_dir).select("conv_id", chat.roles_of(F.col("messages")).alias("roles"), chat.is_grammatical(F.col("messages")).alias("legal"))


@query(f"WITH {_SPOILT} SELECT conv_id, {_GRAMMAR} AND NOT bool_or({_RESERVED}) AND last(role ORDER BY turn) = 'assistant' AS valid FROM spoilt GROUP BY conv_id")
def sft_valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spoilt(spark, sf_dir).select("conv_id", chat.is_supervised(F.col("messages")).alias("valid"))


@query("SELECT conv_id, '<|bos|>' || string_agg('<|' || role || '|>' || text || '<|end|>', '' ORDER BY turn) || '<|eos|>' AS rendered FROM conversations GROUP BY conv_id")
def chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own(spark, sf_dir).select("conv_id", chat.rendered(F.col("messages")).alias("rendered"))


@query(f"WITH {_BYTES} SELECT conv_id, (p - 1)::INTEGER AS position, role, len(ids)::INTEGER AS tokens, sha256(array_to_string(ids, ',')) AS ids, sha256(array_to_string(lab, ',')) AS labels FROM blk")
def sft_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _own(spark, sf_dir).select("conv_id", F.posexplode(chat.blocks(F.col("messages"))).alias("position", "block"))
    block = F.col("block")
    return rows.select("conv_id", "position", block["role"].alias("role"), F.size(chat._ids(block)).alias("tokens"), _digest(chat._ids(block)).alias("ids"), _digest(chat._labels(block)).alias("labels"))


_ASSEMBLED = "a AS (SELECT conv_id, [1] || flatten(list(ids ORDER BY p)) || [2] AS ids, [-100] || flatten(list(lab ORDER BY p)) || [CASE WHEN last(role ORDER BY p) = 'assistant' THEN 2 ELSE -100 END] AS labels FROM blk GROUP BY conv_id)"


@query(f"WITH {_BYTES}, {_ASSEMBLED} SELECT conv_id, len(ids)::INTEGER AS tokens, len(list_filter(labels, lambda x: x <> -100))::INTEGER AS supervised, sha256(array_to_string(ids, ',')) AS ids, sha256(array_to_string(labels, ',')) AS labels FROM a")
def sft_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _own(spark, sf_dir).select("conv_id", chat.blocks(F.col("messages")).alias("parts"))
    rows = rows.select("conv_id", chat.input_ids(F.col("parts")).alias("ids"), chat.labels(F.col("parts")).alias("labels"))
    return rows.select("conv_id", F.size("ids").alias("tokens"), F.size(F.filter("labels", lambda x: x != chat.IGNORE)).alias("supervised"), _digest(F.col("ids")).alias("ids"), _digest(F.col("labels")).alias("labels"))


_TRUNCATED = f"""
    body AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, bool_or(role = 'system' AND p = 1) OVER (PARTITION BY conv_id) AS sys FROM i),
    k AS (SELECT conv_id, unnest(range(0, greatest(0, (n - sys - 2) // 2) + 1)) AS k FROM (SELECT conv_id, any_value(n) AS n, any_value(sys)::INT AS sys FROM body GROUP BY conv_id)),
    len_k AS (SELECT k.conv_id, k.k, sum(len(b) + 2) AS total FROM k JOIN body USING (conv_id) WHERE NOT (p > sys::INT AND p <= sys::INT + 2 * k.k) GROUP BY k.conv_id, k.k),
    pick AS (SELECT conv_id, coalesce(min(k) FILTER (WHERE total <= {BUDGET}), max(k)) AS dropped FROM len_k GROUP BY conv_id),
    kept AS (SELECT body.*, dropped, sum(len(b) + 2) OVER (PARTITION BY conv_id) AS total, coalesce(sum(len(b)) OVER (PARTITION BY conv_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
             FROM body JOIN pick USING (conv_id) WHERE NOT (p > sys::INT AND p <= sys::INT + 2 * dropped)),
    cut AS (SELECT *, greatest(0, total - {BUDGET}) AS excess, least(len(b), greatest(0, greatest(0, total - {BUDGET}) - before)) AS lost FROM kept)"""


@query(f"""
    WITH {_BYTES}, {_TRUNCATED}
    SELECT conv_id, any_value(dropped)::INTEGER AS dropped_pairs, any_value(excess)::INTEGER AS excess, any_value(excess) <= sum(len(b)) AS fits,
           sha256(array_to_string([1] || flatten(list([rid] || b[lost + 1 :] || [6] ORDER BY p)) || [2], ',')) AS ids FROM cut GROUP BY conv_id""")
def left_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _own(spark, sf_dir).select("conv_id", chat.blocks(F.col("messages")).alias("parts"))
    rows = chat.truncated(rows, "parts", F.lit(BUDGET))
    return rows.select("conv_id", "dropped_pairs", "excess", "fits", _digest(chat.input_ids(F.col("parts"))).alias("ids"))


@query(f"WITH {_BYTES}, {_ASSEMBLED} SELECT conv_id, len(ids) > {MAX} AS overflows FROM a")
def overflow_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that the strict policy would refuse."""
    return _own(spark, sf_dir).select("conv_id", (chat.block_length(chat.blocks(F.col("messages"))) + 2 > MAX).alias("overflows"))


@query(f"""
    WITH {_BYTES}, {_ASSEMBLED}, m AS (SELECT *, conv_id // 8 AS batch, max(len(ids)) OVER (PARTITION BY conv_id // 8) AS width FROM a)
    SELECT conv_id, batch, width::INTEGER AS width, len(ids)::INTEGER AS attended, sha256(array_to_string(ids || list_transform(range(0, width - len(ids)), lambda x: 0), ',')) AS ids,
           sha256(array_to_string(labels || list_transform(range(0, width - len(ids)), lambda x: -100), ',')) AS labels FROM m""")
def pad_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _own(spark, sf_dir).select("conv_id", F.floor(F.col("conv_id") / 8).alias("batch"), chat.blocks(F.col("messages")).alias("parts"))
    rows = rows.select("conv_id", "batch", chat.input_ids(F.col("parts")).alias("ids"), chat.labels(F.col("parts")).alias("labels"))
    rows = chat.padded(rows, "batch", "ids", "labels")
    return rows.select("conv_id", "batch", F.size("ids").alias("width"), F.size(F.filter("mask", lambda x: x)).alias("attended"), _digest(F.col("ids")).alias("ids"), _digest(F.col("labels")).alias("labels"))


@query(f"""
    WITH {_BYTES}, {_ASSEMBLED}
    SELECT count(*) AS examples, sum(len(ids) - 1)::BIGINT AS predicted_tokens, count(*) FILTER (WHERE len(ids) > {MAX}) AS truncated FROM a""")
def example_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _own(spark, sf_dir).select((chat.block_length(chat.blocks(F.col("messages"))) + 2).alias("n"))
    return n.agg(F.count("*").alias("examples"), F.sum(F.col("n") - 1).cast("long").alias("predicted_tokens"), F.count_if(F.col("n") > MAX).alias("truncated"))


@query(f"""
    WITH {_BYTES}, u AS (SELECT *, max(p) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id) AS last FROM blk)
    SELECT conv_id, sha256(array_to_string([1] || flatten(list(ids ORDER BY p)) || [5], ',')) AS prefix, sum(len(ids))::INTEGER + 2 AS tokens FROM u WHERE p <= last GROUP BY conv_id""")
def chat_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is given to answer the last user turn."""
    messages = F.col("messages")
    last = F.size(messages) - F.array_position(F.reverse(F.transform(messages, lambda m: m["role"])), "user") + 1
    rows = _own(spark, sf_dir).filter(F.exists("messages", lambda m: m["role"] == "user")).select("conv_id", chat.blocks(F.slice(messages, F.lit(1), last.cast("int"))).alias("parts"))
    ids = chat.prefix_ids(F.col("parts"))
    return rows.select("conv_id", _digest(ids).alias("prefix"), F.size(ids).alias("tokens"))


#: A pair: the conversation up to its last user turn, its answer, and as the other side the answer reversed, or the same one.
_PAIRS = f"""
    u AS (SELECT *, max(p) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id) AS last, count(*) OVER (PARTITION BY conv_id) AS n FROM i),
    pairs AS (SELECT conv_id, last(text ORDER BY p) AS answer, CASE WHEN conv_id % 6 = 1 THEN last(text ORDER BY p) ELSE reverse(last(text ORDER BY p)) END AS other,
                     any_value(n) AS n, last(role ORDER BY p) AS final_role, CASE WHEN conv_id % 9 = 4 THEN 'nan'::DOUBLE ELSE conv_id / 10.0 END AS score, conv_id % 11 <> 5 AS same FROM u GROUP BY conv_id)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("messages")
    head = F.slice(m, F.lit(1), F.size(m) - 1)
    last = F.element_at(m, -1)
    other = F.when(F.col("conv_id") % 6 == 1, last["content"]).otherwise(F.reverse(last["content"]))
    asked = F.when(F.col("conv_id") % 11 != 5, head).otherwise(F.transform(head, lambda x: F.struct(x["role"].alias("role"), F.concat(x["content"], F.lit("!")).alias("content"))))
    return _own(spark, sf_dir).select("conv_id", m.alias("chosen"), F.concat(asked, F.array(F.struct(last["role"].alias("role"), other.alias("content")))).alias("rejected"), F.when(F.col("conv_id") % 9 == 4, float("nan")).otherwise(F.col("conv_id") / 10).alias("score"))


@query(f"""
    WITH {_BYTES}, {_PAIRS}
    SELECT conv_id, n >= 2 AND final_role = 'assistant' AND answer <> other AND same AND NOT isnan(score) AS valid FROM pairs""")
def preference_valid_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir)
    return rows.select("conv_id", chat.is_preference(F.col("chosen"), F.col("rejected"), F.lit(1.0), F.col("score"), F.col("conv_id").cast("string")).alias("valid"))


@query("SELECT conv_id, conv_id % 11 <> 5 OR count(*) = 1 AS same_prompt FROM conversations GROUP BY conv_id")
def prompt_prefix_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = lambda c: F.slice(c, F.lit(1), F.size(c) - 1)
    return _pairs(spark, sf_dir).select("conv_id", (head("chosen") == head("rejected")).alias("same_prompt"))


_PREFERENCE = f"""
    {_BYTES.strip()}, v AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS all_n, last_value(role) OVER (PARTITION BY conv_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM i),
    ans AS (SELECT conv_id, b AS answer FROM v WHERE p = all_n AND final = 'assistant' AND all_n >= 2),
    pr AS (SELECT v.*, all_n - 1 AS n, bool_or(role = 'system' AND p = 1) OVER (PARTITION BY conv_id) AS sys FROM v WHERE p < all_n AND final = 'assistant'),
    room AS (SELECT DISTINCT pr.conv_id, n, sys, 764 - CASE WHEN sys THEN 4 ELSE 2 END AS room, len(answer) AS al FROM pr JOIN ans USING (conv_id)),
    bud AS (SELECT *, 764 - least(al, room) AS budget FROM room),
    k AS (SELECT conv_id, unnest(range(0, greatest(0, (n - sys::INT - 2) // 2) + 1)) AS k FROM bud),
    len_k AS (SELECT k.conv_id, k.k, sum(len(b) + 2) AS total, any_value(budget) AS budget FROM k JOIN pr USING (conv_id) JOIN bud USING (conv_id) WHERE NOT (p > pr.sys::INT AND p <= pr.sys::INT + 2 * k.k) GROUP BY k.conv_id, k.k),
    pick AS (SELECT conv_id, coalesce(min(k) FILTER (WHERE total <= budget), max(k)) AS dropped FROM len_k GROUP BY conv_id),
    kept AS (SELECT pr.*, dropped, budget, room, al, sum(len(b) + 2) OVER (PARTITION BY conv_id) AS total, coalesce(sum(len(b)) OVER (PARTITION BY conv_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
             FROM pr JOIN pick USING (conv_id) JOIN bud USING (conv_id) WHERE NOT (p > pr.sys::INT AND p <= pr.sys::INT + 2 * dropped)),
    cut AS (SELECT *, least(len(b), greatest(0, greatest(0, total - budget) - before)) AS lost FROM kept),
    done AS (SELECT conv_id, flatten(list([rid] || b[lost + 1 :] || [6] ORDER BY p)) AS prompt, bool_or(lost > 0) OR any_value(dropped) > 0 OR any_value(al > room) AS truncated, any_value(room) AS room FROM cut GROUP BY conv_id)"""


@query(f"""
    WITH {_PREFERENCE}
    SELECT conv_id, len(prompt)::INTEGER + 2 AS prefix_length, truncated, sha256(array_to_string([1] || prompt || [5] || answer[greatest(0, len(answer) - room) + 1 :] || [6, 2], ',')) AS chosen_ids
    FROM done JOIN ans USING (conv_id)""")
def preference_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir).select("conv_id", "prefix_length", "truncated", _digest(F.col("chosen_ids")).alias("chosen_ids"))


@query(f"""
    WITH {_PREFERENCE}
    SELECT conv_id, least(len(answer), room)::INTEGER + 2 AS response_tokens, len(prompt)::INTEGER + 4 + least(len(answer), room)::INTEGER AS mask_length, len(prompt)::INTEGER + 3 AS first_response
    FROM done JOIN ans USING (conv_id)""")
def response_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sequences(spark, sf_dir)
    return rows.select("conv_id", F.size(F.filter("chosen_mask", lambda x: x)).alias("response_tokens"), F.size("chosen_mask").alias("mask_length"), F.array_position("chosen_mask", True).cast("int").alias("first_response"))


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("messages")
    rows = _own(spark, sf_dir).filter((F.size(m) >= 2) & (F.element_at(m, -1)["role"] == "assistant"))
    answer = chat.byte_tokens(F.element_at(m, -1)["content"])
    rows = rows.select("conv_id", chat.blocks(F.slice(m, F.lit(1), F.size(m) - 1)).alias("prompt"), answer.alias("chosen"), F.reverse(answer).alias("rejected"))
    return chat.preference_sequences(rows, "prompt", "chosen", "rejected", 768)
