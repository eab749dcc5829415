"""Chat, supervised and preference records: grammar, rendering, token blocks, truncation, padding and masks.

A conversation is an array of (role, content) structs in the order of its turns; its length is bounded by what a model
can read, so it is one row. Everything else is array functions on that row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.shards import byte_tokens

#: The reserved strings and their ids.
SPECIAL_IDS = {"<|pad|>": 0, "<|bos|>": 1, "<|eos|>": 2, "<|system|>": 3, "<|user|>": 4, "<|assistant|>": 5, "<|end|>": 6, "<|mask|>": 7}
IGNORE, PAD = -100, 0
ROLES = ("system", "user", "assistant")


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, messages): a row per conversation, messages in the order of turns."""
    own = F.array_sort(F.collect_list(F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("content"))))
    return turns.groupBy(id_col).agg(F.transform(own, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def has_reserved(content: Column) -> Column:
    out = F.lit(False)
    for mark in SPECIAL_IDS:
        out = out | F.contains(content, F.lit(mark))
    return out


def roles_of(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: m["role"]), ",")


def is_grammatical(messages: Column) -> Column:
    """An optional system turn, then user and assistant in turn; a system turn alone passes, too."""
    return F.coalesce(roles_of(messages).rlike("^((system,)?user(,assistant,user)*(,assistant)?|system)\\z"), F.lit(False))


def is_clean(messages: Column) -> Column:
    return ~F.exists(messages, lambda m: m["content"].isNull() | has_reserved(m["content"]))


def is_supervised(messages: Column) -> Column:
    """Grammatical, clean, and the last turn is the assistant's."""
    return is_grammatical(messages) & is_clean(messages) & F.coalesce(F.element_at(messages, -1)["role"] == "assistant", F.lit(False))


def rendered(messages: Column) -> Column:
    parts = F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>"), m["content"], F.lit("<|end|>")))
    return F.concat(F.lit("<|bos|>"), F.array_join(parts, ""), F.lit("<|eos|>"))


def _role_id(role: Column) -> Column:
    return F.when(role == "system", 3).when(role == "user", 4).otherwise(5)


def blocks(messages: Column, encode: Callable[[Column], Column] | None = None) -> Column:
    """(role, content ids) of each message; its block is the role's id, the content and the end id.

    encode: from an array of texts to the ids of each, as tokenizer.encoded_each() gives them; the ids of bytes without it.
    """
    if encode is None:
        return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), byte_tokens(m["content"]).alias("content")))
    ids = encode(F.transform(messages, lambda m: m["content"]))
    return F.zip_with(messages, ids, lambda m, x: F.struct(m["role"].alias("role"), x.alias("content")))


def _ids(block: Column) -> Column:
    return F.concat(F.array(_role_id(block["role"])), block["content"], F.array(F.lit(6)))


def _labels(block: Column) -> Column:
    own = F.concat(F.array(F.lit(IGNORE)), block["content"], F.array(F.lit(6)))
    return F.when(block["role"] == "assistant", own).otherwise(F.transform(own, lambda x: F.lit(IGNORE)))


def input_ids(parts: Column) -> Column:
    return F.concat(F.array(F.lit(1)), F.flatten(F.transform(parts, _ids)), F.array(F.lit(2)))


def labels(parts: Column) -> Column:
    """Assistant content and end ids; the end of the sequence counts where the assistant has the last word."""
    last = F.when(F.element_at(parts, -1)["role"] == "assistant", 2).otherwise(IGNORE)
    return F.concat(F.array(F.lit(IGNORE)), F.flatten(F.transform(parts, _labels)), F.array(last))


def prefix_ids(parts: Column) -> Column:
    """What a model is given to answer the last of the blocks: they, and the mark that opens the assistant's."""
    return F.concat(F.array(F.lit(1)), F.flatten(F.transform(parts, _ids)), F.array(F.lit(5)))


def block_length(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda n, b: n + F.size(b["content"]) + 2)


def truncated(df: DataFrame, parts: str, budget: Column) -> DataFrame:
    """`parts` shortened from the left to `budget` ids; columns dropped_pairs, excess, fits.

    As few of the oldest (user, assistant) pairs go as make it fit, while four body blocks are left for each; then
    content goes, oldest first, the system turn's included, down to the bare marks. In closed form: the least number of
    pairs that fits or the most that may go, then each block loses what the blocks before it couldn't.
    """
    all_blocks = F.col(parts)
    first = F.when(F.element_at(all_blocks, 1)["role"] == "system", 1).otherwise(0)
    most = F.greatest(F.lit(0), F.floor((F.size(all_blocks) - first - 2) / 2).cast("int"))
    without = lambda k: F.concat(F.slice(F.col(parts), F.lit(1), F.col("_first")), F.slice(F.col(parts), F.col("_first") + 1 + 2 * k, F.greatest(F.size(parts) - F.col("_first") - 2 * k, F.lit(0))))
    rows = df.withColumns({"_first": first, "_most": most, "_budget": budget})
    fitting = F.filter(F.sequence(F.lit(0), F.col("_most")), lambda k: block_length(without(k)) <= F.col("_budget"))
    rows = rows.withColumn("dropped_pairs", F.coalesce(F.get(fitting, F.lit(0)), F.col("_most")))
    rows = rows.withColumn("_kept", without(F.col("dropped_pairs")))
    rows = rows.withColumn("excess", F.greatest(F.lit(0), block_length(F.col("_kept")) - F.col("_budget")))
    cut = F.aggregate(
        "_kept",
        F.struct(F.col("excess").alias("left"), F.slice("_kept", F.lit(1), F.lit(0)).alias("done")),
        lambda acc, b: F.struct(
            F.greatest(F.lit(0), acc["left"] - F.size(b["content"])).alias("left"),
            F.concat(acc["done"], F.array(F.struct(b["role"].alias("role"), F.slice(b["content"], F.least(acc["left"], F.size(b["content"])) + 1, F.size(b["content"])).alias("content")))).alias("done"),
        ),
    )
    rows = rows.withColumn("_cut", cut)
    return rows.withColumn(parts, F.col("_cut.done")).withColumn("fits", F.col("_cut.left") == 0).drop("_first", "_most", "_budget", "_kept", "_cut")


def padded(df: DataFrame, batch: str, ids: str, own_labels: str, length: int | None = None) -> DataFrame:
    """ids with 0, labels with -100 and a mask to the longest row of the batch, or to a fixed length."""
    from pyspark.sql import Window

    longest = F.lit(length) if length is not None else F.max(F.size(ids)).over(Window.partitionBy(batch))
    rows = df.withColumn("_to", longest).withColumn("_n", F.size(ids))
    gap = F.col("_to") - F.col("_n")
    return rows.withColumns({ids: F.concat(ids, F.array_repeat(F.lit(PAD), gap)), own_labels: F.concat(own_labels, F.array_repeat(F.lit(IGNORE), gap)), "mask": F.concat(F.array_repeat(F.lit(True), F.col("_n")), F.array_repeat(F.lit(False), gap))}).drop("_to", "_n")


def is_preference(chosen: Column, rejected: Column, chosen_score: Column, rejected_score: Column, prompt_id: Column) -> Column:
    """Two sides of two turns or more with one prompt that ends with the user, different answers of the assistant, finite scores."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    prompt = lambda m: F.slice(m, F.lit(1), F.greatest(F.size(m) - 1, F.lit(0)))
    last = lambda m: F.element_at(m, -1)
    ok = (prompt_id.isNotNull() & (prompt_id != "")) & (F.size(chosen) >= 2) & (F.size(rejected) >= 2)
    ok = ok & (prompt(chosen) == prompt(rejected)) & (F.element_at(chosen, -2)["role"] == "user") & (last(chosen)["role"] == "assistant") & (last(rejected)["role"] == "assistant")
    ok = ok & (last(chosen)["content"] != last(rejected)["content"]) & is_grammatical(chosen) & is_clean(chosen) & is_clean(rejected)
    return F.when((F.size(chosen) < 2) | (F.size(rejected) < 2), F.lit(False)).otherwise(F.coalesce(ok & finite(chosen_score) & finite(rejected_score), F.lit(False)))


def preference_sequences(df: DataFrame, prompt: str, chosen: str, rejected: str, max_length: int) -> DataFrame:
    """Prompt blocks and two answers (ids) to two sequences with one prompt, cut from the left.

    Each answer keeps its last ids; the longer answer sets the prompt's budget.
    """
    least = F.when(F.element_at(prompt, 1)["role"] == "system", 4).otherwise(2)
    room = F.lit(max_length - 4) - least
    tail = lambda c: F.when(F.size(c) <= room, F.col(c)).otherwise(F.slice(c, F.size(c) - room + 1, room))
    rows = df.withColumns({"_long": F.size(prompt), "_all": block_length(F.col(prompt)), "_long_answer": (F.size(chosen) > room) | (F.size(rejected) > room), chosen: tail(chosen), rejected: tail(rejected)})
    rows = truncated(rows, prompt, F.lit(max_length - 4) - F.greatest(F.size(chosen), F.size(rejected)))
    body = F.flatten(F.transform(prompt, _ids))
    rows = rows.withColumn("prefix_length", F.size(body) + 2).withColumn("truncated", F.col("_long_answer") | (F.col("_all") > block_length(F.col(prompt))))
    whole = lambda c: F.concat(F.array(F.lit(1)), body, F.array(F.lit(5)), F.col(c), F.array(F.lit(6), F.lit(2)))
    mask = lambda c: F.concat(F.array_repeat(F.lit(False), F.col("prefix_length")), F.array_repeat(F.lit(True), F.size(c) + 2))
    return rows.withColumns({"chosen_ids": whole(chosen), "rejected_ids": whole(rejected), "chosen_mask": mask(chosen), "rejected_mask": mask(rejected)}).drop("_long", "_all", "_long_answer")
