"""Closed forms: learning rates, reveal counts, parameter and FLOP accounting, matched budgets, run plans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def warmup_steps(total: int, fraction: float) -> int:
    return max(1, math.ceil(total * fraction))


def lr_multiplier(step: Column, total: int, fraction: float, least: float) -> Column:
    """Linear warm-up from the first step on, then a cosine down to `least`."""
    warm = warmup_steps(total, fraction)
    progress = F.least(F.lit(1.0), (step - warm) / F.lit(float(max(1, total - warm - 1))))
    return F.when(step < warm, (step + 1) / F.lit(float(warm))).otherwise(F.lit(least) + F.lit(1 - least) * 0.5 * (1 + F.cos(F.lit(math.pi) * progress)))


def reveals(step: Column, steps: Column, length: Column, schedule: Column) -> Column:
    """How many positions are open after `step` of `steps`: linear, or by a cosine."""
    progress = step / steps
    share = F.when(schedule == "linear", progress).otherwise(1 - F.cos(F.lit(math.pi) * progress / 2))
    return F.when(step == steps, length).otherwise(F.least(length, F.greatest(F.lit(1), F.ceil(length * share)))).cast("long")


def dense_accounting(df: DataFrame, sequence: int) -> DataFrame:
    """Parameters and forward FLOPs a token of a decoder with grouped key-value heads.

    df: vocab, hidden, layers, kv (key-value size), mlp (intermediate size).
    """
    c = F.col
    attention, mlp = c("layers") * (2 * c("hidden") * c("hidden") + 2 * c("hidden") * c("kv")), c("layers") * 3 * c("hidden") * c("mlp")
    norms, embeddings = c("layers") * (3 * c("hidden") + c("kv")) + c("hidden"), c("vocab") * c("hidden")
    return df.withColumns({"parameters": 2 * embeddings + attention + mlp + norms, "forward_flops": 2 * (attention + mlp + embeddings) + 4 * c("layers") * sequence * c("hidden")})


def state_space_accounting(df: DataFrame) -> DataFrame:
    """The same of a state-space model. df: vocab, hidden, layers, inner, groups, state, heads, kernel, bias (0 or 1)."""
    c = F.col
    into, out, embeddings = c("layers") * c("hidden") * (2 * c("inner") + 2 * c("groups") * c("state") + c("heads")), c("layers") * c("inner") * c("hidden"), c("vocab") * c("hidden")
    channels = c("inner") + 2 * c("groups") * c("state")
    small = c("layers") * channels * (c("kernel") + c("bias")) + c("layers") * 3 * c("heads") + c("layers") * (c("hidden") + c("inner")) + c("hidden")
    return df.withColumns({"parameters": 2 * embeddings + into + out + small, "forward_flops": 2 * (into + out + embeddings) + 2 * c("layers") * channels * c("kernel") + 6 * c("layers") * c("inner") * c("state")})


def bidirectional_accounting(df: DataFrame, sequence: int) -> DataFrame:
    """The same of a bidirectional transformer. df: vocab, hidden, layers, mlp."""
    c = F.col
    attention, mlp, embeddings = c("layers") * 4 * c("hidden") * c("hidden"), c("layers") * 3 * c("hidden") * c("mlp"), c("vocab") * c("hidden")
    return df.withColumns({"parameters": 2 * embeddings + attention + mlp + (2 * c("layers") + 1) * c("hidden"), "forward_flops": 2 * (attention + mlp + embeddings) + 4 * c("layers") * sequence * c("hidden")})


def matched_budget(df: DataFrame, reference_flops: str, own_flops: str, reference_tokens: str, step_tokens: int) -> DataFrame:
    """Steps and tokens with which a model spends the reference's training FLOPs, rounded up, and the ratio of both."""
    ceil_div = lambda a, b: F.floor((a + b - 1) / b).cast("long")
    total, own = (3 * F.col(reference_flops) * F.col(reference_tokens)).cast("decimal(38,0)"), (3 * F.col(own_flops)).cast("decimal(38,0)")
    rows = df.withColumn("_tokens", F.ceil(total / own).cast("long")).withColumn("steps", ceil_div(F.col("_tokens"), F.lit(step_tokens)))
    rows = rows.withColumn("tokens", F.col("steps") * step_tokens)
    ratio = own.cast("double") * F.col("tokens") / total.cast("double")
    return rows.withColumn("flop_ratio", ratio).withColumn("within_window", ratio.between(0.97, 1.03)).drop("_tokens")


def run_plan(df: DataFrame, keep: int) -> DataFrame:
    """From (parameters, forward_flops, tokens, rate): training FLOPs, checkpoint and retained bytes, seconds."""
    c = F.col
    return df.withColumns({"training_flops": (3 * c("forward_flops") * c("tokens")).cast("double"), "checkpoint_bytes": 12 * c("parameters"), "retained_bytes": 12 * c("parameters") * (keep + 1), "seconds": c("tokens") / c("rate")})
