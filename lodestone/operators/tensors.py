"""Array operators: distributions, losses, filters of sampling, norms, rotations and scans, on rows with bounded arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def let(value: Column, body) -> Column:
    """body(value), with the value computed once instead of inside every inner loop."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def log_softmax(logits: Column) -> Column:
    """Stable: the largest logit is taken off before the exponentials."""
    norm = lambda most: most + F.log(total(F.transform(logits, lambda x: F.exp(x - most))))
    return let(F.array_max(logits), lambda most: let(norm(most), lambda n: F.transform(logits, lambda x: x - n)))


def softmax(logits: Column) -> Column:
    return F.transform(log_softmax(logits), F.exp)


def cross_entropy(rows: DataFrame, group: str, position: str, logits: str, label: str) -> DataFrame:
    """Mean loss of predicting each position's label from the logits before it; -100 is left out, and no label at all gives 0.

    rows: a row per position, so a long sequence is spread over tasks up to the window that brings neighbours together.
    """
    before = F.lag(logits).over(Window.partitionBy(group).orderBy(position))
    pairs = rows.withColumn("_logits", before).filter(F.col("_logits").isNotNull())
    loss = F.when(F.col(label) != -100, -F.get(log_softmax(F.col("_logits")), F.col(label)))
    out = pairs.withColumn("_loss", loss).groupBy(group).agg(F.sum("_loss").alias("_sum"), F.count("_loss").alias("predicted"))
    return out.select(group, (F.coalesce("_sum", F.lit(0.0)) / F.greatest("predicted", F.lit(1))).alias("loss"), "predicted")


def masked_logprob(rows: DataFrame, group: str, position: str, logits: str, token: str, mask: str) -> DataFrame:
    """The sum of log probabilities of the tokens under the mask, each from the logits before it."""
    before = F.lag(logits).over(Window.partitionBy(group).orderBy(position))
    pairs = rows.withColumn("_logits", before).filter(F.col("_logits").isNotNull() & F.col(mask))
    return pairs.groupBy(group).agg(F.sum(F.get(log_softmax(F.col("_logits")), F.col(token))).alias("logprob"), F.count("*").alias("tokens"))


def forward_kl(policy: Column, reference: Column) -> Column:
    """KL(policy || reference) of two arrays of logits."""
    return total(F.zip_with(log_softmax(policy), log_softmax(reference), lambda p, q: F.exp(p) * (p - q)))


def log_sigmoid(x: Column) -> Column:
    return F.when(x >= 0, -F.log1p(F.exp(-x))).otherwise(x - F.log1p(F.exp(x)))


def dpo(df: DataFrame, beta: float) -> DataFrame:
    """From policy_chosen, policy_rejected, reference_chosen, reference_rejected: margin, logit, rewards and loss."""
    c = F.col
    rows = df.withColumn("margin", (c("policy_chosen") - c("policy_rejected")) - (c("reference_chosen") - c("reference_rejected")))
    return rows.withColumns({"logit": beta * c("margin"), "chosen_reward": beta * (c("policy_chosen") - c("reference_chosen")), "rejected_reward": beta * (c("policy_rejected") - c("reference_rejected")), "loss": -log_sigmoid(beta * c("margin"))})


def corrupted(rows: DataFrame, group: str, position: str, eligible: str, uniform: str, time: str) -> DataFrame:
    """rows with `masked`: eligible positions whose draw is below the time; where a group has none, the one with the least draw."""
    hit = F.col(eligible) & (F.col(uniform) < F.col(time))
    any_hit = F.max(hit).over(Window.partitionBy(group))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col(eligible).desc(), uniform, position))
    return rows.withColumn("_hit", hit).withColumn("masked", F.col("_hit") | (~any_hit & F.col(eligible) & (place == 1))).drop("_hit")


def diffusion_loss(rows: DataFrame, group: str, eligible: str, masked: str, loss: str, time: str) -> DataFrame:
    """One row: the mean over groups with eligible positions of their 1/time-weighted loss by eligible position."""
    own = rows.groupBy(group).agg(F.count_if(eligible).alias("_n"), F.sum(F.when(F.col(masked), F.col(loss) / F.col(time))).alias("_sum"))
    per = own.withColumn("_loss", F.when(F.col("_n") > 0, F.coalesce("_sum", F.lit(0.0)) / F.col("_n")))
    return per.agg((F.coalesce(F.sum("_loss"), F.lit(0.0)) / F.greatest(F.count("_loss"), F.lit(1))).alias("loss"), F.count("_loss").alias("groups"))


def top_k(df: DataFrame, group: str, score: str, k: int) -> DataFrame:
    """Every candidate that ties with the k-th stays."""
    return df.withColumn("_rank", F.rank().over(Window.partitionBy(group).orderBy(F.desc(score)))).filter(F.col("_rank") <= k).drop("_rank")


def top_p(df: DataFrame, group: str, index: str, score: str, p: float) -> DataFrame:
    """Candidates, best first, ties by index, while the mass before them is below p; with `probability`."""
    most = F.max(score).over(Window.partitionBy(group))
    rows = df.withColumn("_e", F.exp(F.col(score) - most))
    rows = rows.withColumn("probability", F.col("_e") / F.sum("_e").over(Window.partitionBy(group)))
    before = Window.partitionBy(group).orderBy(F.desc(score), index).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_mass", F.coalesce(F.sum("probability").over(before), F.lit(0.0))).filter(F.round("_mass", 12) < p).drop("_e", "_mass")


def sampled(df: DataFrame, group: str, index: str, score: str, uniform: Column, temperature: float, k: int, p: float) -> DataFrame:
    """(group, greedy, drawn): the best candidate, and the one that a uniform number picks after temperature, top-k and top-p."""
    scaled = df.withColumn(score, F.col(score) / temperature)
    kept = top_p(top_k(scaled, group, score, k), group, index, score, p)
    share = F.col("probability") / F.sum("probability").over(Window.partitionBy(group))
    upto = Window.partitionBy(group).orderBy(F.desc(score), index).rowsBetween(Window.unboundedPreceding, 0)
    rows = kept.withColumn("_share", share).withColumn("_upto", F.sum("_share").over(upto)).withColumn("_u", uniform)
    greedy = F.min_by(index, F.struct(-F.col(score), F.col(index)))
    drawn = F.coalesce(F.min_by(index, F.when(F.round("_upto", 12) > F.col("_u"), F.col("_upto"))), F.max_by(index, "_upto"))
    return rows.groupBy(group).agg(greedy.alias("greedy"), drawn.alias("drawn"), F.count("*").alias("candidates"))


def until_end(ids: Column, end: int) -> Column:
    """Ids up to the first end id, which stays."""
    at = F.array_position(ids, end).cast("int")
    return F.when(at > 0, F.slice(ids, F.lit(1), at)).otherwise(ids)


def eligible(ids: Column, attended: Column, left_out: tuple[int, ...] = (0, 1)) -> Column:
    return F.zip_with(ids, attended, lambda i, a: a & ~i.isin(*left_out))


def rms_norm(values: Column, epsilon: float = 1e-6) -> Column:
    scale = F.sqrt(total(F.transform(values, lambda x: x * x)) / F.size(values) + epsilon)
    return let(scale, lambda s: F.transform(values, lambda x: x / s))


def rotated(values: Column, position: Column, dim: int, base: float = 10_000.0) -> Column:
    """Rotary positions: the halves of the vector are turned against each other by position / base^(2i / dim)."""
    half = dim // 2
    angle = lambda i: position * F.pow(F.lit(base), -2.0 * i / dim)
    at = lambda i: F.get(values, i)
    first = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: at(i) * F.cos(angle(i)) - at(i + half) * F.sin(angle(i)))
    second = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: at(i + half) * F.cos(angle(i)) + at(i) * F.sin(angle(i)))
    return F.concat(first, second)


def scan(steps: Column) -> Column:
    """A scalar state-space recurrence over structs (log_decay, b, x, c): state' = exp(log_decay) state + b x, output c state'."""
    start = F.struct(F.lit(0.0).alias("state"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        state = F.exp(s["log_decay"]) * acc["state"] + s["b"] * s["x"]
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(s["c"] * state)).alias("out"))

    return F.aggregate(steps, start, step)


