"""Reports over runs: summaries, ranks, gates, tolerances, and joins of plans with results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import saved


def ranked(df: DataFrame, loss: str, name: str, position: str = "position", throughput: str | None = None) -> DataFrame:
    """Positions from 1 by loss, and throughput_rank by throughput downwards, ties by name; for summaries, a row a variant."""
    rows = df.withColumn(position, F.row_number().over(Window.orderBy(loss, name)))
    return rows if throughput is None else rows.withColumn("throughput_rank", F.row_number().over(Window.orderBy(F.desc(throughput), name)))


def spread(value: Column) -> Column:
    """Sample standard deviation; 0 for a single value."""
    return F.coalesce(F.stddev_samp(value), F.when(F.count(value) > 0, 0.0))


def summary(df: DataFrame, group: str, value: str, optional: str) -> DataFrame:
    """Mean and deviation of a metric, and of an optional one only where no row lacks it."""
    whole = F.count(optional) == F.count("*")
    return df.groupBy(group).agg(F.count("*").alias("seeds"), F.avg(value).alias("mean"), spread(F.col(value)).alias("deviation"), F.when(whole, F.avg(optional)).alias("optional_mean"), F.when(whole, spread(F.col(optional))).alias("optional_deviation"))


def calibration(results: DataFrame, baseline: str, speedup: float, most_spread: float, tolerances: dict[str, float]) -> DataFrame:
    """Per (architecture, cell): medians, speed-up over the baseline, spread, and the gates for promotion.

    results: architecture, cell, throughput and one column per tolerance. A baseline has no deviation of its own.
    """
    cells = results.groupBy("architecture", "cell").agg(F.median("throughput").alias("median"), ((F.max("throughput") - F.min("throughput")) / F.median("throughput")).alias("spread"), *(F.max(c).alias(c) for c in tolerances))
    base = cells.filter(F.col("cell") == baseline).select("architecture", F.col("median").alias("baseline_median"), F.col("spread").alias("baseline_spread"))
    rows = cells.join(base, "architecture")  # a row a cell
    is_base = F.col("cell") == baseline
    parity = F.lit(True)
    for c, most in tolerances.items():
        parity = parity & (F.when(is_base, 0.0).otherwise(F.col(c)) <= most)
    rows = rows.withColumn("speedup", F.col("median") / F.col("baseline_median")).withColumn("stable", (F.col("spread") <= most_spread) & (F.col("baseline_spread") <= most_spread)).withColumn("parity", parity)
    return rows.withColumn("promoted", ~is_base & F.col("parity") & F.col("stable") & (F.col("speedup") >= speedup)).drop(*tolerances)


def constant(df: DataFrame, group: str, *values: str) -> DataFrame:
    """Whether each value is the same in all rows of a group, null being a value of its own; by extremes, so nothing is gathered."""
    same = lambda v: F.min(v).eqNullSafe(F.max(v)) & F.count(v).isin(F.lit(0), F.count("*"))
    return df.groupBy(group).agg(*(same(v).alias(f"same_{v}") for v in values))


def preference_summary(pairs: DataFrame, group: str) -> DataFrame:
    """From (chosen, rejected, chosen_tokens, rejected_tokens, truncated): ties count against the model."""
    n = F.count("*")
    return pairs.groupBy(group).agg(
        n.alias("pairs"),
        (F.count_if(F.col("chosen") > F.col("rejected")) / n).alias("accuracy"),
        (F.sum("chosen") / n).alias("mean_chosen"),
        (F.sum("rejected") / n).alias("mean_rejected"),
        ((F.sum("chosen") - F.sum("rejected")) / n).alias("mean_margin"),
        (F.sum("chosen_tokens") / n).alias("mean_chosen_tokens"),
        (F.sum("rejected_tokens") / n).alias("mean_rejected_tokens"),
        F.count_if("truncated").alias("truncated_pairs"),
        (F.count_if("truncated") / n).alias("truncation_rate"),
    )


def perplexity(df: DataFrame, group: str, loss: str, tokens: str) -> DataFrame:
    """Mean loss weighted by tokens, and its exponential; a loss whose exponential overflows is an error."""
    rows = df.groupBy(group).agg((F.sum(F.col(loss) * F.col(tokens)) / F.sum(tokens)).alias("mean_loss"), F.sum(tokens).alias("tokens"))
    return rows.withColumn("perplexity", F.when(F.col("mean_loss") > 709.78, F.raise_error(F.lit("the perplexity overflows")).cast("double")).otherwise(F.exp("mean_loss")))


def diffusion_rollup(df: DataFrame, group: str) -> DataFrame:
    """From (weighted_loss, token_loss, masked, correct, examples): a mean per example, and two per masked token."""
    return df.groupBy(group).agg((F.sum(F.col("weighted_loss") * F.col("examples")) / F.sum("examples")).alias("loss"), (F.sum(F.col("token_loss") * F.col("masked")) / F.sum("masked")).alias("masked_loss"), (F.sum("correct") / F.sum("masked")).alias("masked_accuracy"), F.sum("masked").alias("masked"), F.sum("examples").alias("examples"))


def tolerance(expected: DataFrame, actual: DataFrame, key: list[str], group: str, absolute: float, relative: float) -> DataFrame:
    """Values (key, value) of two sides, aligned by key with none missing: errors and violations of |d| <= a + r |expected|."""
    both = expected.withColumnRenamed("value", "_e").withColumn("_in_e", F.lit(1)).join(actual.withColumnRenamed("value", "_a").withColumn("_in_a", F.lit(1)), key, "full")
    error, allowed = F.abs(F.col("_a") - F.col("_e")), F.lit(absolute) + F.lit(relative) * F.abs("_e")
    return both.groupBy(group).agg(F.count_if(F.col("_in_e").isNull() | F.col("_in_a").isNull()).alias("unmatched"), F.max(error).alias("max_error"), F.count_if(error > allowed).alias("violations"), F.count_if(F.col("_a") == F.col("_e")).alias("equal"), F.max(error / allowed).alias("max_ratio"), F.count("*").alias("values"))


def relative_l2(pairs: DataFrame, group: str, expected: str, actual: str) -> DataFrame:
    return pairs.groupBy(group).agg((F.sqrt(F.sum((F.col(actual) - F.col(expected)) ** 2)) / F.sqrt(F.sum(F.col(expected) ** 2))).alias("relative_l2"), F.max(F.abs(F.col(actual) - F.col(expected))).alias("max_error"))


def update_rms(df: DataFrame, group: str, initial: str, current: str, gradient: str) -> DataFrame:
    """Root mean squares of weights, gradients and updates, and the update relative to and rotated against the weights.

    The two relative figures are 0 for a group of zero norm, and the angle, too, for one that has become zero.
    """
    w, g, u, c = F.col(initial), F.col(gradient), F.col(current) - F.col(initial), F.col(current)
    s = df.groupBy(group).agg(F.count("*").alias("values"), F.sum(w * w).alias("_w"), F.coalesce(F.sum(g * g), F.lit(0.0)).alias("_g"), F.sum(u * u).alias("_u"), F.sum(c * c).alias("_c"), F.sum(w * u).alias("_x"))
    side = F.sqrt(F.greatest(F.lit(0.0), F.col("_u") - F.col("_x") * F.col("_x") / F.col("_w")))
    along = F.sqrt("_w") + F.col("_x") / F.sqrt("_w")
    rms = lambda c: F.sqrt(F.col(c) / F.col("values"))
    return s.select(group, "values", rms("_w").alias("weight_rms"), rms("_g").alias("gradient_rms"), rms("_u").alias("update_rms"), F.when(F.col("_w") == 0, 0.0).otherwise(F.sqrt(F.col("_u") / F.col("_w"))).alias("effective_rate"), F.when((F.col("_w") == 0) | (F.col("_c") == 0), 0.0).otherwise(F.atan2(side, along)).alias("angular_rate"))


def strict_zip(left: DataFrame, right: DataFrame, ordinal: str) -> DataFrame:
    """Two sides by ordinal; `problem` names rows that only one side has."""
    a, b = left.withColumn("_a", F.lit(1)), right.withColumn("_b", F.lit(1))
    problem = F.when(F.col("_a").isNull(), "left missing").when(F.col("_b").isNull(), "right missing")
    return a.join(b, ordinal, "full").withColumn("problem", problem).drop("_a", "_b")


def with_baseline(results: DataFrame, baseline: str, *key: str, value: str = "throughput", bound: Sequence[str] = ()) -> DataFrame:
    """Each candidate beside the baseline of the same key; without one, `missing_baseline` holds.

    bound: fields in which both must agree (the plan's hash, say); where a baseline is there and they don't, `incompatible` holds.
    """
    base = results.filter(F.col("cell") == baseline).select(*key, F.col(value).alias("baseline_value"), F.lit(True).alias("_there"), *(F.col(c).alias(f"_b_{c}") for c in bound))
    rows = results.filter(F.col("cell") != baseline).join(base, list(key), "left").withColumn("missing_baseline", F.col("_there").isNull())
    if bound:
        agree = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in bound))
        rows = rows.withColumn("incompatible", ~F.col("missing_baseline") & ~agree)
    return rows.drop("_there", *(f"_b_{c}" for c in bound))


def downstream(selected: DataFrame, evaluations: DataFrame, generations: DataFrame, key: str, bound: Sequence[str]) -> DataFrame:
    """Selected jobs with their numbers of evaluation and generation records, and whether what is there binds to the job.

    complete: exactly one job, one evaluation and one generation of the key, which agree in all fields of `bound`.
    """
    jobs = selected.groupBy(key).agg(F.count("*").alias("jobs"), *(F.min(c).alias(c) for c in bound))

    def of(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(key).agg(F.count("*").alias(name), *(F.min(c).alias(f"_{name}_{c}") for c in bound))

    rows = jobs.join(of(evaluations, "evaluations"), key, "left").join(of(generations, "generations"), key, "left")
    agree = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{n}_{c}")) for c in bound for n in ("evaluations", "generations")))
    one = reduce(Column.__and__, (F.coalesce(F.col(n), F.lit(0)) == 1 for n in ("jobs", "evaluations", "generations")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return rows.select(key, "jobs", zero("evaluations"), zero("generations"), agree.alias("bound"), (one & agree).alias("complete"))


def mismatches(df: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """The names of the fields that differ between two records; null equals null."""
    return F.filter(F.array(*(F.when(~F.col(a).eqNullSafe(F.col(b)), F.lit(a)) for a, b in pairs)), lambda x: x.isNotNull())


def first_failure(rules: list[tuple[str, Column]]) -> Column:
    """The first rule, in order, that doesn't hold; null where all do."""
    out = None
    for name, holds in rules:
        fails = ~F.coalesce(holds, F.lit(False))
        out = F.when(fails, name) if out is None else out.when(fails, name)
    return out


def lineage(edges: DataFrame, child: str, parent: str, start: Column | None = None) -> DataFrame:
    """(origin, depth, node): the chain of parents of each child for which `start` holds, of every child without it.

    Any depth, in as many rounds as its logarithm: round k knows the ancestors 2^k steps up and carries the rows found so
    far, which are less than 2^k deep, on by that many. As a recursive query would, a repeated child repeats its paths.
    Each round's new rows go to the shared folder; parents in a circle are an error, as the chain has no end.
    """
    first = edges if start is None else edges.filter(start)
    found = saved(first.select(F.col(child).alias("origin"), F.lit(0).alias("depth"), F.col(child).alias("node")), "lineage")
    up = saved(edges.select(F.col(child).alias("node"), F.col(parent).alias("to")).dropna(), "ancestors")
    most, steps = up.count(), 1
    while not (new := saved(found.join(up, "node").select("origin", (F.col("depth") + steps).alias("depth"), F.col("to").alias("node")), "lineage")).isEmpty():
        if steps > most:
            raise ValueError(f"the parents of {new.first()['origin']} form a circle")
        found, steps = found.unionByName(new), 2 * steps
        up = saved(up.join(up.select(F.col("node").alias("to"), F.col("to").alias("_to")), "to").select("node", F.col("_to").alias("to")), "ancestors")
    return found


def plan_matrix(spark, **axes: list) -> DataFrame:
    """Every combination of the axes' values: plans are small by nature."""
    return spark.createDataFrame(list(product(*axes.values())), list(axes)).coalesce(1)
