"""Run logs: the last record of a step, gaps, count windows, cadence and long form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.ship import ship


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last record of each key by `order`. An aggregate, not a sort: one record a key and task is shuffled."""
    rest = [c for c in df.columns if c not in key]
    last = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return last.select(*key, "_last.*")


def gaps(df: DataFrame, group: str, step: str) -> DataFrame:
    """(group, steps, contiguous): whether the steps are 1 to n."""
    n = df.groupBy(group).agg(F.countDistinct(step).alias("_distinct"), F.count("*").alias("steps"), F.min(step).alias("_low"), F.max(step).alias("_high"))
    return n.select(group, "steps", ((F.col("_low") == 1) & (F.col("_high") == F.col("steps")) & (F.col("_distinct") == F.col("steps"))).alias("contiguous"))


def count_windows(df: DataFrame, step: str, size: int) -> DataFrame:
    """Windows of `size` steps; the last one may be shorter: (window, first_step, last_step, steps)."""
    rows = df.groupBy(F.ceil(F.col(step) / size).cast("long").alias("window"))
    return rows.agg(F.min(step).alias("first_step"), F.max(step).alias("last_step"), F.count("*").alias("steps"))


def unpivoted(df: DataFrame, step: str, values: list[str], prefix: str = "train/") -> DataFrame:
    """(step, tag, value): a row per scalar; absent optional scalars have none."""
    pairs = ", ".join(f"'{prefix}{v}', cast(`{v}` as double)" for v in values)
    return df.select(step, F.expr(f"stack({len(values)}, {pairs}) as (tag, value)")).filter("value is not null")


def cadence(df: DataFrame, group: str, step: str, clock: str, every_steps: int | None, every_seconds: float | None) -> DataFrame:
    """The steps at which each run saves: every so many steps, or so long after the last save; a clock that goes back is an error.

    Whether a step saves depends on the saves before it, so a run is streamed in order through one task, in constant memory.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(group).cast("string").alias("_g"), F.col(step).cast("long").alias("step"), F.col(clock).cast("double").alias("clock"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = saved = at = None
        for batch in batches:
            keep, why = [], []
            for g, s, c in zip(batch["_g"], batch["step"], batch["clock"], strict=True):
                if g != now:
                    now, saved, at = g, c, c
                if c < at:
                    raise ValueError(f"the clock of {g} goes back at step {s}")
                at = c
                due = every_steps is not None and s % every_steps == 0
                late = every_seconds is not None and c - saved >= every_seconds
                keep.append(due or late)
                why.append("step" if due else "time")
                if due or late:
                    saved = c
            yield batch.assign(reason=why)[keep]

    return rows.repartition("_g").sortWithinPartitions("_g", "step").mapInPandas(fold, "_g string, step long, clock double, reason string").withColumnRenamed("_g", group)


def last_n_mean(df: DataFrame, group: str, order: str, value: str, n: int) -> DataFrame:
    """The mean of the last n values, or of all where there are fewer."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))
    return df.withColumn("_n", rank).filter(F.col("_n") <= n).groupBy(group).agg(F.avg(value).alias(f"mean_last_{n}"), F.count("*").alias("values"))


def run_summary(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    return df.groupBy(group).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("final"), F.avg(value).alias("mean"), F.count("*").alias("steps"))


def parsed(lines: Column, schema: str) -> Column:
    """A JSON object of a closed schema; null where it isn't one, has unknown keys or lacks some."""
    value = F.from_json(lines, schema)
    names = [part.split()[0] for part in schema.split(",")]
    keys = F.json_object_keys(lines)
    return F.when(keys.isNotNull() & (F.array_sort(keys) == F.array(*map(F.lit, sorted(names)))), value)
