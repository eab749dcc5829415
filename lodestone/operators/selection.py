"""Choosing rows: allocation by weights, quotas, seeded top-n, holdouts, and set checks between plans and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_digest(seed: int, *parts: str) -> Column:
    """SHA-256 of "seed:part:...", the order of seeded selections."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *(F.col(p).cast("string") for p in parts)), 256)


def hash_topn(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """The n rows first by seeded digest, ties by the key itself; each partition keeps n rows at most."""
    return df.withColumn("digest", seeded_digest(seed, *key)).orderBy("digest", *key).limit(n)


def largest_remainder(sources: DataFrame, target: int, name: str = "split", available: str = "available_examples", weight: str = "weight") -> DataFrame:
    """Whole quotas in proportion to available * weight: floors, and one more by remainder (larger first), then name.

    Raises where the sources can't hold the target or a quota passes what a source has.
    """
    mass = (F.col(available) * F.col(weight).cast("decimal(20,10)")).cast("decimal(38,10)")
    whole = Window.partitionBy()  # a row a source
    exact = (F.lit(target) * F.col("mass") / F.sum("mass").over(whole)).cast("decimal(38,18)")
    rows = sources.withColumn("mass", mass).withColumn("exact", exact).withColumn("floor", F.floor("exact").cast("long"))
    order = Window.orderBy((F.col("exact") - F.col("floor")).desc(), F.col(name))
    rows = rows.withColumn("quota", F.col("floor") + F.when(F.row_number().over(order) <= F.lit(target) - F.sum("floor").over(whole), 1).otherwise(0))
    checked = F.when(F.col("quota") > F.col(available), F.raise_error(F.concat(F.lit("no room in "), F.col(name))).cast("long")).otherwise(F.col("quota"))
    return rows.select(name, available, weight, checked.cast("long").alias("quota"))


def first_valid(df: DataFrame, quotas: DataFrame, source: str, order: str, valid: Column) -> DataFrame:
    """The first `quota` valid rows of each source in source order.

    Ranks are cut to the largest quota in every task before the shuffle (a limit on each window group), so a source
    with a third of all rows sends few.
    """
    rank = F.row_number().over(Window.partitionBy(source).orderBy(order))
    rows = df.filter(valid).withColumn("rank", rank)
    most = quotas.agg(F.max("quota")).first()[0] or 0
    return rows.filter(F.col("rank") <= most).join(F.broadcast(quotas.select(source, "quota")), source).filter("rank <= quota")  # a row a source


def quota_scan(df: DataFrame, quotas: DataFrame, source: str, order: str, valid: Column) -> DataFrame:
    """(source, scanned, selected, rejected): each source is read no further than the row that fills its quota."""
    chosen = first_valid(df, quotas, source, order, valid).groupBy(source).agg(F.count("*").alias("selected"), F.max(order).alias("_last"), F.first("quota").alias("quota"))
    rows = df.join(F.broadcast(chosen), source).filter((F.col("selected") < F.col("quota")) | (F.col(order) <= F.col("_last")))  # a row a source
    return rows.groupBy(source, "selected").agg(F.count("*").alias("scanned"), F.count_if(~valid).alias("rejected"))


def holdout(candidates: DataFrame, taken: DataFrame, *key: str) -> DataFrame:
    """Candidates whose key isn't among those taken."""
    return candidates.join(taken.select(*key).distinct(), list(key), "left_anti")


def completeness(planned: DataFrame, realized: DataFrame) -> DataFrame:
    """Rows that are planned but not there ('missing'), and there but not planned ('extra')."""
    side = lambda a, b, name: a.exceptAll(b).withColumn("problem", F.lit(name))
    return side(planned.distinct(), realized.distinct(), "missing").unionByName(side(realized.distinct(), planned.distinct(), "extra"))


def orphans(files: DataFrame, listed: DataFrame, name: str) -> DataFrame:
    """Names that only one side has."""
    a, b = files.select(name).distinct().withColumn("_a", F.lit(1)), listed.select(name).distinct().withColumn("_b", F.lit(1))
    return a.join(b, name, "full").filter("_a is null or _b is null").select(name, F.when(F.col("_b").isNull(), "not listed").otherwise("no file").alias("problem"))


def repeated(df: DataFrame, *key: str) -> DataFrame:
    """Keys of several rows, with their number."""
    return df.groupBy(*key).agg(F.count("*").alias("rows")).filter("rows > 1")


def finalists(ranked: DataFrame, best: int) -> DataFrame:
    """The `best` first by loss and the fastest one, each once, in the order of loss."""
    fastest = F.row_number().over(Window.orderBy(F.desc("throughput"), "name"))
    return ranked.withColumn("_speed", fastest).filter((F.col("position") <= best) | (F.col("_speed") == 1)).drop("_speed")


def confidence_extremes(df: DataFrame, group: str, index: str, confidence: str, k: int) -> DataFrame:
    """The k least and k most confident positions of each group, ties by position: flags lowest, highest."""
    low = F.row_number().over(Window.partitionBy(group).orderBy(F.col(confidence).asc(), F.col(index)))
    high = F.row_number().over(Window.partitionBy(group).orderBy(F.col(confidence).desc(), F.col(index)))
    rows = df.withColumn("_low", low).withColumn("_high", high).filter((F.col("_low") <= k) | (F.col("_high") <= k))
    return rows.select(group, index, confidence, (F.col("_low") <= k).alias("lowest"), (F.col("_high") <= k).alias("highest"))
