"""Running totals and row numbers over a whole table, without sorting it in one task.

Rows are cut into buckets by a coarse form of the order; the buckets' totals are few and are summed in one small window;
each bucket then runs its own window from its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket of an integer order on average, and hexadecimal digits of a hash: buckets stay in one task's memory.
WIDTH, DIGITS = 65_536, 3


def _offsets(df: DataFrame, bucket: Column, value: Column) -> DataFrame:
    totals = df.groupBy(bucket.alias("_bucket")).agg(F.sum(value).alias("_total"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))


def running_sum(df: DataFrame, order: str, value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """df with column `name`: the sum of `value` over all rows up to this one in the order of the integer column `order`.

    Buckets are equal spans of the order, as many as give `width` rows each on average, so sparse or hashed orders don't
    make a bucket of every row. Ties in the order go by value.
    """
    low, high, n = df.agg(F.min(order), F.max(order), F.count(order)).first()
    span = max(1, -(-(high - low + 1) // max(1, n // width))) if n else 1
    bucket = F.floor((F.col(order).cast("decimal(20,0)") - F.lit(low or 0).cast("decimal(20,0)")) / F.lit(span).cast("decimal(20,0)")).cast("long")
    own = Window.partitionBy("_bucket").orderBy(order, value).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_bucket", bucket).join(_offsets(df, bucket, value), "_bucket")
    return rows.withColumn(name, (F.col("_offset") + F.sum(value).over(own)).cast("long")).drop("_bucket", "_offset")


def numbered(df: DataFrame, name: str, digest: str, *ties: str, digits: int = DIGITS) -> DataFrame:
    """df with column `name`: the row's number, from 1, in the order of a hexadecimal digest column and then `ties`."""
    bucket = F.substring(digest, 1, digits)
    own = Window.partitionBy("_bucket").orderBy(digest, *ties)
    rows = df.withColumn("_bucket", bucket).join(_offsets(df, bucket, F.lit(1)), "_bucket")
    return rows.withColumn(name, (F.col("_offset") + F.row_number().over(own)).cast("long")).drop("_bucket", "_offset")
