"""Token shards: next-fit packing, windows, seeded order, rank strides, cursors and buckets by length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.symbols import BYTE_IDS
from lodestone.operators.ordered import numbered
from lodestone.session import saved_path
from lodestone.ship import ship
from lodestone.sources import files

EOS = 2


def byte_tokens(text: Column) -> Column:
    """Ids of the UTF-8 bytes of a text without merges."""
    one_by_one = F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "")
    return F.when(F.octet_length(text) == 0, F.array().cast("array<int>")).otherwise(F.transform(one_by_one, lambda c: F.element_at(F.array(*map(F.lit, BYTE_IDS)), F.ascii(c) + 1)))


def _packed(sizes: np.ndarray, cap: int, shard: int, fill: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Shard and start of each document, and the open shard and its fill after them, from those before."""
    shards, starts, total, at = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), np.cumsum(sizes), 0
    while at < len(sizes):
        before = total[at - 1] if at else 0
        to = max(at, int(np.searchsorted(total, before + cap - fill, "right")))
        if to == at and fill:
            shard, fill = shard + 1, 0
            continue
        to = max(to, at + 1)  # a document above the cap is alone
        shards[at:to], starts[at:to] = shard, fill + total[at:to] - sizes[at:to] - before
        fill += int(total[to - 1] - before)
        at = to
    return shards, starts, shard, fill


def next_fit(df: DataFrame, group: str, order: str, tokens: str, cap: int, oversized: bool = False) -> DataFrame:
    """df's (group, order, tokens) with shard and start: a shard that a document doesn't fit into is closed for good.

    Ranges of the order are sorted at the same time and written as narrow rows. One task runs over their sizes and tells
    the open shard and its fill at each range's start; then the ranges are packed at the same time, each from there. A
    document larger than the cap is an error, or, if `oversized`, a shard of its own. Ties in the order go by size.
    """
    spark = ship(df.sparkSession)
    rows = df.select(F.col(group).cast("string").alias("_g"), F.col(order).cast("long").alias("_o"), F.col(tokens).cast("long").alias("_n"))
    path = saved_path(rows.repartitionByRange("_g", "_o").sortWithinPartitions("_g", "_o", "_n"), "ordered")

    def packed(name: str, state: tuple) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, tuple]]:
        where, inner = files.filesystem(f"{path}/{name}")
        now, shard, fill = state
        with where.open_input_file(inner) as f:
            for batch in pq.ParquetFile(f).iter_batches(1 << 16, use_threads=False):
                names, sizes = batch.column(0).dictionary_encode(), batch.column(2).to_numpy()
                if len(sizes) and sizes.max() > cap and not oversized:
                    raise ValueError(f"a document of {sizes.max()} tokens is larger than a shard of {cap}")
                codes = names.indices.fill_null(-1).to_numpy()
                cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
                shards, starts = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
                for at, to in zip(cuts, cuts[1:], strict=False):
                    if at == to:
                        continue
                    if (own := (batch.column(0)[at].as_py(),)) != now:
                        now, shard, fill = own, 0, 0
                    shards[at:to], starts[at:to], shard, fill = _packed(sizes[at:to], cap, shard, fill)
                yield batch, shards, starts, (now, shard, fill)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        state = (None, 0, 0)
        for name, _ in files.listing(path):
            if name.endswith(".parquet"):
                now, shard, fill = state
                yield pa.RecordBatch.from_pydict({"file": [name], "started": [now is not None], "g": pa.array([now[0] if now else None], pa.string()), "shard": pa.array([shard], pa.int64()), "fill": pa.array([fill], pa.int64())})
                for *_, state in packed(name, state):
                    pass

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            for batch, shards, starts, _ in packed(r["file"], ((r["g"],) if r["started"] else None, r["shard"], r["fill"])):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shards), pa.array(starts)], names=["_g", "_o", "_n", "shard", "start"])

    state = "file string, started boolean, g string, shard long, fill long"
    states = [tuple(r) for r in spark.range(0, 1, 1, 1).mapInArrow(chain, state).collect()]  # a row a range
    listed = spark.createDataFrame(spark.sparkContext.parallelize(states, max(1, len(states))), state)  # a task a range
    out = listed.mapInArrow(pack, "_g string, _o long, _n long, shard long, start long")
    return out.select(F.col("_g").alias(group), F.col("_o").alias(order), F.col("_n").alias(tokens), "shard", "start")


def shard_sizes(packed: DataFrame, group: str, order: str, tokens: str) -> DataFrame:
    """(group, shard, documents, tokens, next_document): the cursor is the number of the group's documents up to the shard's end."""
    sizes = packed.groupBy(group, "shard").agg(F.count("*").alias("documents"), F.sum(tokens).alias("tokens"))
    upto = Window.partitionBy(group).orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    return sizes.withColumn("next_document", F.sum("documents").over(upto))


def windows(shards: DataFrame, length: int) -> DataFrame:
    """A row per whole window of `length` tokens of each shard, without overlap; the rest of a shard is dropped."""
    rows = shards.filter(F.col("tokens") >= length)
    return rows.select("split", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tokens") - length, F.lit(length).cast("long"))).alias("start"))


def shuffled(wins: DataFrame, seed: int, epoch: int) -> DataFrame:
    """Windows with stable_id, digest and position (from 0): in the order of SHA-256 of "seed:epoch:shard:start", then id."""
    rows = wins.withColumn("stable_id", F.concat_ws(":", "shard", "start"))
    rows = rows.withColumn("digest", F.sha2(F.concat(F.lit(f"{seed}:{epoch}:"), F.col("stable_id")), 256))
    return numbered(rows, "position", "digest", "stable_id").withColumn("position", F.col("position") - 1)


def strided(ordered: DataFrame, world: int) -> DataFrame:
    """Each position's rank and its local index there."""
    return ordered.withColumn("rank", F.col("position") % world).withColumn("local_index", F.floor(F.col("position") / world).cast("long"))


def cursor_batches(epochs: DataFrame, rank: int, start_epoch: int, start_index: int, batch: int, batches: int, world: int) -> DataFrame:
    """The rows of `batches` batches of a rank from a cursor on; an epoch that ends goes over into the next one.

    epochs: strided windows of all epochs that may be reached, with a column epoch. (epoch, local_index) is one running
    number, as every epoch has as many windows for a rank.
    """
    own = epochs.filter(F.col("rank") == rank)
    per_epoch = own.groupBy("epoch").agg(F.count("*").alias("_n")).agg(F.max("_n").alias("_n"))
    place = (F.col("epoch") - start_epoch) * F.col("_n") + F.col("local_index") - start_index
    rows = own.crossJoin(F.broadcast(per_epoch)).withColumn("_place", place).filter((F.col("_place") >= 0) & (F.col("_place") < batch * batches))  # one row
    return rows.withColumn("batch", F.floor(F.col("_place") / batch).cast("long")).withColumn("row", (F.col("_place") % batch).cast("long")).drop("_n", "_place")


def length_buckets(df: DataFrame, index: str, length: str, chunk: int, batch: int) -> DataFrame:
    """Records in chunks of source order, by length inside a chunk, cut into batches."""
    rows = df.withColumn("bucket", F.floor(F.col(index) / chunk).cast("long"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(length, index)) - 1
    return rows.withColumn("place", place).withColumn("batch", F.floor(F.col("place") / batch).cast("long"))


def retained(checkpoints: DataFrame, latest: int) -> DataFrame:
    """The `latest` checkpoints by step, and the last one flagged as best; each task keeps that many rows at most."""
    by_step = F.desc("optimizer_step")
    best = checkpoints.filter("is_best").orderBy(by_step).limit(1).select("optimizer_step", F.lit(True).alias("kept_as_best"))
    newest = checkpoints.orderBy(by_step).limit(latest)
    rows = newest.unionByName(checkpoints.join(F.broadcast(best), "optimizer_step", "left_semi")).distinct()  # one row
    return rows.join(F.broadcast(best), "optimizer_step", "left").withColumn("kept_as_best", F.coalesce("kept_as_best", F.lit(False)))
