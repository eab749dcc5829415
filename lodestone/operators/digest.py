"""Digests that depend on the order of a whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import saved_path
from lodestone.ship import ship
from lodestone.sources import files


def stream_digest(df: DataFrame, order: str, text: str) -> DataFrame:
    """One row (documents, sha256): SHA-256 over each text's length (8 bytes, big-endian) and bytes, in order, ties by text.

    Ranges of the order are sorted at the same time and written; as the digest can't be split, one task then streams the
    ranges' files one after the other, in constant memory. A null text counts as empty.
    """
    spark = ship(df.sparkSession)
    rows = df.select(F.col(order).alias("_o"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    # files are numbered as the ranges are
    path = saved_path(rows.repartitionByRange("_o").sortWithinPartitions("_o", "_t").select("_t"), "ordered")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        h, n = hashlib.sha256(), 0
        for name, _ in files.listing(path):
            if name.endswith(".parquet"):
                where, inner = files.filesystem(f"{path}/{name}")
                with where.open_input_file(inner) as f:
                    for batch in pq.ParquetFile(f).iter_batches(1024, use_threads=False):
                        for x in batch.column(0).cast(pa.binary()).to_pylist():
                            h.update(len(x).to_bytes(8, "big"))
                            h.update(x)
                            n += 1
        yield pa.RecordBatch.from_pydict({"documents": pa.array([n], pa.int64()), "sha256": [h.hexdigest()]})

    return spark.range(0, 1, 1, 1).mapInArrow(fold, "documents long, sha256 string")
