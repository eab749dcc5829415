"""What the operators share: scratch folders, rows for Python, batches of bounded size, size checks."""

from __future__ import annotations

import atexit
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import session
from lodestone.ship import ship

#: Bytes of a table that may be broadcast where the session's own threshold says nothing.
BROADCAST_BYTES = 10 << 20


def scratch(spark: SparkSession, tag: str) -> str:
    """A folder name below the shared folder that no other run has; it goes when the driver's Python ends."""
    path = session.scratch(spark, tag)
    atexit.register(session.drop, path)
    return path


def small(df: DataFrame, row_bytes: int, rows: int | None = None) -> bool:
    """Whether df's rows, counted, fit the session's broadcast threshold at row_bytes each."""
    limit = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", str(BROADCAST_BYTES))
    return (df.count() if rows is None else rows) * row_bytes <= _size(limit)


def _size(text: str) -> int:
    text = text.strip().lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(text[-1:], 0)
    return int(float(text[:-1] if unit else text) * (1 << unit))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """Only the id and the text (null: empty) as _id and _text, whatever else the table holds."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), *more)


def pieces(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has about `most` bytes, or one row."""
    for batch in batches:
        step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Batches put together to about `least` bytes."""
    held, n = [], 0
    for batch in pieces(batches, least):
        held.append(batch)
        n += batch.nbytes
        if n >= least:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, and then what it has freed goes back to the system: workers stay alive and share their machine with others."""

    def tidy(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidy


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
