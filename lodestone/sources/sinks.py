"""Sinks: samples with hashes and a manifest, token shards, metric snapshots. A folder gets its name when it is whole."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.canonical import canonical
from lodestone.operators.digest import stream_digest
from lodestone.session import saved
from lodestone.ship import ship
from lodestone.sources import files, records


def write_json(path: str, value: object, replace: bool = False) -> None:
    files.publish(path, (canonical(value) + "\n").encode(), replace)


def _published(path: str, write: Callable[[str], dict]) -> dict:
    """What write() puts into a folder gets the name `path`, which must not exist, once it is whole; gives write()'s result."""
    if files.exists(path):
        raise FileExistsError(path)
    staged = f"{path}.{uuid.uuid4().hex}.partial"
    try:
        made = write(staged)
        files.publish_folder(staged, path)
        return made
    except BaseException:
        files.remove_folder(staged)
        raise


def _hashed(spark: SparkSession, path: str) -> list[dict]:
    """File, bytes and SHA-256 of each file of a folder."""
    names = [name for name, _ in files.listing(path)]
    return sorted((r.asDict() for r in files.digests(spark, path, names).collect()), key=lambda f: f["file"])  # a row a file


def write_sample(df: DataFrame, path: str, order: str, text: str) -> dict:
    """Documents, their hashes and a manifest under `path`, which must not exist; gives the manifest.

    The manifest has every file's length and hash, the totals and the digest over all documents; the folder is checked
    against it before it gets its name.
    """

    def write(staged: str) -> dict:
        rows = saved(df.select(F.col(order).cast("long").alias("ordinal"), F.col(text).alias("text")), "sample")  # read several times
        rows.sortWithinPartitions("ordinal").write.json(f"{staged}/documents")
        rows.select("ordinal", F.sha2("text", 256).alias("sha256")).sortWithinPartitions("ordinal").write.json(f"{staged}/hashes")
        found = rows.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("bytes")).first().asDict()
        made = found | {"content_sha256": stream_digest(rows, "ordinal", "text").first()["sha256"], "files": _hashed(df.sparkSession, staged)}
        write_json(f"{staged}/manifest.json", made | {"format": "lodestone-sample", "version": 1})
        records.checked_sample(df.sparkSession, staged)
        return made

    return _published(path, write)


def write_records(df: DataFrame, path: str, order: str) -> dict:
    """Rows as canonical JSON lines, in ranges of `order`, with a manifest: count, digest over all lines, files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([canonical(json.loads(x)) for x in batch.column(1).to_pylist()], pa.string())], names=["_o", "value"])

    def write(staged: str) -> dict:
        ship(df.sparkSession)
        rows = df.select(F.col(order).cast("long").alias("_o"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
        rows = saved(rows.mapInArrow(run, "_o long, value string"), "records")
        rows.repartitionByRange("_o").sortWithinPartitions("_o", "value").select("value").write.text(f"{staged}/records")
        made = stream_digest(rows, "_o", "value").first().asDict()
        made = {"records": made["documents"], "sha256": made["sha256"], "files": _hashed(df.sparkSession, staged)}
        write_json(f"{staged}/manifest.json", made | {"format": "lodestone-records", "version": 1})
        return made

    return _published(path, write)


def write_cache(df: DataFrame, path: str, binding: dict) -> None:
    """Values that are dear to make, as Parquet beside what they were made from; records.read_cache() wants the same binding."""

    def write(staged: str) -> dict:
        df.write.parquet(f"{staged}/rows")
        write_json(f"{staged}/binding.json", binding)
        return binding

    _published(path, write)


def write_shards(df: DataFrame, path: str, vocabulary: int, ids: str = "ids", document: str | None = None, tokenizer: str | None = None) -> dict:
    """Little-endian 16-bit shards from (split, shard, start, ids), `start` being the place of a document in its shard.

    A shard is written by one task, streamed in order; a task that runs again writes the same file. document: a column of
    content hashes, listed beside the shards; tokenizer: the hash of the one that made the ids. Everything is checked
    before the folder gets its name. Gives the manifest.
    """
    if not 0 < vocabulary <= 1 << 16:
        raise ValueError("16 bits hold 65,536 ids")
    return _published(path, lambda staged: _staged_shards(df, staged, vocabulary, ids, document, tokenizer))


def _staged_shards(df: DataFrame, staged: str, vocabulary: int, ids: str, document: str | None, tokenizer: str | None) -> dict:
    ship(df.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, body, documents = None, [], 0

        def close() -> pa.RecordBatch:
            data = b"".join(body)
            name = f"{now[0]}-{now[1]:05d}.bin"
            files.publish(f"{staged}/{name}", data)
            return pa.RecordBatch.from_pydict({"split": [now[0]], "shard": pa.array([now[1]], pa.int64()), "file": [name], "tokens": pa.array([len(data) // 2], pa.int64()), "documents": pa.array([documents], pa.int64()), "sha256": [hashlib.sha256(data).hexdigest()]})

        for batch in batches:
            for split, shard, own in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if now != (split, shard):
                    if now:
                        yield close()
                    now, body, documents = (split, shard), [], 0
                values = np.array(own, np.int64)
                if len(values) and not 0 <= values.min() <= values.max() < vocabulary:
                    raise ValueError(f"an id of {split} {shard} is outside the vocabulary")
                body.append(values.astype("<u2").tobytes())
                documents += 1
        if now:
            yield close()

    rows = df.select("split", F.col("shard").cast("long").alias("shard"), F.col("start").cast("long").alias("start"), F.col(ids).cast("array<int>").alias("ids"))
    rows = rows.repartition("split", "shard").sortWithinPartitions("split", "shard", "start")
    shards = [r.asDict() | {"tokenizer": tokenizer} for r in rows.mapInArrow(write, "split string, shard long, file string, tokens long, documents long, sha256 string").collect()]  # a row a shard
    if document:
        df.select("split", F.col("shard").cast("long").alias("shard"), F.col(document).alias("sha256")).write.json(f"{staged}/documents")
    splits: dict[str, dict] = {}
    for s in shards:
        own = splits.setdefault(s["split"], {"shards": 0, "documents": 0, "tokens": 0})
        for key, n in (("shards", 1), ("documents", s["documents"]), ("tokens", s["tokens"])):
            own[key] += n
    manifest = {"format": "lodestone-shards", "version": 1, "vocabulary": vocabulary, "shards": sorted(shards, key=lambda s: (s["split"], s["shard"])), "splits": splits}
    write_json(f"{staged}/manifest.json", manifest)
    return records.checked_shards(df.sparkSession, staged)


def write_snapshot(df: DataFrame, path: str, step: str = "optimizer_step") -> None:
    """A metric series as Parquet with zstd, in the order of steps; the folder gets its name when it is whole."""

    def write(staged: str) -> dict:
        df.orderBy(step).write.option("compression", "zstd").parquet(staged)
        return {}

    _published(path, write)


def append_lines(df: DataFrame, path: str) -> None:
    """Records at the end of a log of JSON lines."""
    df.write.mode("append").json(path)


class EventLog:
    """A log of canonical JSON lines at the end of a file, written through every `every` events or `seconds`, whichever is first."""

    def __init__(self, path: str, every: int = 50, seconds: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.where, self.inner = files.filesystem(path)
        self.every, self.seconds, self.clock = every, seconds, clock
        self.held: list[str] = []
        self.at, self.syncs = clock(), 0

    def append(self, event: dict) -> None:
        self.held.append(canonical(event) + "\n")
        if len(self.held) >= self.every or self.clock() - self.at >= self.seconds:
            self.sync()

    def sync(self) -> None:
        if self.held:
            with self.where.open_append_stream(self.inner) as out:
                out.write("".join(self.held).encode())
            self.held.clear()
            self.syncs += 1
        self.at = self.clock()

    def __enter__(self) -> "EventLog":
        return self

    def __exit__(self, *_: object) -> None:
        self.sync()
