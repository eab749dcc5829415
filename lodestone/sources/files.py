"""Files on any store that Arrow knows, written whole or not at all."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

from lodestone.ship import ship


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a URI or plain path, and the path inside it."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def exists(path: str) -> bool:
    where, inner = filesystem(path)
    return where.get_file_info(inner).type != pafs.FileType.NotFound


def publish(path: str, data: bytes | memoryview, replace: bool = True) -> None:
    """Write under another name, then rename; without `replace` an existing file is an error."""
    where, inner = filesystem(path)
    if not replace and exists(path):
        raise FileExistsError(path)
    where.create_dir(os.path.dirname(inner), recursive=True)
    part = f"{inner}.{uuid.uuid4().hex}.tmp"
    with where.open_output_stream(part) as out:
        out.write(data)
    settle(where, part, inner)


def settle(where: pafs.FileSystem, part: str, inner: str) -> None:
    """Give a finished file its name; where another run of the task was first and names can't be taken over, its file stays."""
    try:
        where.move(part, inner)
    except OSError:
        if where.get_file_info(inner).type != pafs.FileType.File or where.get_file_info(inner).size != where.get_file_info(part).size:
            raise
        where.delete_file(part)


def publish_folder(staged: str, path: str) -> None:
    """A finished folder takes its name in one step; an existing one is an error."""
    if exists(path):
        raise FileExistsError(path)
    where, inner = filesystem(staged)
    where.move(inner, filesystem(path)[1])


def remove_folder(path: str) -> None:
    where, inner = filesystem(path)
    if exists(path):
        where.delete_dir(inner)


def listing(path: str) -> list[tuple[str, int]]:
    """(name relative to path, bytes) of all files below it, hidden ones included; checksum files of Spark's writers aside."""
    where, inner = filesystem(path)
    found = where.get_file_info(pafs.FileSelector(inner, recursive=True, allow_not_found=True))
    names = [(os.path.relpath(f.path, inner), f.size) for f in found if f.is_file]
    return sorted((n, size) for n, size in names if not n.endswith(".crc") and os.path.basename(n) != "_SUCCESS")


def digests(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(file, bytes, sha256) of files below path, read in pieces, a task a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in (n for b in batches for n in b.column(0).to_pylist()):
            where, inner = filesystem(f"{path}/{name}")
            h, n = hashlib.sha256(), 0
            with where.open_input_stream(inner) as f:
                while piece := f.read(1 << 20):
                    h.update(piece)
                    n += len(piece)
            yield pa.RecordBatch.from_pydict({"file": [name], "bytes": pa.array([n], pa.int64()), "sha256": [h.hexdigest()]})

    listed = ship(spark).createDataFrame(spark.sparkContext.parallelize([(n,) for n in names], max(1, len(names))), "file string")
    return listed.mapInArrow(run, "file string, bytes long, sha256 string")


def read(path: str) -> bytes:
    where, inner = filesystem(path)
    with where.open_input_stream(inner) as f:
        return f.read()
