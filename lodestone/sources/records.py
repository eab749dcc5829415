"""Record files: closed schemas, marked encodings, one record a file, samples checked against their hashes, token shards."""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.functions.canonical import canonical, is_canonical
from lodestone.operators.digest import stream_digest
from lodestone.ship import ship
from lodestone.sources import files


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value) of a text file or the files below a folder, lines from 1. A file is streamed by one task, so its order is kept."""
    ship(spark)
    where, inner = files.filesystem(path)
    names = [path] if where.get_file_info(inner).is_file else [f"{path.rstrip('/')}/{n}" for n, _ in files.listing(path)]
    if not names:
        raise FileNotFoundError(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in (n for b in batches for n in b.column(0).to_pylist()):
            at, (own, inside) = 1, files.filesystem(name)
            with own.open_input_file(inside) as f, io.TextIOWrapper(f, encoding="utf-8", newline="\n") as text:
                while part := text.readlines(4 << 20):
                    yield pa.RecordBatch.from_pydict({"path": [name] * len(part), "line": pa.array(range(at, at + len(part)), pa.int64()), "value": [x.removesuffix("\n") for x in part]})
                    at += len(part)

    listed = spark.createDataFrame(spark.sparkContext.parallelize([(n,) for n in names], len(names)), "path string")
    return listed.mapInArrow(run, "path string, line long, value string")


def _strict(rows: DataFrame, schema: str) -> DataFrame:
    """The records of `value`, which must be objects with the schema's keys and no others."""
    from lodestone.operators.metrics import parsed

    rows = rows.withColumn("r", parsed(F.col("value"), schema))
    wrong = F.raise_error(F.concat(F.lit("not a record: "), F.substring("value", 1, 80))).cast(rows.schema["r"].dataType)
    return rows.withColumn("r", F.when(F.col("r").isNull(), wrong).otherwise(F.col("r")))


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True, max_records: int | None = None) -> DataFrame:
    """Objects of a closed schema, blank lines passed over. strict: anything else ends the read; else it comes with `_valid` false.

    max_records: only the first ones, in the order of files and lines; later lines aren't looked at.
    """
    from lodestone.operators.metrics import parsed

    if max_records is None:
        rows = spark.read.text(path).filter(F.trim("value") != "")
    else:
        rows = lines(spark, path).filter(F.trim("value") != "").orderBy("path", "line").limit(max_records).select("value")
    if strict:
        return _strict(rows, schema).select("r.*")
    return rows.select(parsed(F.col("value"), schema).alias("r")).select("r.*", F.col("r").isNotNull().alias("_valid"))


def canonical_events(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value, event) of a log whose every line is an object in canonical form; anything else is an error."""
    rows = lines(spark, path).withColumn("_ok", is_canonical(F.col("value")))
    wrong = F.concat(F.lit("not canonical, or invalid: "), F.substring("value", 1, 80))
    return rows.withColumn("value", F.when(F.col("_ok"), F.col("value")).otherwise(F.raise_error(wrong))).select("path", "line", "value", F.get_json_object("value", "$.event").alias("event"))


def single_record(path: str) -> dict:
    """The one record of a file, in canonical form."""
    found = files.read(path).decode().splitlines()
    if len(found) != 1:
        raise ValueError(f"{path} has {len(found)} records, not one")
    value = json.loads(found[0])
    if not isinstance(value, dict) or canonical(value) != found[0]:
        raise ValueError(f"{path} is not canonical")
    return value


def closed(value: object, what: str, **kinds: type | tuple) -> dict:
    """value, if it is an object with these keys of these kinds and no others."""
    if not isinstance(value, dict) or set(value) != set(kinds):
        raise ValueError(f"{what} has not the keys {sorted(kinds)}")
    for key, kind in kinds.items():
        if not isinstance(value[key], kind) or isinstance(value[key], bool) and kind is int:
            raise ValueError(f"{what}: {key} is {value[key]!r}")
    return value


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files: UTF-16 with its mark, else UTF-8, whose mark is taken off."""
    rows = spark.read.format("binaryFile").load(path).select("path", "content")
    mark = F.hex(F.substring("content", 1, 2))
    utf8 = F.decode(F.when(F.hex(F.substring("content", 1, 3)) == "EFBBBF", F.expr("substring(content, 4)")).otherwise(F.col("content")), "UTF-8")
    return rows.select("path", F.when(mark.isin("FFFE", "FEFF"), F.decode("content", "UTF-16")).otherwise(utf8).alias("text"))


def exactly(df: DataFrame, file: str, count: int) -> DataFrame:
    """df, if each file has `count` records; else an error that names a file."""
    wrong = df.groupBy(file).agg(F.count("*").alias("n")).filter(F.col("n") != count).limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0][file]} has {wrong[0]['n']} records, not {count}")
    return df


def results(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """One record of a closed schema a file under a pattern, with its path, in the order of paths."""
    rows = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return _strict(rows, schema).select("path", "r.*").orderBy("path")


SAMPLE = {"format": str, "version": int, "documents": int, "bytes": int, "content_sha256": str, "files": list}


def checked_sample(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, text) of a sample folder, after all that its manifest says has been compared: the set of files, each file's
    length and hash, the number of documents, their bytes, each document's hash and the digest over all in their order.

    Each row carries its ordinal, so that documents and hashes meet by a join instead of by their places in two files.
    """
    manifest = closed(json.loads(files.read(f"{path}/manifest.json")), f"the manifest of {path}", **SAMPLE)
    listed = {f["file"]: (f["bytes"], f["sha256"]) for f in manifest["files"]}
    there = {name for name, _ in files.listing(path)} - {"manifest.json"}
    if there != set(listed):
        raise ValueError(f"files of {path} are missing or not in its manifest: {sorted(there ^ set(listed))[:3]}")
    for r in files.digests(spark, path, sorted(listed)).collect():  # a row a file
        if (r["bytes"], r["sha256"]) != listed[r["file"]]:
            raise ValueError(f"checksum mismatch: {r['file']} of {path}")
    docs = spark.read.schema("ordinal long, text string").json(f"{path}/documents")
    hashes = spark.read.schema("ordinal long, sha256 string").json(f"{path}/hashes")
    both = docs.join(hashes, "ordinal", "full")
    bad = F.count_if(F.col("text").isNull() | F.col("sha256").isNull() | (F.sha2("text", 256) != F.col("sha256")))
    found = both.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), bad.alias("bad")).first()
    if found["bad"] or found["documents"] != manifest["documents"] or found["bytes"] != manifest["bytes"]:
        raise ValueError(f"the sample in {path} isn't what its manifest says: {found.asDict()}")
    if stream_digest(docs, "ordinal", "text").first()["sha256"] != manifest["content_sha256"]:
        raise ValueError(f"the digest over all documents of {path} isn't what its manifest says")
    return docs


BUILD = {"format": str, "version": int, "vocabulary": int, "shards": list, "splits": dict}
SHARD = {"split": str, "shard": int, "file": str, "tokens": int, "documents": int, "sha256": str, "tokenizer": (str, type(None))}


def build_manifest(path: str) -> dict:
    """The manifest of a shard folder, its schema checked."""
    build = closed(json.loads(files.read(f"{path}/manifest.json")), f"the manifest of {path}", **BUILD)
    for s in build["shards"]:
        closed(s, f"a shard of {path}", **SHARD)
    return build


def checked_shards(spark: SparkSession, path: str, tokenizer: str | None = None, vocabulary: int | None = None) -> dict:
    """The manifest of a shard folder, after all of it has been compared: no partial, orphaned or missing file, one tokenizer
    (the one expected), totals by split, every shard's length, hash and ids, and no document in it twice."""
    build = build_manifest(path)
    names = {n for n, _ in files.listing(path) if not n.startswith("documents/")} - {"manifest.json"}
    if partial := sorted(n for n in names if n.endswith((".partial", ".tmp"))):
        raise ValueError(f"incomplete shard artifact: {partial[0]}")
    if names != {s["file"] for s in build["shards"]}:
        raise ValueError("orphaned or missing shard data file")
    tokenizers = {s["tokenizer"] for s in build["shards"]}
    if len(tokenizers) > 1:
        raise ValueError("the shards have mixed tokenizers")
    if tokenizer is not None and tokenizers - {tokenizer}:
        raise ValueError("the shards have another tokenizer")
    if vocabulary is not None and build["vocabulary"] != vocabulary:
        raise ValueError("the shards have another vocabulary")
    totals: dict[str, dict] = {}
    for s in build["shards"]:
        own = totals.setdefault(s["split"], {"shards": 0, "documents": 0, "tokens": 0})
        for key, n in (("shards", 1), ("documents", s["documents"]), ("tokens", s["tokens"])):
            own[key] += n
    if totals != build["splits"]:
        raise ValueError("a split's token count, documents or shards don't add up")
    read = token_shards(spark, path).groupBy("split", "shard").agg(F.sum(F.size("tokens")).alias("n")).collect()  # a row a shard
    if {(r["split"], r["shard"]): r["n"] for r in read} != {(s["split"], s["shard"]): s["tokens"] for s in build["shards"] if s["tokens"]}:
        raise ValueError("the shards' tokens don't add up")
    if any(s["documents"] for s in build["shards"]) and files.exists(f"{path}/documents"):
        held = spark.read.schema("split string, shard long, sha256 string").json(f"{path}/documents")
        if not held.filter(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}\\z"), F.lit(False))).isEmpty():
            raise ValueError("a document's hash is malformed")
        if again := held.groupBy("sha256").agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect():
            raise ValueError(f"the document {again[0]['sha256']} is in more than one shard, or twice in one")
        counts = {(r["split"], r["shard"]): r["count"] for r in held.groupBy("split", "shard").count().collect()}  # a row a shard
        if counts != {(s["split"], s["shard"]): s["documents"] for s in build["shards"] if s["documents"]}:
            raise ValueError("the shards' documents don't add up")
    return build


def read_cache(spark: SparkSession, path: str, binding: dict) -> DataFrame:
    """The rows of a cache that was written for this binding; one for another is an error."""
    if json.loads(files.read(f"{path}/binding.json")) != json.loads(canonical(binding)):
        raise ValueError(f"{path} was made for something else")
    return spark.read.parquet(f"{path}/rows")


class ShardSource(DataSource):
    """spark.read.format("token_shards").load(folder): (split, shard, start, tokens) in pieces of `piece` tokens.

    A shard's length, hash and largest id are checked before any of its tokens is put out.
    """

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return "split string, shard long, start long, tokens array<int>"

    def reader(self, schema) -> "ShardReader":
        return ShardReader(self.options["path"], int(self.options.get("piece", 65_536)), self.options.get("only", ""))


class ShardReader(DataSourceReader):
    def __init__(self, path: str, piece: int, only: str = ""):
        self.path, self.piece, self.only = path, piece, only

    def partitions(self) -> Sequence[InputPartition]:
        build = build_manifest(self.path)
        return [InputPartition(s | {"vocabulary": build["vocabulary"]}) for s in build["shards"] if self.only in ("", s["file"])] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if (m := partition.value) is None:
            return
        where, inner = files.filesystem(f"{self.path}/{m['file']}")
        h, n, most = hashlib.sha256(), 0, 0
        with where.open_input_stream(inner) as f:  # once to check it, and once more to put it out: a shard is never held whole
            while piece := f.read(1 << 20):
                h.update(piece)
                n += len(piece)
                most = max(most, int(np.frombuffer(piece[: len(piece) & ~1], "<u2").max(initial=0)))
        if n != 2 * m["tokens"] or h.hexdigest() != m["sha256"]:
            raise ValueError(f"{m['file']} isn't what its manifest says: truncated or a checksum mismatch")
        if n and most >= m["vocabulary"]:
            raise ValueError(f"{m['file']} holds an id outside the vocabulary")
        with where.open_input_stream(inner) as f:
            for at in range(0, n // 2, self.piece):
                part = np.frombuffer(f.read(2 * self.piece), "<u2").astype(np.int32)
                yield pa.RecordBatch.from_pydict({"split": [m["split"]], "shard": pa.array([m["shard"]], pa.int64()), "start": pa.array([at], pa.int64()), "tokens": pa.array([part], pa.list_(pa.int32()))})


def token_shards(spark: SparkSession, path: str, piece: int = 65_536, only: str = "") -> DataFrame:
    """only: the name of one shard's file; the others aren't read then."""
    ship(spark)
    spark.dataSource.register(ShardSource)
    return spark.read.format("token_shards").option("piece", piece).option("only", only).load(path)
