"""Token-id files: flat unsigned integers plus 64-bit document offsets, read by memory mapping.

A folder holds part-NNNNN-NNN.bin (little-endian unsigned ids, 16 bits where the vocabulary allows, else 32), beside each
an .idx (int64: the number of documents n, n + 1 offsets in tokens from the part's start, n document ids) and manifest.json
with each part's base. Bases are prefix sums over the parts' totals, so parts are written at the same time. A task goes on
to its next part at a fixed size.
"""

from __future__ import annotations

import json
import mmap
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.symbols import byte_symbols
from lodestone.llm import word_bpe
from lodestone.llm.common import documents, gathered, scratch, tidied
from lodestone.sources.files import filesystem, publish, settle

END = 2
#: Words and chunks that a worker keeps, and bytes of text looked at together: a batch tells its repeats apart faster than a large memory does.
REMEMBERED, BATCH = 120_000, 32 << 20
#: A part ends with the document that reaches so many bytes or documents; a row of ids that is read back at once, about so many tokens.
PART_BYTES, PART_DOCS, PIECE = 256 << 20, 1 << 20, 1 << 20
#: Stands for a null document id in an index file.
NULL_ID = -(1 << 63)


class WordIds:
    """Texts to ids as bytes, from the tokenizers library, which sees each new word of a batch once.

    Words are split here as the file's normaliser and pre-tokenizer would; its model alone, in the library, turns them
    into ids, many at a time, and the tokens that end words tell them apart. The first `remembered` words and chunks stay
    known. Texts with special strings or rare characters go through the whole file's tokenizer as they are.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.exact, self.most, self.known = Tokenizer.from_file(path), remembered, {}
        self.model = Tokenizer(self.exact.model)
        vocabulary = self.exact.get_vocab()
        size = max(vocabulary.values()) + 1
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(word_bpe.END_OF_WORD)]] = True
        self.symbols = dict(enumerate(byte_symbols()))
        self.chunks = word_bpe.Chunks(self._chunks, remembered)

    def raw(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _symbols(self, word: str) -> str:
        return word if word.isascii() and word.isalpha() else word.encode().decode("latin-1").translate(self.symbols)

    def words(self, words: list[str], step: int = 5000) -> Iterator[bytes]:
        """Each word's ids."""
        width = self.kind.itemsize
        for at in range(0, len(words), step):
            part = words[at : at + step]
            (found,) = self.model.encode_batch_fast([list(map(self._symbols, part))], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(found.ids, self.kind)
            cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * width).tolist()]
            body = ids.tobytes()
            yield from (body[a:b] for a, b in zip(cuts, cuts[1:], strict=False))

    def _chunks(self, chunks: list[list[str]]) -> Iterator[bytes]:
        known = self.known
        new = list(set().union(*chunks).difference(known))
        known.update(zip(new, self.words(new), strict=True))
        for words in chunks:
            yield b"".join(map(known.__getitem__, words))
        for word in new[max(0, self.most - len(known) + len(new)) :]:
            del known[word]

    def texts(self, texts: list[str]) -> list[bytes]:
        odd = {i: self.raw(self.exact.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts) if word_bpe.has_special(t) or not word_bpe.is_plain(t)}
        bounds, numbers, values = self.chunks(["" if i in odd else t for i, t in enumerate(texts)])
        taken = pa.array(values, pa.large_binary()).take(numbers)
        ends, body = np.frombuffer(taken.buffers()[1], "<i8")[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, "<i8"), memoryview(taken.buffers()[2] or b"")
        cuts = ends[bounds]
        return [odd[i] if i in odd else bytes(body[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


_ids: dict[str, WordIds] = {}


class _Part:
    """A part's two files on their way; both get their names in settle()."""

    def __init__(self, path: str, name: str, width: int):
        self.where, self.inner = filesystem(path)
        self.path, self.name, self.width = path, name, width
        self.where.create_dir(self.inner, recursive=True)
        self.temp = f"{self.inner}/{name}.bin.{uuid.uuid4().hex}.tmp"
        self.out, self.docs, self.ends = self.where.open_output_stream(self.temp), array("q"), array("q", [0])
        self.held: list[bytes] = []

    def add(self, doc: int | None, raw: bytes) -> None:
        self.held.append(raw)
        self.docs.append(NULL_ID if doc is None else doc)
        self.ends.append(self.ends[-1] + len(raw) // self.width)

    def write(self) -> None:
        self.out.write(b"".join(self.held))
        self.held.clear()

    def full(self, part_bytes: int) -> bool:
        return self.ends[-1] * self.width >= part_bytes or len(self.docs) >= PART_DOCS

    def settle(self) -> dict:
        self.write()
        self.out.close()
        settle(self.where, self.temp, f"{self.inner}/{self.name}.bin")
        index = b"".join(np.frombuffer(a, np.int64).astype("<i8").tobytes() for a in (array("q", [len(self.docs)]), self.ends, self.docs))
        publish(f"{self.path}/{self.name}.idx", index)
        return {"name": self.name, "docs": len(self.docs), "tokens": self.ends[-1], "width": self.width}


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, part_bytes: int = PART_BYTES) -> str:
    """Write every document's ids and the end id, in ascending order of document id (nulls first, ties by text); gives the path.

    Null and empty texts hold the end id alone; repeated rows are written as often as they come; an empty table gives
    a manifest without parts. Tasks are ranges of the order, by id, a hash of the text and the row's place, so neither an
    id nor a row that repeats can fill a task. A part is written under another name and renamed: a task that runs again
    leaves the same files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _ids:
            _ids[tokenizer] = WordIds(tokenizer)
        ids, made, part = _ids[tokenizer], [], None
        stop = ids.raw([end])
        for batch in gathered(batches, BATCH):
            for doc, raw in zip(batch.column(0).to_pylist(), ids.texts(batch.column(1).to_pylist()), strict=True):
                if part is None:
                    part = _Part(path, f"part-{TaskContext.get().partitionId():05d}-{len(made):03d}", ids.kind.itemsize)
                part.add(doc, raw + stop)
                if part.full(part_bytes):
                    made.append(part.settle())
                    part = None
            if part:
                part.write()
        if part:
            made.append(part.settle())
        if made:
            yield pa.RecordBatch.from_pylist(made)

    order = (F.col("_id").asc_nulls_first(), F.col("_hash"), F.col("_text"))
    rows = documents(docs, id_col, text_col, F.xxhash64(F.col(text_col).cast("string")).alias("_hash"), F.monotonically_increasing_id().alias("_place"))
    rows = rows.repartitionByRange(*order[:2], "_place").sortWithinPartitions(*order).select("_id", "_text")
    totals = sorted(rows.mapInArrow(tidied(write), "name string, docs long, tokens long, width long").collect())  # one row a part
    bases = [0, *accumulate(t["tokens"] for t in totals)]
    parts = [t.asDict() | {"base": base} for t, base in zip(totals, bases, strict=False)]
    publish(f"{path}/manifest.json", json.dumps({"format": "token-files", "version": 2, "end": end, "tokens": bases[-1], "parts": parts}).encode())
    return path


class _Bytes:
    """A file's bytes from a to b: mapped where the file is local, else read as a range through Arrow's file system."""

    def __init__(self, path: str):
        where, inner = filesystem(path)
        self.file, self.map = None, None
        if where.type_name == "local":
            with open(inner, "rb") as f:
                self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        else:
            self.file = where.open_input_file(inner)

    def __getitem__(self, span: slice) -> bytes:
        if self.map is not None:
            return self.map[span]
        self.file.seek(span.start)
        return self.file.read(span.stop - span.start)


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id", keep_ids: bool = True) -> DataFrame:
    """A row per document: id, start (over all parts), n_tokens, ids_crc32 and, with keep_ids, ids (little-endian unsigned 32-bit)."""
    with (x := filesystem(f"{path}/manifest.json"))[0].open_input_stream(x[1]) as f:
        parts = json.loads(f.read())["parts"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            index, ids, n, width = _Bytes(f"{path}/{row['name']}.idx"), _Bytes(f"{path}/{row['name']}.bin"), row["docs"], row["width"]
            longs = lambda a, b: np.frombuffer(index[8 * a : 8 * b], "<i8")  # noqa: B023,E731
            at = 0
            while at < n:
                ends = longs(1 + at, 2 + min(n, at + 1000))
                to = at + max(1, int(np.searchsorted(ends, ends[0] + PIECE, "right")) - 1)
                ends, own = ends[: to - at + 1], longs(2 + n + at, 2 + n + to)
                body = np.frombuffer(ids[width * int(ends[0]) : width * int(ends[-1])], f"<u{width}").astype("<u4").tobytes()
                cuts = (4 * (ends - ends[0])).tolist()
                raw = [body[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                columns = [pa.array(own, mask=own == NULL_ID), pa.array(ends[:-1] + row["base"]), pa.array(np.diff(ends)), pa.array(map(zlib.crc32, raw), pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(raw, pa.binary())] if keep_ids else [])], names=["_id", "start", "n_tokens", "ids_crc32", *(["ids"] if keep_ids else [])])
                at = to

    rows = [(p["name"], p["docs"], p["width"], p["base"]) for p in parts]
    listed = spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, len(rows))), "name string, docs long, width long, base long")  # a task a part
    return listed.mapInArrow(tidied(read), "_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids).withColumnRenamed("_id", id_col)


def encode_to_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, keep_ids: bool = False) -> DataFrame:
    """write_tokens() to the shared folder, then read_tokens()."""
    path = write_tokens(docs, scratch(docs.sparkSession, "tokens"), tokenizer, id_col, text_col, end)
    return read_tokens(docs.sparkSession, path, id_col, keep_ids)
