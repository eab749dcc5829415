"""Packing token sequences: bounded-space online best fit.

Each partition keeps at most `windows` open windows. A document goes whole to the open window that it fills best, or to
a new one; where none fits and all are open, the fullest is topped up with the head of the document and emitted, and the
rest is placed again. What stays open at the end is merged inside the partition, then across groups of partitions.
The last incomplete window of a group is cut into lengths that are powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import documents, pieces, tidied
from lodestone.llm.word_bpe import is_plain
from lodestone.session import saved

LENGTH, END, WINDOWS, GROUP = 2048, 1, 64, 256
_SPECIAL = "<|endoftext|>"
_encoders: dict[str, "ByteEncoder"] = {}


class ByteEncoder:
    """Ids that the tokenizers library gives for a byte-level BPE file.

    Plain texts go through tiktoken with the same ranks, which gives the same ids several times faster; texts with a
    special string or with characters on which the two libraries' Unicode tables might differ go through tokenizers, and
    so do those that tiktoken's pattern gives up on (runs of about a million blanks).
    """

    def __init__(self, json_path: str, ranks_path: str | None):
        self.path, self.fast = json_path, None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding(json_path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def exact(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and _SPECIAL not in text and is_plain(text):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # the pattern's stack is full
                pass
        return np.array(self.exact.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)


def encoder(json_path: str, ranks_path: str | None) -> ByteEncoder:
    key = f"{json_path} {ranks_path}"
    if key not in _encoders:
        _encoders[key] = ByteEncoder(json_path, ranks_path)
    return _encoders[key]


class Packer:
    """A piece: (doc id, start, its ids, tokens of the document). emit: takes a whole window, a list of pieces."""

    def __init__(self, length: int, windows: int):
        self.length, self.most = length, windows
        self.open: list[tuple[int, int, list]] = []  # by room left
        self.made = 0

    def _keep(self, room: int, window: list) -> None:
        self.made += 1
        bisect.insort(self.open, (room, self.made, window), key=lambda x: x[:2])

    def place(self, doc, start: int, ids: np.ndarray, total: int) -> Iterator[list]:
        while len(ids) >= self.length:
            yield [(doc, start, ids[: self.length], total)]
            start, ids = start + self.length, ids[self.length :]
        while len(ids):
            at = bisect.bisect_left(self.open, len(ids), key=lambda x: x[0])
            if at < len(self.open):
                room, _, window = self.open.pop(at)
                window.append((doc, start, ids, total))
                if room == len(ids):
                    yield window
                else:
                    self._keep(room - len(ids), window)
                return
            if len(self.open) < self.most:
                self._keep(self.length - len(ids), [(doc, start, ids, total)])
                return
            room, _, window = self.open.pop(0)
            window.append((doc, start, ids[:room], total))
            yield window
            start, ids = start + room, ids[room:]

    def rest(self) -> Iterator[list]:
        """Merges the open windows; the last one yielded may be incomplete."""
        left = [w for _, _, w in self.open]
        self.open = []
        yield from joined((p for w in left for p in w), self.length)


def joined(parts, length: int) -> Iterator[list]:
    window, room = [], length
    for doc, start, ids, total in parts:
        while len(ids):
            window.append((doc, start, ids[:room], total))
            start, ids, room = start + len(ids[:room]), ids[room:], room - len(ids[:room])
            if not room:
                yield window
                window, room = [], length
    if window:
        yield window


def powers(parts: list) -> Iterator[list]:
    """An incomplete window cut into sequences whose lengths are powers of two."""
    left = sum(len(p[2]) for p in parts)
    parts = list(parts)
    while left:
        size = 1 << left.bit_length() - 1
        window, room = [], size
        while room:
            doc, start, ids, total = parts.pop(0)
            window.append((doc, start, ids[:room], total))
            if len(ids) > room:
                parts.insert(0, (doc, start + room, ids[room:], total))
            room -= min(room, len(ids))
        yield window
        left -= size


_FIELDS = [("_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("whole", pa.bool_())]
_SCHEMA = "_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, whole boolean"


def _batch(windows: list[tuple[int, list, bool]], keep: bool) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in _FIELDS]
    for seq, window, whole in windows:
        at = 0
        for doc, start, ids, total in window:
            raw = ids.astype("<u4").tobytes()
            for c, v in zip(columns, (doc, start, len(ids), zlib.crc32(raw), total, seq, at, raw if keep or not whole else None, whole), strict=True):
                c.append(v)
            at += len(ids)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, windows: int = WINDOWS, group: int = GROUP, keep_ids: bool = True) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with keep_ids, ids (little-endian unsigned 32-bit).

    A null or empty text is the end token alone; null ids are kept; repeated rows are packed as often as they come;
    longer documents are cut; an empty table gives no row. Memory: `windows` open windows and one document's ids.
    Sequence ids: 2^32 times the partition plus a running number; merged leftovers have negative ones.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, seq = encoder(json_path, ranks_path), Packer(length, windows), TaskContext.get().partitionId() << 32
        ready: list[tuple[int, list, bool]] = []
        for batch in pieces(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text), np.uint32(end)).astype(np.uint32)
                for window in packer.place(doc, 0, ids, len(ids)):
                    ready.append((seq, window, True))
                    seq += 1
                if len(ready) >= 1000:
                    yield _batch(ready, keep_ids)
                    ready = []
        for window in packer.rest():
            ready.append((seq, window, sum(len(p[2]) for p in window) == length))
            seq += 1
        yield _batch(ready, keep_ids)

    def last(t: pa.Table) -> pa.Table:
        t = t.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        rows = [(d, s, np.frombuffer(raw, "<u4"), n) for d, s, raw, n in zip(*(t[c].to_pylist() for c in ("_id", "start", "ids", "doc_tokens")), strict=True)]
        seq, out = -1 - t["sequence_id"][0].as_py(), []
        for window in joined(rows, length):
            for cut in [window] if sum(len(p[2]) for p in window) == length else powers(window):
                out.append((seq, cut, True))
                seq -= 1
        return pa.Table.from_batches([_batch(out, keep_ids)])

    made = saved(documents(docs, id_col, text_col).mapInArrow(tidied(first), _SCHEMA), "packed")
    # at most one incomplete window of each partition; `group` partitions at a time
    merged = made.filter("not whole").groupBy(F.expr(f"shiftright(sequence_id, 32) div {group}").alias("_group")).applyInArrow(last, _SCHEMA)
    out = made.filter("whole").unionByName(merged)
    return out.select(F.col("_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else []))
