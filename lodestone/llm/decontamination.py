"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items.

Words are runs of digits, ASCII letters (lower-cased) and anything beyond ASCII. Over UTF-8 bytes that is one
translation table: every byte beyond 0x7F belongs to a word. Each word of the benchmark has a code of a few characters,
all of one length and with a first character that no other place has, so a text is scanned once as a string of codes, a
match starts and ends at word borders, and its place in the string tells its words. Windows are cut in Spark and lie in
the shared folder, in passes of bounded size; a worker loads a pass's windows from there, and nothing comes to the driver
but their sizes.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import product

import ahocorasick
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import documents, give_back, pieces, scratch, tidied
from lodestone.session import saved
from lodestone.ship import ship
from lodestone.sources.files import filesystem

WINDOW = 10
#: Bytes of windows in one automaton, which takes some 15 times as much; what goes beyond is scanned for in further passes.
AUTOMATON_BYTES = 8 << 20

_TO_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_DIGITS = 64


def words(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def windows(text: bytes, size: int = WINDOW) -> set[bytes]:
    """The item's windows of `size` words; the whole item where it has fewer; none without words."""
    w = words(text)
    return {b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


class Windows:
    """An automaton over windows, each with the items that hold it."""

    def __init__(self, rows: list[tuple[bytes, str | None]]):
        """rows: (window, item or None)."""
        owners: dict[bytes, list[str]] = defaultdict(list)
        for window, item in rows:
            owners[window] += [] if item is None else [item]
        vocabulary = sorted({w for window in owners for w in window.split(b" ")})
        self.width = 1
        while _DIGITS**self.width < len(vocabulary):
            self.width += 1
        digits = [[chr(0x100 * (k + 1) + d) for d in range(_DIGITS)] for k in range(self.width)]
        self.codes = dict(zip(vocabulary, map("".join, product(*digits)), strict=False))
        self.unknown = "\0" * self.width
        self.made, self.owners = ahocorasick.Automaton(), []
        for k, (window, items) in enumerate(owners.items()):
            own = window.split(b" ")
            self.made.add_word("".join(map(self.codes.__getitem__, own)), (k, len(own)))
            self.owners.append(items)
        self.made.make_automaton()

    def line(self, w: list[bytes]) -> str:
        code, unknown = self.codes.get, self.unknown
        return "".join([code(x, unknown) for x in w])

    def hits(self, w: list[bytes]) -> list[tuple[int, int, int]]:
        """(window, first word, words) of each occurrence among a text's words."""
        if not w or not len(self.made):
            return []
        return [(k, (end + 1) // self.width - n, n) for end, (k, n) in self.made.iter(self.line(w))]

    def any(self, w: list[bytes]) -> bool:
        return bool(w) and len(self.made) > 0 and next(iter(self.made.iter(self.line(w))), None) is not None


_loaded: dict[str, Windows] = {}


def _load(path: str) -> Windows:
    """A pass's windows from the shared folder; a worker holds one pass at a time."""
    if path not in _loaded:
        _loaded.clear()
        where, inner = filesystem(path)
        rows: list = []
        for file in where.get_file_info(pafs.FileSelector(inner, allow_not_found=True)):
            if file.path.endswith(".parquet"):
                with where.open_input_file(file.path) as f:
                    t = pq.read_table(f, columns=["window", "item"])
                rows += zip(t["window"].to_pylist(), t["item"].to_pylist(), strict=True)
        _loaded[path] = Windows(rows)
    return _loaded[path]


def spans(text: bytes, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of word ranges [first, end), which are in order and apart."""
    at = [m.span() for m in _WORD.finditer(text)]
    cuts = [x for first, end in covered for x in (at[first][0], at[end - 1][1])]
    chars, out = 0, []
    for before, cut in zip([0, *cuts], cuts, strict=False):
        chars += len(text[before:cut].decode())
        out.append(chars)
    return list(zip(out[::2], out[1::2], strict=True))


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(set(ranges)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def passes(benchmark: DataFrame, item_col: str, text_col: str, size: int, most: int) -> list[str]:
    """Folders of distinct (window, item), each of about `most` bytes at most; none for a benchmark without words.

    A pass takes pairs of a window and an item by their hash, so a window that very many items hold is spread, too.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1 << 20):  # a text's windows are ten times as long
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                own = list(windows(text, size))
                for at in range(0, len(own), 10_000):
                    part = own[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([None if item is None else str(item)] * len(part), pa.string())], names=["window", "item"])

    spark = benchmark.sparkSession
    rows = documents(benchmark, item_col, text_col).mapInArrow(tidied(cut), "window binary, item string").distinct()
    held = rows.agg(F.sum(F.octet_length("window") + 16)).first()[0] or 0
    n = -(-held // most)
    if not n:
        return []
    path = scratch(spark, "passes")
    number = F.pmod(F.xxhash64("window", "item"), F.lit(n)).cast("int")
    rows.withColumn("pass", number).repartition(max(1, min(n, 4096)), "pass").write.partitionBy("pass").parquet(path)
    return [f"{path}/pass={k}" for k in range(n)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """A row per document: id, n_words, n_hit, items (sorted as strings), spans (character ranges of the original), contaminated.

    Null and empty texts have no words; items without words match nothing; an empty benchmark leaves every document
    clean; repeated rows give repeated rows; a null item id names no item, yet its words count as hit. Other columns
    are left aside. A benchmark with more than automaton_bytes of windows is scanned for in several passes.
    """
    rows = documents(docs, id_col, text_col).select("_id", "_text", F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<a:long,b:long>>)").alias("covered"), F.expr("cast(array() as array<string>)").alias("items"))
    paths = passes(benchmark, item_col, item_text_col, size, automaton_bytes) or [None]
    for k, path in enumerate(paths):
        if k:
            rows = saved(rows, "decontamination")  # each pass loads one automaton
        last = k == len(paths) - 1
        rows = rows.mapInArrow(tidied(_scan(path, last)), _FOUND if last else rows.schema)
    return rows.select(F.col("_id").alias(id_col), "n_words", "n_hit", "items", "spans", (F.col("n_hit") > 0).alias("contaminated"))


_FOUND = "_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
_RANGES, _SPANS = (pa.list_(pa.struct([(x, pa.int64()), (y, pa.int64())])) for x, y in (("a", "b"), ("start", "end")))


def _scan(path: str | None, last: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _load(path) if path else Windows([])
        for batch in pieces(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            n_words, items = [], batch.column(4).to_pylist()
            covered = [[(x["a"], x["b"]) for x in c] for c in batch.column(3).to_pylist()]
            for i, text in enumerate(texts):
                w = words(text)
                n_words.append(len(w))
                if found := made.hits(w):
                    covered[i] = _merged([*covered[i], *((a, a + m) for _, a, m in found)])
                    items[i] = sorted({*items[i], *(x for k in {k for k, _, _ in found} for x in made.owners[k])})
            counts, items = pa.array(n_words, pa.int64()), pa.array(items, pa.list_(pa.string()))
            if last:
                where = [[{"start": a, "end": b} for a, b in spans(t, c)] if c else [] for t, c in zip(texts, covered, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array([sum(b - a for a, b in c) for c in covered], pa.int64()), items, pa.array(where, _SPANS)], names=["_id", "n_words", "n_hit", "items", "spans"])
            else:
                ranges = pa.array([[{"a": a, "b": b} for a, b in c] for c in covered], _RANGES)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts, ranges, items], names=batch.schema.names)

    return scan


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The documents, all columns, without any that hold a window of the benchmark; null texts hold none."""
    ship(docs.sparkSession)
    for k, path in enumerate(passes(benchmark, item_col, item_text_col, size, automaton_bytes)):
        if k:
            docs = saved(docs, "clean")
        docs = docs.filter(~_hit(path)(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return docs


def _hit(path: str):
    @F.arrow_udf("boolean")
    def hit(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made = _load(path)
        for texts in batches:
            yield pa.array([made.any(words(t.as_buffer().to_pybytes())) for t in texts.cast(pa.binary())], pa.bool_())
        give_back()

    return hit


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the contract, from decontaminate()."""
    return found.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")
