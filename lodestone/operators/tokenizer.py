"""Byte-level pair encoding: pretokens, frequencies, training over distinct segments, encoding and decoding.

Ids 0 to 7 are control tokens, 8 to 263 bytes in the order of their printable characters, and merges follow from 264 on in
the order in which they were learnt.
"""

from __future__ import annotations

import atexit
import heapq
from collections import Counter, defaultdict
from collections.abc import Callable, Collection, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.symbols import BYTE_IDS, BYTES_FROM, IN_ORDER
from lodestone.operators.chat import SPECIAL_IDS
from lodestone.operators.shards import byte_tokens
from lodestone.operators.tensors import let
from lodestone.session import drop, saved, scratch
from lodestone.ship import ship

MERGES_FROM, MOST_IDS = 264, 1 << 16
#: What counts as white space, and the pattern of pretokens. A run of blanks leaves its last one to what follows.
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
_exact = regex.compile(PATTERN).findall


def pretokens(text: Column, mode: str = "gpt2") -> Column:
    """Segments of a text; none of an empty one. Unicode classes are Java's; pretokens_exact() follows Python's newer tables."""
    if mode == "none":
        return F.when(F.octet_length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def split_text(text: str, mode: str = "gpt2") -> list[str]:
    return ([text] if text else []) if mode == "none" else _exact(text)


def pretokens_exact(text: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([None if t is None else split_text(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(text)


def segment_frequencies(docs: DataFrame, text: str, mode: str = "gpt2") -> DataFrame:
    """(segment, frequency): counted in every task before the shuffle."""
    return docs.select(F.explode(pretokens(F.col(text), mode)).alias("segment")).groupBy("segment").agg(F.count("*").alias("frequency"))


def pair_counts(frequencies: DataFrame) -> DataFrame:
    """(left, right, count): adjacent ids of all segments, by the segments' frequencies."""
    both = lambda ids: F.zip_with(F.slice(ids, F.lit(1), F.size(ids) - 1), F.slice(ids, F.lit(2), F.size(ids) - 1), lambda x, y: F.struct(x.alias("left"), y.alias("right")))
    rows = frequencies.filter(F.octet_length("segment") > 1)
    # let and explode_outer: the ids of a segment are worked out once, and not again in a filter that Spark infers
    rows = rows.select("frequency", F.explode_outer(let(byte_tokens(F.col("segment")), both)).alias("p"))
    return rows.groupBy(F.col("p.left").alias("left"), F.col("p.right").alias("right")).agg(F.sum("frequency").alias("count"))


def best_pair(counts: DataFrame) -> DataFrame:
    """The most frequent pair, the smaller one in ties."""
    return counts.orderBy(F.desc("count"), "left", "right").limit(1)


def merged(ids: Column, left: int, right: int, new: int) -> Column:
    """Ids with each occurrence of the pair replaced, from the left, without overlap."""
    start = F.array().cast("array<int>")

    def step(acc: Column, x: Column) -> Column:
        return F.when((F.element_at(acc, -1) == left) & (x == right), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.lit(new)))).otherwise(F.concat(acc, F.array(x)))

    empty_safe = lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).otherwise(step(acc, x))
    return F.aggregate(ids, start, empty_safe)


@dataclass(frozen=True)
class BytePairs:
    """A vocabulary by its merges. Wrong merges (control tokens, ids not yet made, repeats) are refused."""

    merges: tuple[tuple[int, int], ...]
    mode: str = "gpt2"
    vocabulary: list[bytes | None] = field(default_factory=list, compare=False, repr=False)
    ranks: dict[tuple[int, int], int] = field(default_factory=dict, compare=False, repr=False)
    known: dict[str, list[int]] = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self):
        if MERGES_FROM + len(self.merges) > MOST_IDS:
            raise ValueError("more ids than 16 bits hold")
        self.vocabulary.extend([*[None] * BYTES_FROM, *(bytes([b]) for b in IN_ORDER)])
        for k, (a, b) in enumerate(self.merges):
            if not (BYTES_FROM <= a < MERGES_FROM + k and BYTES_FROM <= b < MERGES_FROM + k):
                raise ValueError(f"merge {k} names an id that can't be merged")
            if self.ranks.setdefault((a, b), k) != k:
                raise ValueError(f"merge {k} repeats a pair")
            self.vocabulary.append(self.vocabulary[a] + self.vocabulary[b])

    def encode_bytes(self, data: bytes) -> list[int]:
        """The pair learnt first goes first, from the left; by a heap over linked neighbours, so long inputs stay fast."""
        ids = [BYTE_IDS[b] for b in data]
        n, ranks = len(ids), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or self.merges[rank] != (ids[i], ids[j]):
                continue
            ids[i], ids[j] = MERGES_FROM + rank, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := ranks.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (r, a))
        return [x for x in ids if x >= 0]

    def encode(self, text: str, special: Collection[str] = ()) -> list[int]:
        """Pretokens one by one; control strings only where they are named in `special`."""
        if unknown := set(special) - set(SPECIAL_IDS):
            raise ValueError(f"no control tokens: {sorted(unknown)}")
        if special:
            cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=lambda s: (-len(s), s))) + ")")
            return [x for k, part in enumerate(cut.split(text)) for x in ([SPECIAL_IDS[part]] if k % 2 else self.encode(part))]
        out: list[int] = []
        for segment in split_text(text, self.mode):
            if (ids := self.known.get(segment)) is None:
                ids = self.encode_bytes(segment.encode())
                if len(self.known) < 65_536:
                    self.known[segment] = ids
            out += ids
        return out

    def decode_bytes(self, ids: Iterable[int], render_special: bool = False) -> bytes:
        names, out = list(SPECIAL_IDS), bytearray()
        for x in ids:
            if not 0 <= x < len(self.vocabulary):
                raise ValueError(f"id {x} is outside the vocabulary")
            if (value := self.vocabulary[x]) is None:
                if not render_special:
                    raise ValueError(f"id {x} is a control token")
                value = names[x].encode()
            out += value
        return bytes(out)

    def decode(self, ids: Iterable[int], render_special: bool = False, errors: str = "strict") -> str:
        return self.decode_bytes(ids, render_special).decode("utf-8", errors)


class _Segments:
    """Distinct segments with an index from pairs to the segments that hold them; a merge touches those alone."""

    def __init__(self, frequencies: Iterable[tuple[bytes, int]]):
        self.rows = [([BYTE_IDS[b] for b in s], n) for s, n in sorted(frequencies)]
        self.counts: Counter = Counter()
        self.where: dict[tuple[int, int], set[int]] = defaultdict(set)
        for k in range(len(self.rows)):
            self._count(k, 1)
        self.heap = [(-n, p) for p, n in self.counts.items()]
        heapq.heapify(self.heap)

    def _count(self, k: int, sign: int) -> set:
        ids, n = self.rows[k]
        pairs = list(zip(ids, ids[1:], strict=False))
        for p in pairs:
            self.counts[p] += sign * n
            (self.where[p].add if sign > 0 else self.where[p].discard)(k)
        return set(pairs)

    def best(self) -> tuple[tuple[int, int], int] | None:
        while self.heap:
            n, p = self.heap[0]
            if self.counts[p] == -n and n < 0:
                return p, -n
            heapq.heappop(self.heap)
        return None

    def merge(self, pair: tuple[int, int], new: int) -> None:
        if not self.counts[pair]:
            raise ValueError(f"{pair} is in no segment")
        changed: set = set()
        for k in list(self.where[pair]):
            changed |= self._count(k, -1)
            ids, n = self.rows[k]
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and (ids[i], ids[i + 1]) == pair:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            self.rows[k] = out, n
            changed |= self._count(k, 1)
        for p in changed:
            if self.counts[p] > 0:
                heapq.heappush(self.heap, (-self.counts[p], p))


#: Bytes of distinct segments that the driver takes; its lists and sets hold some 70 bytes for each.
DRIVER_BYTES = 4 << 20
#: The most frequent pairs that are looked at in a round over tables.
RANKED = 512


def _replaced(ids: np.ndarray, owner: np.ndarray, merges: Sequence[tuple[tuple[int, int], int]]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Ids of many segments on end (owner: the segment of each) with pairs replaced one after the other, and how often."""
    hits = []
    for (a, b), new in merges:
        at = np.flatnonzero((ids[:-1] == a) & (ids[1:] == b) & (owner[:-1] == owner[1:]))
        if a == b and len(at):  # of a run every other one, from the left
            first = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            at = at[(at - np.repeat(at[first], np.diff(np.r_[first, len(at)]))) % 2 == 0]
        hits.append(len(at))
        if len(at):
            ids[at] = new
            ids, owner = np.delete(ids, at + 1), np.delete(owner, at + 1)
    return ids, owner, hits


#: Segments of a block: a block is a row of three binary columns, so that the JVM moves few and large values.
BLOCK = 1 << 15
_BLOCKS = "ids binary, sizes binary, frequency binary"


def _packed(ids: np.ndarray, sizes: np.ndarray, frequency: np.ndarray) -> pa.RecordBatch:
    columns = (ids.astype("<i4"), sizes.astype("<i4"), frequency.astype("<i8"))
    return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=["ids", "sizes", "frequency"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, the segment of each, the segments' frequencies) of each block."""
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            ids, sizes, frequency = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, ("<i4", "<i4", "<i8"), strict=True))
            yield ids.copy(), np.repeat(np.arange(len(sizes)), sizes), frequency


def _from_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, texts, counts = np.array(BYTE_IDS, np.int32), [], []

    def block() -> pa.RecordBatch:
        return _packed(table[np.frombuffer(b"".join(texts), np.uint8)], np.array(list(map(len, texts))), np.array(counts))

    for batch in batches:
        texts += batch.column(0).cast(pa.binary()).to_pylist()
        counts += batch.column(1).to_pylist()
        if len(texts) >= BLOCK:
            yield block()
            texts, counts = [], []
    if texts:
        yield block()


def _with_merges(merges: Sequence[tuple[tuple[int, int], int]]):
    """Segments with the pairs replaced; those of a single id, which hold no pair any more, go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, owner, frequency in _unpacked(batches):
            ids, owner, _ = _replaced(ids, owner, merges)
            sizes = np.bincount(owner, minlength=len(frequency))
            stay = sizes > 1
            yield _packed(ids[stay[owner]], sizes[stay], frequency[stay])

    return run


def _with_hits(merges: Sequence[tuple[tuple[int, int], int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, owner, _ in _unpacked(batches):
            hits = _replaced(ids, owner, merges)[2]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(hits)), pa.int64()), pa.array(hits, pa.int64())], names=["k", "hits"])

    return run


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(left << 16 | right, count) of each block."""
    for ids, owner, frequency in _unpacked(batches):
        at = np.flatnonzero(owner[:-1] == owner[1:])
        pairs = ids[at].astype(np.int64) << 16 | ids[at + 1]
        order = np.argsort(pairs, kind="stable")
        if len(order):
            pairs, counts = pairs[order], frequency[owner[at[order]]]
            first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(pairs[first]), pa.array(np.add.reduceat(counts, first))], names=["pair", "count"])


def _apart(ranked: Sequence[tuple[tuple[int, int], int]]) -> list[tuple[tuple[int, int], int]]:
    """The first pairs by rank that the greedy loop takes one after the other whatever it merges of them.

    No pair starts with an id that another one ends with, so merging one takes no occurrence from another. A pair that
    such a merge makes, (x, new), (new, y) or (new, new), is at each of its places one that was ranked behind, with a
    greater id in it: neither its count nor, in ties, its ids bring it forward. A pair of equal ids goes alone.
    """
    out, lefts, rights = [], set(), set()
    for (a, b), n in ranked:
        if out and (a == b or a in rights or b in lefts):
            break
        out.append(((a, b), n))
        lefts.add(a)
        rights.add(b)
        if a == b:
            break
    return out


class _Tables:
    """Segments as a table in the shared folder; a round counts its pairs, takes several merges and writes it anew."""

    def __init__(self, frequencies: DataFrame):
        ship(frequencies.sparkSession)
        self.path = None
        self._write(frequencies.filter(F.octet_length("segment") > 1).select("segment", "frequency").mapInArrow(_from_bytes, _BLOCKS))

    def _write(self, rows: DataFrame) -> None:
        spark, old = rows.sparkSession, self.path
        self.path = scratch(spark, "segments")
        atexit.register(drop, self.path)
        rows.write.parquet(self.path)
        self.rows = spark.read.schema(rows.schema).parquet(self.path)
        if old:
            drop(old)

    def replay(self, merges: Sequence[tuple[tuple[int, int], int]]) -> None:
        hits = {r["k"]: r["n"] for r in self.rows.mapInArrow(_with_hits(merges), "k long, hits long").groupBy("k").agg(F.sum("hits").alias("n")).collect()}
        for k, (pair, _) in enumerate(merges):
            if not hits.get(k):
                raise ValueError(f"{pair} is in no segment")
        self.merge(merges)

    def merge(self, merges: Sequence[tuple[tuple[int, int], int]]) -> None:
        self._write(self.rows.mapInArrow(_with_merges(merges), _BLOCKS))

    def best(self) -> list[tuple[tuple[int, int], int]]:
        counts = self.rows.mapInArrow(_pair_sums, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("n"))
        return _apart([((r["pair"] >> 16, r["pair"] & 0xFFFF), r["n"]) for r in counts.orderBy(F.desc("n"), "pair").limit(RANKED).collect()])


def train(docs: DataFrame, text: str, size: int, least: int = 2, mode: str = "gpt2", first: Sequence[tuple[int, int]] = (), most_segments: int = 5_000_000, on_merge: Callable[[tuple, int], None] | None = None, pause_after: int | None = None) -> BytePairs:
    """Merges up to a vocabulary of `size` or until the best pair is rarer than `least`; `first` are replayed.

    pause_after: at most so many new merges; their result goes in as `first` to carry on, and a finished one stays as it is.

    The corpus is counted by Spark. Up to `most_segments` distinct segments of DRIVER_BYTES in all the greedy loop runs on
    the driver, as each merge depends on the last; beyond that, segments stay in tables and a round takes several merges
    that the loop would take one by one. Both give the same merges.
    """
    if not MERGES_FROM <= size <= MOST_IDS or least < 1 or MERGES_FROM + len(first) > size:
        raise ValueError("the vocabulary can't have that size")
    frequencies = saved(segment_frequencies(docs, text, mode), "frequencies")
    n, held = frequencies.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("segment")), F.lit(0))).first()
    merges = list(first)
    stop = size if pause_after is None else min(size, MERGES_FROM + len(merges) + pause_after)
    if n > most_segments or held > DRIVER_BYTES:
        tables = _Tables(frequencies)
        if merges:
            tables.replay([(pair, MERGES_FROM + k) for k, pair in enumerate(merges)])
        while MERGES_FROM + len(merges) < stop and (found := [x for x in tables.best() if x[1] >= least][: stop - MERGES_FROM - len(merges)]):
            tables.merge([(pair, MERGES_FROM + len(merges) + k) for k, (pair, _) in enumerate(found)])
            for pair, count in found:
                merges.append(pair)
                if on_merge:
                    on_merge(tuple(merges), count)
        return BytePairs(tuple(merges), mode)
    rows = frequencies.toArrow()
    segments = _Segments((s.encode(), n) for s, n in zip(rows["segment"].to_pylist(), rows["frequency"].to_pylist(), strict=True))
    for k, pair in enumerate(merges):
        segments.merge(pair, MERGES_FROM + k)
    while MERGES_FROM + len(merges) < stop and (found := segments.best()) and found[1] >= least:
        segments.merge(found[0], MERGES_FROM + len(merges))
        merges.append(found[0])
        if on_merge:
            on_merge(tuple(merges), found[1])
    return BytePairs(tuple(merges), mode)


def _replace_pair(ids: list[int], pair: tuple[int, int], new: int) -> list[int]:
    out: list[int] = []
    for x in ids:
        if out and (out[-1], x) == pair:
            out[-1] = new
        else:
            out.append(x)
    return out


def plain_merges(frequencies: DataFrame, most: int, least: int = 2) -> list[tuple[int, int]]:
    """Merges by the definition alone, for checks on samples: all pairs are counted anew for each merge."""
    rows = [([BYTE_IDS[b] for b in r["segment"].encode()], r["frequency"]) for r in frequencies.toLocalIterator()]
    merges: list[tuple[int, int]] = []
    while len(merges) < most:
        counts: Counter = Counter()
        for ids, n in rows:
            for p in zip(ids, ids[1:], strict=False):
                counts[p] += n
        best = min(counts, key=lambda p: (-counts[p], p), default=None)
        if best is None or counts[best] < least:
            break
        rows = [(_replace_pair(ids, best, MERGES_FROM + len(merges)), n) for ids, n in rows]
        merges.append(best)
    return merges


def plainly_encoded(spark, pairs: BytePairs, text: Column) -> Column:
    """What encoded() gives, by the definition alone: merges are applied one after the other, in their order."""
    shared = ship(spark).sparkContext.broadcast((pairs.merges, pairs.mode))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        merges, mode = shared.value
        for texts in batches:
            out = []
            for t in texts.to_pylist():
                parts = [[BYTE_IDS[b] for b in s.encode()] for s in split_text(t, mode)]
                for k, pair in enumerate(merges):
                    parts = [_replace_pair(ids, pair, MERGES_FROM + k) if len(ids) > 1 else ids for ids in parts]
                out.append([x for ids in parts for x in ids])
            yield pa.array(out, pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(F.coalesce(text, F.lit("")))


def encoded(spark, pairs: BytePairs, text: Column, whole: bool = False, special: Collection[str] = ()) -> Column:
    """Ids of a text column. whole: the bytes of the text at once, as shards are built; else by pretokens, as chats are."""
    shared = ship(spark).sparkContext.broadcast((pairs.merges, pairs.mode))  # 65,272 merges at most
    special = tuple(special)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = BytePairs(*shared.value)
        for texts in batches:
            yield pa.array([None if t is None else own.encode_bytes(t.encode()) if whole else own.encode(t, special) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(text)


def encoded_each(spark, pairs: BytePairs, texts: Column) -> Column:
    """Ids of each text of an array column, by pretokens, as messages of a chat are encoded."""
    shared = ship(spark).sparkContext.broadcast((pairs.merges, pairs.mode))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = BytePairs(*shared.value)
        for rows in batches:
            yield pa.array([None if r is None else [None if t is None else own.encode(t) for t in r] for r in rows.to_pylist()], pa.list_(pa.list_(pa.int32())))

    return F.arrow_udf(run, "array<array<int>>")(texts)


def decoded(spark, pairs: BytePairs, ids: Column, render_special: bool = False, errors: str = "strict") -> Column:
    shared = ship(spark).sparkContext.broadcast((pairs.merges, pairs.mode))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = BytePairs(*shared.value)
        for rows in batches:
            yield pa.array([None if r is None else own.decode(r, render_special, errors) for r in rows.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(ids)
