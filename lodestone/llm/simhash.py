"""SimHash near-duplicates: 64-bit fingerprints that differ in at most two bits, found by deletion-variant signatures.

A fingerprint is cut into two segments of 32 bits. Of two fingerprints that differ in at most two bits, either the upper
segments differ in at most one, or the lower ones are equal and the upper ones differ in two. So each distinct
fingerprint is indexed under its upper segment with each bit in turn as a wildcard (32 keys) and under its lower segment
(one key); equal keys bring candidates together, and the number of differing bits is verified. Each link appears under
one key only. Keys that more than `most` fingerprints share are not compared pair by pair: their fingerprints are
indexed once more under all 2016 ways to leave out two of the 64 bits. Such a key holds four fingerprints at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lodestone.llm.common import documents, pieces, small, tidied
from lodestone.llm.components import components
from lodestone.session import saved

SHINGLE, SEED, DISTANCE, MOST = 3, 42, 2, 256
#: Rows of one fingerprint from which on it is looked up by a broadcast, and not in one task.
HOT = 1 << 16


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """0 without words. bytes.lower() and bytes.split() know ASCII only, as asked for."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < size:
        words, size = [b" ".join(words)], 1
    line, h, at, starts, ends = b" ".join(words), xxhash.xxh64_intdigest, 0, [], []
    for w in words:
        starts.append(at)
        at += len(w) + 1
        ends.append(at - 1)
    hashes = np.array([h(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=False)], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fps = np.array([fingerprint(t) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["_id", "fp"])

    return documents(docs, id_col, text_col).mapInArrow(tidied(run), "_id long, fp long")


def _links(most: int):
    """From rows sorted by key and fingerprint: links (a, b), and (a, null) for the fingerprints of crowded keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, crowded = np.empty(0, np.int64), np.empty(0, np.int64), None
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy()])
            # what may go on in the next batch stays; of a crowded key only so much that its rest is known as crowded
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut or len(keys) - cut > most:
                done = cut if len(keys) - cut <= most else len(keys)
                out, crowded = _compare(keys[:done], fps[:done], most, crowded)
                yield out
                keys, fps = keys[done:], fps[done:]
        if len(keys):
            yield _compare(keys, fps, most, crowded)[0]

    return run


def _compare(keys: np.ndarray, fps: np.ndarray, most: int, crowded) -> tuple[pa.RecordBatch, object]:
    """crowded: the key, known as crowded, whose rows go on here; given back for the next call."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[first, len(keys)])
    many = (size > most) | (keys[first] == crowded if crowded is not None else False)
    row_many = np.repeat(many, size)
    left = np.repeat(first + size, size) - np.arange(len(keys))  # rows of the key from here on
    links_a, links_b = [], []
    at = np.flatnonzero(~row_many & (left > 1))
    d = 1
    while len(at):
        x, y = fps[at].view(np.uint64), fps[at + d].view(np.uint64)
        up, low = np.bitwise_count((x ^ y) >> np.uint64(32)), np.bitwise_count((x ^ y) & np.uint64(0xFFFFFFFF))
        slot = keys[at] >> 32  # 0 to 31: the upper segment without that bit; 32: the lower segment
        ok = np.where(slot == 32, (up == 2) & (low == 0), (up + low <= DISTANCE) & ((up == 1) | (up == 0) & (slot == 0)))
        links_a.append(fps[at][ok])
        links_b.append(fps[at + d][ok])
        d += 1
        at = at[left[at] > d]
    hot = np.unique(fps[row_many])
    a = np.concatenate([*links_a, hot])
    b = pa.array(np.concatenate([*links_b, hot]), mask=np.r_[np.zeros(len(a) - len(hot), bool), np.ones(len(hot), bool)])
    return pa.RecordBatch.from_arrays([pa.array(a), b], names=["a", "b"]), keys[-1] if row_many[-1] else crowded


def _pairs_of_bits(fps: DataFrame) -> DataFrame:
    """Links among fingerprints through keys without two of the bits; the smallest of a key is linked to the others."""
    masks = [(1 << i | 1 << j) for i, j in combinations(range(64), 2)]
    without = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m) for m in masks))
    rows = fps.select("fp", F.posexplode(without).alias("slot", "mask")).select("fp", F.col("slot").cast("short").alias("slot"), F.col("fp").bitwiseAND(F.bitwise_not("mask")).alias("rest"))
    groups = rows.groupBy("slot", "rest").agg(F.min("fp").alias("a"), F.max("fp").alias("z"), F.collect_set("fp").alias("all")).filter("a < z")
    return groups.select("a", F.explode("all").alias("b")).filter("a < b").distinct()


def links(fps: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b), a < b, of the distinct fingerprints `fp` in fps: links that make the same components as all pairs do."""
    upper = "((fp >> 32) & 4294967295L)"
    keys = F.expr(f"concat(transform(sequence(0, 31), i -> shiftleft(cast(i as long), 32) | ({upper} & ~shiftleft(1L, i))), array(shiftleft(32L, 32) | (fp & 4294967295L)))")
    index = fps.select(F.explode(keys).alias("key"), "fp").repartition("key").sortWithinPartitions("key", "fp")
    found = saved(index.mapInArrow(tidied(_links(most)), "a long, b long"), "links")
    crowded = found.filter("b is null").select(F.col("a").alias("fp")).distinct()
    near = found.filter("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return near if crowded.isEmpty() else near.unionByName(_pairs_of_bits(crowded))


def _named(rows: DataFrame, most: int) -> DataFrame:
    """(fp, component, component_id) of the distinct fingerprints of rows (_id, fp): the smallest fingerprint and id reachable."""
    distinct = saved(rows.groupBy("fp").agg(F.min("_id").alias("least"), F.count("*").alias("n")), "distinct")  # copies never meet as pairs
    linked = components(links(distinct.select("fp"), most)).withColumnRenamed("node", "fp")
    named = distinct.join(linked, "fp", "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return saved(named.join(least, "component").select("fp", "component", "component_id", "n"), "named")


def _look_up(rows: DataFrame, named: DataFrame, hot: int = HOT) -> DataFrame:
    """rows with the component and component_id of their fp; no task gets all rows of a frequent one."""
    frequent = named.filter(F.col("n") >= hot).drop("n")
    n = frequent.count()  # a row for each `hot` rows at most
    if not n or not small(frequent, 32, n):
        return rows.join(named.drop("n"), "fp")
    frequent = F.broadcast(frequent)
    return rows.join(frequent.select("fp"), "fp", "left_anti").join(named.filter(F.col("n") < hot).drop("n"), "fp").unionByName(rows.join(frequent, "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """A row per document: id, fingerprint (16 hexadecimal digits), component_id (the smallest id reachable by links).

    Null, empty and blank texts have fingerprint zero and are linked like any other; repeated rows and ids are kept;
    a null id stays null and names a component only where it has no other id (then null); an empty table gives no row.
    """
    rows = saved(fingerprints(docs, id_col, text_col), "fingerprints")
    out = _look_up(rows, _named(rows, most))
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@F.arrow_udf(LongType())
def _fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array(np.array([fingerprint(t) for t in texts.cast(pa.binary()).to_pylist()], np.uint64).view(np.int64))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """The documents less those with a smaller id in their component; all columns, one row of an id in each component.

    Rows with a null id stay, as nothing names them. An id may name several texts: each goes or stays by its own
    component. Of several rows of one id and component the one with the smallest text stays, ties by the other columns
    as JSON. Only of ids that stay and repeat are the fingerprints worked out again, beside their rows.
    """
    rows = saved(fingerprints(docs, id_col, text_col), "fingerprints")
    found = _look_up(rows.filter("_id is not null"), _named(rows, most))
    found = found.select("_id", "fp", "component", (F.col("_id") == F.col("component_id")).alias("stays"))
    judged = found.groupBy("_id").agg(F.max("stays").alias("stays"), F.count("*").alias("n"))
    judged = saved(judged.filter("not stays or n > 1").select("_id", "stays"), "judged")
    n = judged.count()
    if not n:
        return docs
    key = docs[id_col].cast("long")
    beside = F.broadcast if small(judged, 16, n) else lambda df: df
    kept = docs.join(beside(judged), key == judged["_id"], "left_anti")
    several = judged.filter("stays").select("_id")
    if several.isEmpty():
        return kept
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.join(beside(several), key == several["_id"], "left_semi")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    ones = rows.select(F.col(id_col).cast("long").alias("_key"), _fingerprint(text).alias("_fp"), whole.alias("_row"), F.struct(text.alias("t"), F.to_json(whole).alias("j")).alias("_order"))
    least = (F.min_by("_row", "_order").alias("_row"), F.min("_order").alias("_order"))
    ones = ones.groupBy("_key", "_fp").agg(*least)
    stay = found.filter("stays").join(beside(several), "_id", "left_semi").select(F.col("_id").alias("_key"), F.col("fp").alias("_fp"), F.col("component").alias("_component")).distinct()
    return kept.unionByName(ones.join(stay, ["_key", "_fp"]).groupBy("_key", "_component").agg(*least).select("_row.*"))
