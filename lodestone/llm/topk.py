"""Exact top-k search by inner product over a pivot-distance index.

Components become integers. With one more component, the root of M^2 - |x|^2 for vectors and 0 for queries (M: the
largest norm), all vectors have the same norm, so the largest inner products are the smallest distances. Each vector is
keyed by its nearest pivot and its distance to it; a pivot's vectors are spread over segments of bounded size. A query
first searches a segment of the pivots next to it, which bounds the distance of its k-th best. The triangle inequality then
leaves out whole pivots, and inside a segment the sorted annuli beyond the bound: they are expanded from the query's own
distance outwards until none can hold a better vector. Queries go to the segments that the bound leaves, and only vectors
of segments with a query are moved; a task holds one segment and streams its queries past it, so neither is copied.
Bounds have a margin for rounding; scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import tidied
from lodestone.session import saved
from lodestone.ship import ship

K, SCALE, EVERY = 10, 1024, 100
#: Pivots of a length, a bounded sample of vectors drawn by a hash: PIVOTS, and one for each segment's worth of rows up to MOST_PIVOTS.
PIVOTS, MOST_PIVOTS = 64, 1024
#: All pivots together, which go to every task, and a segment, which a task holds, have so many bytes at most.
PIVOT_BYTES, SEGMENT_BYTES = 64 << 20, 32 << 20
#: Rows of a segment of the index and of an annulus at most, and queries that are looked at together.
SEGMENT, ANNULUS, BLOCK = 8192, 512, 1024
#: The most frequent vector lengths have pivots; vectors of others are compared in segments as they come.
LENGTHS = 64
_MARGIN = 1e-6


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE, queries: Column | None = None) -> DataFrame:
    """(id, v, asked): floor(scale * x) of each component; rows without id, vector or with a null or non-finite component don't count.

    A component beyond 64 bits is an error. asked: whether `queries` holds, false where it is null.
    """
    asked = F.lit(False) if queries is None else F.coalesce(queries, F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"), asked.alias("asked")).filter("id is not null and x is not null")
    rows = rows.filter(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    whole = lambda c: F.when(F.abs(F.lit(float(scale)) * c) < 2.0**63, F.floor(F.lit(float(scale)) * c)).otherwise(F.raise_error(F.lit("a component is beyond 64 bits")).cast("long"))
    return rows.select("id", F.transform("x", whole).alias("v"), "asked")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by floating point where every partial sum is exact there, by Python's integers where
    64 bits might not hold them. A score beyond 64 bits is an error."""
    most = float(max(np.abs(q.astype(np.float64)).max(initial=0), 1)) * float(max(np.abs(x.astype(np.float64)).max(initial=0), 1)) * max(q.shape[1], 1)
    if most < 2.0**52:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    if most < 2.0**62:
        return q @ x.T
    whole = q.astype(object) @ x.T.astype(object)
    if any(not -(1 << 63) <= s < 1 << 63 for s in whole.flat):
        raise OverflowError("a score is beyond 64 bits")
    return whole.astype(np.int64)


def _augmented(x: np.ndarray, square: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.c_[x, np.sqrt(np.maximum(square - (x * x).sum(axis=1), 0))]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def reached(square: float, q_square: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The distance that a score stands for, with room for the rounding of squares as large as the norms'."""
    whole = np.maximum(square + q_square - 2 * score, 0)
    return np.sqrt(whole) * (1 + _MARGIN) + _MARGIN * (1 + np.sqrt(square + q_square))


class Best:
    """Each query's k best (score, id) so far, ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.full((queries, k), np.iinfo(np.int64).min)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)
        self.filled = np.zeros((queries, k), bool)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, valid: np.ndarray) -> None:
        """Scores of candidates ids for the queries in rows."""
        s = np.c_[self.scores[rows], np.where(valid, scores, np.iinfo(np.int64).min)]
        i = np.c_[self.ids[rows], np.broadcast_to(ids, scores.shape)]
        f = np.c_[self.filled[rows], valid]
        if s.shape[1] > 4 * self.k:  # whatever ties with the k-th stays for the sort
            least = np.partition(s, -self.k, axis=1)[:, -self.k]
            keep = int((s >= least[:, None]).sum(axis=1).max())
            if keep < s.shape[1] // 2:
                at = np.argsort(s < least[:, None], axis=1, kind="stable")[:, :keep]
                s, i, f = (np.take_along_axis(x, at, axis=1) for x in (s, i, f))
        order = np.lexsort((i, -s, ~f), axis=1)[:, : self.k]
        self.scores[rows], self.ids[rows], self.filled[rows] = (np.take_along_axis(x, order, axis=1) for x in (s, i, f))

    def bound(self) -> np.ndarray:
        """The k-th best score of each query, or the least integer."""
        return np.where(self.filled[:, -1], self.scores[:, -1], np.iinfo(np.int64).min)


class Segment:
    """Vectors of one pivot in annuli by their distance to it."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, dist: np.ndarray, square: float, k: int, annulus: int = ANNULUS):
        order = np.argsort(dist, kind="stable")
        self.ids, self.x, self.square, self.k, self.annulus = ids[order], x[order], square, k, annulus
        dist = dist[order]
        self.cuts = np.arange(0, len(ids), annulus)
        self.low, self.high = dist[self.cuts], dist[np.minimum(self.cuts + annulus, len(ids)) - 1]

    def search(self, qid: np.ndarray, q: np.ndarray, q_dist: np.ndarray, floor: np.ndarray) -> Best:
        """The k best for queries q at distances q_dist from the pivot. floor: a score that k vectors are known to reach."""
        reach = np.maximum(np.maximum(self.low[None, :] - q_dist[:, None], q_dist[:, None] - self.high[None, :]), 0)  # no vector of the annulus is nearer
        turn = np.argsort(reach, axis=1, kind="stable")
        best, q_square = Best(len(qid), self.k), (q.astype(np.float64) ** 2).sum(axis=1)
        alive = np.arange(len(qid))
        for step in range(len(self.cuts)):
            score = np.maximum(best.bound()[alive], floor[alive]).astype(np.float64)
            limit = reached(self.square, q_square[alive], score)
            limit[score <= np.iinfo(np.int64).min / 2] = np.inf
            alive = alive[reach[alive, turn[alive, step]] <= limit]  # the next annuli are farther still
            if not len(alive):
                break
            at = turn[alive, step]
            for c in np.unique(at):
                rows, part = alive[at == c], slice(self.cuts[c], self.cuts[c] + self.annulus)
                best.add(rows, products(q[rows], self.x[part]), self.ids[part][None, :], self.ids[part][None, :] != qid[rows][:, None])
        return best


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_CELL = ["dim", "pivot", "segment"]
_MET = "dim int, pivot int, segment int, query boolean, id long, v array<long>, dist double, floor long"
_LEAST = -(1 << 63)


def _meet(index, k: int, block: int):
    """Over rows sorted by segment, each segment's vectors before its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, segment = None, [], None
        for batch in batches:
            cells = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)]).astype(np.int64)
            cuts = [0, *(np.flatnonzero((cells[:, 1:] != cells[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for at, to in zip(cuts, cuts[1:], strict=False):
                if at == to:
                    continue
                dim, pivot, number, query = cells[:, at].tolist()
                if now != (dim, pivot, number):
                    now, held, segment = (dim, pivot, number), [], None
                part = batch.slice(at, to - at)
                if not query:
                    held.append((part.column(4).to_numpy(), _matrix(part.column(5), dim), part.column(6).to_numpy()))
                    continue
                if not held and segment is None:
                    continue
                marks, square = index.value.get(dim, (np.zeros((1, dim + 1)), np.inf))
                if segment is None:
                    segment, held = Segment(*map(np.concatenate, zip(*held, strict=True)), square, k), []
                for b in range(0, part.num_rows, block):
                    own = part.slice(b, block)
                    qid, q, floor = own.column(4).to_numpy(), _matrix(own.column(5), dim), own.column(7).to_numpy()
                    d = _distances(np.c_[q.astype(np.float64), np.zeros(len(q))], marks[pivot : pivot + 1])[:, 0]
                    best = segment.search(qid, q, d, floor)
                    row, col = np.nonzero(best.filled & (best.scores >= floor[:, None]))
                    yield from pa.table({"query_id": qid[row], "vec_id": best.ids[row, col], "score": best.scores[row, col]}, schema=_FOUND).to_batches()

    return run


def top_k(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE, pivots: int = PIVOTS, segment: int = SEGMENT, block: int = BLOCK, lengths: int = LENGTHS) -> DataFrame:
    """query_id, rank (from 1), id, score: the k largest integer inner products of every row for which `queries` holds.

    Candidates are all rows with another id; fewer than k give fewer rows; ties go to the smaller id; repeated rows are
    candidates each, and a query id that repeats is asked once, with its smallest vector. Rows without id, vector or with
    a null or non-finite component take no part; vectors of another length than the query's are no candidates; an empty
    table gives no row. Components and scores beyond 64 bits are errors. Of the `lengths` most frequent vector lengths
    pivots are drawn; vectors of other lengths are searched whole.
    """
    spark = ship(vectors.sparkSession)
    base = saved(integers(vectors, id_col, vector_col, scale, queries), "integers")
    asked = base.filter("asked").groupBy("id").agg(F.min("v").alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    sizes = base.groupBy(F.size("v").alias("dim")).agg(F.max(square).alias("square"), F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(lengths).collect()
    room = lambda dim: max(1, PIVOT_BYTES // (8 * (dim + 1) * len(sizes)))
    wanted = {r["dim"]: min(room(r["dim"]), max(pivots, min(MOST_PIVOTS, r["n"] // segment))) for r in sizes if r["dim"]}
    drawn: dict[int, list] = {}
    if wanted:  # some rows for each pivot by a hash, of which the first by rank; a bounded number a length
        share = F.create_map(*(x for r in sizes if r["dim"] for x in (F.lit(r["dim"]), F.lit(min(1.0, 8 * wanted[r["dim"]] / r["n"])))))[F.size("v")]
        most = F.create_map(*(x for dim, n in wanted.items() for x in (F.lit(dim), F.lit(n))))[F.size("v")]
        some = base.withColumn("draw", F.xxhash64("id", "v")).filter(F.pmod("draw", F.lit(1 << 30)) < share * (1 << 30))
        rank = F.row_number().over(Window.partitionBy(F.size("v")).orderBy("draw", "id"))
        for r in some.withColumn("rank", rank).filter(F.col("rank") <= most).select("v").collect():
            drawn.setdefault(len(r["v"]), []).append(r["v"])
    largest = {r["dim"]: r["square"] for r in sizes}
    index = spark.sparkContext.broadcast({dim: (_augmented(np.array(sorted(rows), np.int64).reshape(len(rows), dim), largest[dim]), largest[dim]) for dim, rows in drawn.items()})

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector's nearest pivot and its distance; pivot 0 at distance 0 where its length has none."""
        for batch in batches:
            sizes_ = batch.column(1).value_lengths().to_numpy()
            for dim in map(int, np.unique(sizes_)):
                part = pa.Table.from_batches([batch]).filter(pa.array(sizes_ == dim)).combine_chunks()
                near, dist = np.zeros(part.num_rows, np.int32), np.zeros(part.num_rows)
                if dim in index.value:
                    marks, most = index.value[dim]
                    d = _distances(_augmented(_matrix(part["v"], dim), most), marks)
                    near = d.argmin(axis=1).astype(np.int32)
                    dist = d[np.arange(len(d)), near]
                yield from pa.table({"id": part["id"], "v": part["v"], "dim": pa.array(np.full(part.num_rows, dim), pa.int32()), "pivot": pa.array(near), "dist": dist}).to_batches()

    schema = "id long, v array<long>, dim int, pivot int, dist double"
    keyed = base.select("id", "v").mapInArrow(tidied(key), schema)
    cells = saved(keyed.groupBy("dim", "pivot").agg(F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high")), "cells")
    most = F.greatest(F.lit(1), F.least(F.lit(segment), F.floor(F.lit(SEGMENT_BYTES) / (8 * F.col("dim") + 8)).cast("int")))
    cells = cells.withColumn("segments", F.ceil(F.col("n") / most).cast("int"))
    # a row a pivot; by a shuffle where lengths are too many to be sent to every task
    number = F.pmod(F.xxhash64("id", "dist"), F.col("segments")).cast("int")
    rows = saved(keyed.join(cells.select("dim", "pivot", "segments"), ["dim", "pivot"]).withColumn("segment", number).drop("segments"), "vectors")
    least = F.lit(_LEAST).cast("long")
    asked = saved(asked.select("id", "v", F.size("v").alias("dim"), least.alias("floor")), "queries")

    def met(queries_: DataFrame) -> DataFrame:
        """Queries with their segments against the vectors there; segments without a query aren't moved."""
        cell = queries_.select(*_CELL).distinct()
        some = rows.join(cell, _CELL, "left_semi").select(*_CELL, F.lit(False).alias("query"), "id", "v", "dist", F.lit(0).cast("long").alias("floor"))
        both = some.unionByName(queries_.select(*_CELL, F.lit(True).alias("query"), "id", "v", F.lit(0.0).alias("dist"), "floor"))
        return both.repartition(*_CELL).sortWithinPartitions(*_CELL, "query").mapInArrow(tidied(_meet(index, k, block)), "query_id long, vec_id long, score long")

    dims = list(index.value)
    listed = spark.sparkContext.broadcast(_by_length(cells.filter(F.col("dim").isin(dims)).collect() if dims else []))  # a row a pivot of `lengths` lengths

    def route(first: bool):
        """A row for each segment that a query is to search: at first one segment of each of the nearest pivots that hold
        k others, then every segment of each pivot that may hold one of its best."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes_ = batch.column(1).value_lengths().to_numpy()
                for dim in map(int, np.unique(sizes_)):
                    part = pa.Table.from_batches([batch]).filter(pa.array(sizes_ == dim)).combine_chunks()
                    marks, most = index.value[dim]
                    pivot, n, segments, low, high = listed.value[dim]
                    for at in range(0, part.num_rows, block):
                        own = part.slice(at, block)
                        q, floor = _matrix(own["v"], dim).astype(np.float64), own["floor"].to_numpy().astype(np.float64)
                        d = _distances(np.c_[q, np.zeros(len(q))], marks)[:, pivot]
                        if first:
                            near = np.argsort(d, axis=1, kind="stable")
                            before = np.cumsum(n[near] // segments[near], axis=1) - n[near] // segments[near]
                            row, col = np.nonzero(before <= k)
                            col, many = near[row, col], np.ones(len(row), np.int64)
                        else:
                            limit = reached(most, (q * q).sum(axis=1), floor)
                            limit[floor <= _LEAST / 2] = np.inf
                            row, col = np.nonzero(np.maximum(low[None, :] - d, d - high[None, :]) <= limit[:, None])
                            many = segments[col]
                        number = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                        row, col = np.repeat(row, many), np.repeat(col, many)
                        for a in range(0, len(row), 8 * block):
                            r = slice(a, a + 8 * block)
                            wide = own.take(pa.array(row[r])).append_column("pivot", pa.array(pivot[col[r]], pa.int32())).append_column("segment", pa.array(number[r], pa.int32()))
                            yield from wide.select(["id", "v", "dim", "floor", "pivot", "segment"]).combine_chunks().to_batches()

        return run

    def routed(asked: DataFrame, first: bool) -> DataFrame:
        others = asked.filter(~F.col("dim").isin(dims)) if dims else asked
        all_of = F.explode(F.sequence(F.lit(0), F.lit(0) if first else F.col("segments") - 1))
        whole = others.join(cells.select("dim", "pivot", "segments"), "dim").withColumn("segment", all_of).select("id", "v", "dim", "floor", "pivot", "segment")
        return asked.filter(F.col("dim").isin(dims)).mapInArrow(tidied(route(first)), "id long, v array<long>, dim int, floor long, pivot int, segment int").unionByName(whole) if dims else whole

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    bounds = met(routed(asked, True)).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    asked = saved(asked.drop("floor").join(bounds, "id", "left").select("id", "v", "dim", F.coalesce("floor", least).alias("floor")), "asked")
    found = met(routed(asked, False))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(id_col), "score")


def _by_length(cells: list) -> dict[int, tuple[np.ndarray, ...]]:
    """Pivots, their numbers of vectors and segments, least and largest distances, by vector length."""
    out: dict[int, list] = {}
    for r in sorted(cells, key=lambda r: (r["dim"], r["pivot"])):
        out.setdefault(r["dim"], []).append((r["pivot"], r["n"], r["segments"], r["low"], r["high"]))
    return {dim: tuple(np.array(c) for c in zip(*rows, strict=True)) for dim, rows in out.items()}
