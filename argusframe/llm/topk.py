"""Exact top-k by inner product over an impact-ordered, score-at-a-time index.

Candidates are dealt into blocks of bounded size. A task indexes a block once, then streams all queries past it:
postings of each dimension are sorted by component and cut into segments of one quantised impact.
A query takes segments by falling bound on what they add, whatever their dimension, and sums bounds into
accumulators. A candidate can still reach its accumulator plus, for each dimension not yet seen, the bound
of the next segment. Work stops only when few enough candidates can reach the k-th best exact score known;
all of those are then scored exactly. Ties go to the smaller id, so results don't depend on the blocks.

Nulls: vectors that are null or hold null or non-finite components take no part, nor does a null vec_id. Shorter
vectors count as padded with zeros. Repeats: rows that share an id are candidates each, and none of them for queries
of that id; equal rows beyond k can stand in no result, so a block holds k of them at most. Ties go to the smaller
vec_id. Scores are summed in whole numbers where doubles might not be exact; one beyond the range of long is clamped
to it. Very long vectors: a block is of so many rows whatever their width. An empty table, or no query, gives no rows.
Extra columns of any name are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOP = 5
SCALE = 256
CANDIDATES_A_BLOCK = 8192
#: Components of one segment differ by less than this.
IMPACT_STEP = 8
#: Shares of all postings after which the proof is tried.
TRIES = (0.25, 0.4, 0.5, 0.6, 0.75, 1.0)
#: Whole numbers up to this are exact in double precision; queries whose sums may pass it use whole numbers throughout.
EXACT_IN_DOUBLE = 1 << 53
LONGEST = np.iinfo(np.int64).max


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and floor(scale * x) of each component, of vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v"))


def stack(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class ImpactIndex:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order])
        postings, dims, starts, lows, highs = [], [], [], [], []
        n, width = self.vectors.shape
        for d in range(width):
            column = self.vectors[:, d]
            by_value = np.argsort(column, kind="stable")
            values = column[by_value]
            cuts = np.flatnonzero(np.diff(np.floor(values / IMPACT_STEP), prepend=np.nan))
            postings.append(by_value.astype(np.int32))
            dims.append(np.full(len(cuts), d))
            starts.append(cuts + d * n)
            lows.append(values[cuts])
            highs.append(values[np.append(cuts[1:], n) - 1])
        self.postings = np.concatenate(postings)
        self.dims, self.starts, self.lows, self.highs = map(np.concatenate, (dims, starts, lows, highs))
        self.ends = np.append(self.starts[1:], n * width)

    def exact(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.vectors[rows] @ query

    def best(self, query_id: int, query: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[int, float]]:
        rows = rows[self.ids[rows] != query_id]
        scores = self.exact(query, rows)
        first = np.lexsort((self.ids[rows], -scores))[:k]
        return [(int(self.ids[r]), scores[i]) for i, r in zip(first, rows[first], strict=True)]

    def search(self, query_id: int, query: np.ndarray, k: int = TOP) -> list[tuple[int, float]]:
        n = len(self.ids)
        everything = np.arange(n)
        if n <= 4 * k or not len(self.dims):
            return self.best(query_id, query, everything, k)
        weight = query[self.dims]
        bounds = np.where(weight > 0, weight * self.highs, weight * self.lows)
        order = np.argsort(-bounds, kind="stable")
        order = order[weight[order] != 0]
        if not len(order):
            return self.best(query_id, query, everything, k)
        sizes = (self.ends - self.starts)[order]
        reached = np.cumsum(sizes)
        sums, unseen, at = np.zeros(n), np.full(n, np.count_nonzero(query)), 0
        for share in TRIES:
            stop = max(at + 1, int(np.searchsorted(reached, share * reached[-1])) + 1) if share < 1 else len(order)
            taken = order[at:stop]
            if not len(taken):
                continue
            rows = np.concatenate([self.postings[a:b] for a, b in zip(self.starts[taken].tolist(), self.ends[taken].tolist(), strict=True)])
            sums += np.bincount(rows, np.repeat(bounds[taken], sizes[at:stop]), n)
            unseen -= np.bincount(rows, minlength=n)
            at = stop
            ahead = bounds[order[at]] if at < len(order) else 0.0
            reach = sums + unseen * ahead
            guess = np.argpartition(-sums, 4 * k)[: 4 * k]
            known = self.best(query_id, query, guess, k)
            if len(known) == k:
                possible = np.flatnonzero(reach >= known[-1][1])
                if len(possible) <= max(16 * k, n // 8) or at == len(order):
                    return self.best(query_id, query, possible, k)
            if at == len(order):
                break
        return self.best(query_id, query, everything, k)


class Block:
    """A block of candidates, indexed when the first query comes."""

    def __init__(self):
        self.ids: list[np.ndarray] = []
        self.vectors: list[np.ndarray] = []
        self.index: ImpactIndex | None = None

    def add(self, ids: np.ndarray, vectors: list[np.ndarray]) -> None:
        self.ids.append(ids)
        self.vectors += vectors

    def best(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        if not self.vectors:
            return []
        if self.index is None:
            width = max(1, max(map(len, self.vectors)))
            self.index = ImpactIndex(np.concatenate(self.ids), stack(self.vectors, width))
            self.largest = np.abs(self.index.vectors).max(initial=0)
        width = self.index.vectors.shape[1]
        asked = np.zeros(width)
        asked[: len(query)] = query[:width]
        if self.largest * np.abs(asked).max() * width < EXACT_IN_DOUBLE:
            return [(i, int(s)) for i, s in self.index.search(query_id, asked, k)]
        whole = [int(x) for x in asked]
        pairs = ((i, v) for i, v in zip(self.index.ids.tolist(), self.index.vectors, strict=True) if i != query_id)
        scored = sorted((-sum(a * int(b) for a, b in zip(whole, v, strict=True)), i) for i, v in pairs)[:k]
        return [(i, max(-LONGEST, min(LONGEST, -s))) for s, i in scored]


def at_most(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` with k of any that are equal, which is as many as a result can hold. Looks at ids first, as hardly any
    table needs it."""
    often = rows.groupBy("vec_id").agg(F.count("*").alias("n")).where(F.col("n") > k)
    if often.isEmpty():
        return rows
    counted = rows.groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    return counted.select("vec_id", "v", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("col")


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best among the other vectors. ``is_query``
    is a condition on vec_id. A task holds one block of candidates and one batch of queries."""
    rows = at_most(whole_vectors(vectors), k)
    blocks = max(1, -(-rows.count() // CANDIDATES_A_BLOCK))
    place = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")
    candidates = rows.select(place.alias("block"), F.lit(0).alias("side"), "vec_id", "v")
    queries = whole_vectors(vectors).where(is_query).select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("side"), "vec_id", "v"
    )
    dealt = candidates.unionByName(queries).repartition(blocks, "block").sortWithinPartitions("block", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, Block()
        for batch in batches:
            of, side, ids = (batch.column(i).to_numpy() for i in range(3))
            lists = batch.column(3)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            changes = np.flatnonzero((np.diff(of) != 0) | (np.diff(side) != 0)) + 1
            out = []
            for a, b in zip([0, *changes.tolist()], [*changes.tolist(), len(of)], strict=True):
                if of[a] != now:
                    now, block = of[a], Block()
                vectors = [values[x:y] for x, y in zip(ends[a:b].tolist(), ends[a + 1 : b + 1].tolist(), strict=True)]
                if side[a] == 0:
                    block.add(ids[a:b].copy(), [v.copy() for v in vectors])
                else:
                    for q, v in zip(ids[a:b].tolist(), vectors, strict=True):
                        out += [(q, i, s) for i, s in block.best(q, v, k)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    first = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
