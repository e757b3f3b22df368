"""Exact top-k by inner product with no-random-access aggregation over sorted lists.

Each component becomes a whole number, ``floor(256 x)``. Rows lie packed in blocks, and a block has one list of its rows per
dimension, sorted by value. A query reads every list from the end its sign prefers, all to the same depth. The values at the reading
heads bound from above what a row can still get from lists that have not reached it, the ends of the lists from below. A query
stops at the least depth whose heads, summed up, stay below its edge: the k-th best score of the blocks before, or else the k-th lower
bound. Rows that no list has reached are then proven to be outside; of the others, those whose upper bound reaches the edge are
resolved. A query that no depth stops reads all lists to their ends, which makes its sums the scores.

A block's rows lie in the order in which the lists reach them, so that what is read to some depth is its beginning, and the sums of all
queries that stop there are one matrix product.

Blocks are dealt to shares of bounded size, and each share gets every block of queries once. A task makes the lists of a share once,
then lets one block of queries after another go through its blocks, and returns the best of the share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .vector_blocks import padded

SCALE = 256
EXACT = {np.float32: 2.0**24, np.float64: 2.0**53}
#: Packed bytes of a share: what a task holds of the candidates
SHARE = 96_000_000
PACKED = "ids binary, whole binary, width int, wide boolean, bytes long"


def whole_numbers(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x)


@dataclass
class Block:
    """Rows in the order in which the lists reach them. ``heads`` has, by depth, the rows reached before it and the next value of each list from its upper and lower end."""

    ids: np.ndarray
    whole: np.ndarray
    low: np.ndarray
    high: np.ndarray
    heads: list[tuple[int, np.ndarray, np.ndarray]]
    biggest: float


def sorted_lists(ids: np.ndarray, whole: np.ndarray) -> Block:
    n, d = whole.shape
    order = np.argsort(whole, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(n)[:, None], (n, d)), axis=0)
    lists = np.take_along_axis(whole, order, axis=0)
    reached = np.minimum(rank, n - 1 - rank).min(axis=1, initial=n)
    by = np.lexsort((ids, reached))
    depths, depth = [0], 1
    # past half of the rows, bounds cost more than the scores
    while 2 * (count := int((reached < depth).sum())) <= n and depth < n:
        depths.append(depth)
        depth *= 2
    heads = [(int((reached < x).sum()), lists[n - 1 - x], lists[x]) for x in depths]
    return Block(ids[by], whole[by], lists[0], lists[-1], heads, float(max(-lists[0].min(initial=0).astype(float), lists[-1].max(initial=0).astype(float))))


@dataclass
class Asked:
    """A block of queries: their components, and those above and below zero."""

    ids: np.ndarray
    whole: np.ndarray
    up: np.ndarray
    down: np.ndarray
    biggest: float


def asked_rows(ids: np.ndarray, whole: np.ndarray) -> Asked:
    whole = whole.astype(np.float64 if whole.dtype == np.float64 else np.float32)  # which hold 16 bits
    return Asked(ids, whole, np.maximum(whole, 0), np.minimum(whole, 0), float(np.abs(whole).max(initial=0)))


def block_top(queries: Asked, block: Block, k: int, edge: np.ndarray):
    """Positions of queries and rows, and scores, of the rows of the block that reach the edges, the ``k`` best among them at least.

    ``edge`` is, of each query, a score that ``k`` other rows reach, or minus infinity. Sums that doubles cannot hold exactly are made with
    Python's whole numbers; scores beyond 64 bits end at its limits."""
    n, d = len(block.ids), min(queries.whole.shape[1], block.whole.shape[1])  # missing components are zeros
    most = queries.biggest * block.biggest * d
    kind = next((x for x, limit in EXACT.items() if most < limit), None)
    if kind is None:
        return _plain(queries.ids, queries.whole[:, :d], block.ids, block.whole[:, :d], k)
    q, up, down, v, low, high = (x[..., :d].astype(kind, copy=False) for x in (queries.whole, queries.up, queries.down, block.whole, block.low, block.high))
    heads = [(count, upper[:d].astype(kind), lower[:d].astype(kind)) for count, upper, lower in block.heads]
    new = np.isneginf(edge)
    first = np.flatnonzero(new)
    if len(first) and heads[-1][0] >= k:
        count, head_up, head_down = heads[-1]
        x = v[:count]
        lower = up[first] @ np.where(x > head_up, x, low).T + down[first] @ np.where(x < head_down, x, high).T
        edge = edge.copy()
        edge[first] = _kth(lower, queries.ids[first], block.ids[:count], k)
    stop = np.full(len(q), len(heads))
    for i in range(len(heads) - 1, -1, -1):
        _, head_up, head_down = heads[i]
        stop[up @ head_up + down @ head_down < edge] = i
    out = []
    for i in np.unique(stop).tolist():
        own = np.flatnonzero(stop == i) if (stop != i).any() else slice(None)
        ids, least = queries.ids[own], edge[own]
        rows = np.arange(n)
        if i < len(heads):
            count, head_up, head_down = heads[i]
            x = v[:count]
            upper = up[own] @ np.maximum(x, head_up).T + down[own] @ np.minimum(x, head_down).T
            rows = np.flatnonzero((upper >= least[:, None]).any(axis=0))
            if not len(rows):
                continue
        score = q[own] @ (v[rows] if i < len(heads) else v).T
        if new[own].any():
            least = least.copy()
            least[new[own]] = np.maximum(least[new[own]], _kth(score[new[own]], ids[new[own]], block.ids[rows], k))
        some = np.flatnonzero(score.max(axis=1) >= least)
        at, found = np.nonzero(score[some] >= least[some, None])
        keep = block.ids[rows[found]] != ids[some[at]]
        at, found = some[at[keep]], found[keep]
        out.append((np.arange(len(q))[own][at], rows[found], score[at, found]))
    if not out:
        return (np.empty(0, np.int64),) * 3
    at, found, score = (np.concatenate(x) for x in zip(*out, strict=True))
    return at, found, score.astype(np.int64)


def _kth(score: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Of each row of scores the ``k``-th best, without the query's own; minus infinity if there are fewer."""
    if score.shape[1] < k:
        return np.full(len(score), -np.inf)
    score = np.where(query_ids[:, None] == ids[None, :], -np.inf, score)
    return np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]


def _plain(query_ids, q, ids, v, k):
    """Scores of huge components."""
    at, found, scores = [], [], []
    whole = [[int(x) for x in row] for row in v]
    for i, row in enumerate(q):
        own = [int(x) for x in row]
        score = [max(-(2**63), min(2**63 - 1, sum(map(int.__mul__, own, w)))) for w in whole]
        ranked = sorted((-s, int(j), p) for p, (s, j) in enumerate(zip(score, ids, strict=True)) if j != query_ids[i])[:k]
        at += [i] * len(ranked)
        found += [p for _, _, p in ranked]
        scores += [-s for s, _, _ in ranked]
    return np.array(at, np.int64), np.array(found, np.int64), np.array(scores, np.int64)


class Best:
    """The ``k`` best of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.held = k, np.zeros((queries, k), bool)
        self.ids, self.scores = np.zeros((queries, k), np.int64), np.zeros((queries, k), np.int64)
        self.edge = np.full(queries, -np.inf)

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        full, last, worst = self.held[at, -1], self.scores[at, -1], self.ids[at, -1]
        better = ~full | (scores > last) | (scores == last) & (ids < worst)
        at, ids, scores = at[better], ids[better], scores[better]
        if not len(at):
            return
        rows, own = np.unique(at, return_inverse=True)
        at = np.concatenate([np.repeat(np.arange(len(rows)), self.k), own])
        held = np.concatenate([self.held[rows].ravel(), np.ones(len(ids), bool)])
        ids, scores = np.concatenate([self.ids[rows].ravel(), ids]), np.concatenate([self.scores[rows].ravel(), scores])
        order = np.lexsort((ids, ~scores, ~held, at))
        place = np.arange(len(order)) - np.searchsorted(at[order], at[order])
        order, place = order[place < self.k], place[place < self.k]
        for to, x in ((self.held, held), (self.ids, ids), (self.scores, scores)):
            to[rows[at[order]], place] = x[order]
        last = self.scores[rows, -1].astype(float)
        last = np.where(np.abs(last) < EXACT[np.float64], last, np.nextafter(last, -np.inf))  # where doubles are rounded
        self.edge[rows] = np.where(self.held[rows, -1], last, -np.inf)


class Filling:
    """Rows gathered to blocks of ``size``; rows of small and of large numbers go to blocks of their own."""

    def __init__(self, size: int):
        self.size, self.parts = size, {np.int16: [], np.float64: []}

    def add(self, ids: np.ndarray, whole: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        small = np.abs(whole.astype(float)).max(axis=1, initial=0) < 2**15
        for kind, own in ((np.int16, small), (np.float64, ~small)):
            if own.any():
                self.parts[kind].append((ids[own], whole[own].astype(kind)))
                if sum(len(x) for x, _ in self.parts[kind]) >= self.size:
                    yield from self._cut(kind, self.size)

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for kind, parts in self.parts.items():
            if parts:
                yield from self._cut(kind, 1)

    def _cut(self, kind: type, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks, as long as ``least`` rows are left."""
        width = max(1, *(x.shape[1] for _, x in self.parts[kind]))
        ids = np.concatenate([x for x, _ in self.parts[kind]])
        whole = np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for _, x in self.parts[kind]])
        i = 0
        while len(ids) - i >= least:
            yield ids[i : i + self.size], whole[i : i + self.size]
            i += self.size
        self.parts[kind] = [(ids[i:], whole[i:])] if i < len(ids) else []


def _unpacked(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    ids, whole, width, wide = (batch.column(c)[i] for c in ("ids", "whole", "width", "wide"))
    ids = np.frombuffer(ids.as_py(), np.int64)
    return ids, np.frombuffer(whole.as_py(), np.float64 if wide.as_py() else np.int16).reshape(len(ids), width.as_py())


def _batch(ids: np.ndarray, whole: np.ndarray, **more) -> pa.RecordBatch:
    kinds = {"ids": pa.binary(), "whole": pa.binary(), "width": pa.int32(), "wide": pa.bool_(), "bytes": pa.int64(), "share": pa.int32()}
    row = {"ids": ids.tobytes(), "whole": whole.tobytes(), "width": whole.shape[1], "wide": whole.dtype == np.float64, "bytes": whole.nbytes} | more
    return pa.RecordBatch.from_arrays([pa.array([x], kinds[c]) for c, x in row.items()], list(row))


def _pack(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of the rows whose components are all finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Filling(size)
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), padded(batch.column(1))  # null components are NaN
            finite = np.isfinite(vectors).all(axis=1)
            for own in blocks.add(ids[finite], whole_numbers(vectors[finite])):
                yield _batch(*own)
        for own in blocks.rest():
            yield _batch(*own)

    return rows.mapInArrow(run, PACKED)


def _deal(blocks: DataFrame, shares: int, every: int, size: int) -> DataFrame:
    """Each block with its share; with no share, blocks of the queries among their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, share = Filling(size), TaskContext.get().partitionId()
        for batch in batches:
            for i in range(batch.num_rows):
                ids, whole = _unpacked(batch, i)
                yield _batch(ids, whole, share=share % shares)
                share += 1
                own = ids % every == 0
                for queries in asked.add(ids[own], whole[own]):
                    yield _batch(*queries, share=None)
        for queries in asked.rest():
            yield _batch(*queries, share=None)

    return blocks.mapInArrow(run, PACKED + ", share int")


def exact_top(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = 1024, block: int = 1024, share: int = SHARE) -> DataFrame:
    """``query_id, rank, vec_id, score`` for each row whose id is divisible by ``every``, ties to the smaller id. Rows that share a query's id count as its own."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    blocks = staged(_pack(rows.filter("id is not null and vector is not null"), block), "vector-blocks")
    n, total = blocks.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    shares = max(1, min(n, max(-(-total // share), 3 * vectors.sparkSession.sparkContext.defaultParallelism)))
    dealt = _deal(blocks, shares, every, query_block).withColumn("asked", F.col("share").isNull())
    dealt = dealt.withColumn("share", F.explode(F.when(F.col("asked"), F.sequence(F.lit(0), F.lit(shares - 1))).otherwise(F.array("share"))))
    # more partitions than shares, so that few hold two; a share's own blocks, then the queries
    dealt = dealt.repartition(4 * shares, "share").sortWithinPartitions("share", "asked")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.column("share")[i].as_py(), batch.column("asked")[i].as_py(), *_unpacked(batch, i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for (now, asked), rows in groupby(rows_of(batches), lambda row: row[:2]):
            filling = Filling(query_block if asked else block)  # again: what a task of few rows has sent is small
            filled = chain((x for _, _, ids, whole in rows for x in filling.add(ids, whole)), filling.rest())
            if not asked:
                at, own = now, [sorted_lists(*x) for x in filled]
            elif now == at:
                for ids, whole in filled:
                    queries, best = asked_rows(ids, whole), Best(len(ids), k)
                    for candidates in own:
                        of, found, score = block_top(queries, candidates, k, best.edge)
                        best.add(of, candidates.ids[found], score)
                    of, place = np.nonzero(best.held)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(best.ids[of, place]), pa.array(best.scores[of, place])], ["query_id", "vec_id", "score"])

    best = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
