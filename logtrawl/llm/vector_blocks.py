"""Vectors in blocks: the grid of query blocks and candidate blocks that the vector searches work through.

Rows with a null vector, or with null or non-finite components, take no part. Blocks are dealt by a hash of the row, hold
a bounded number of vectors each, and a task sees one query block and one candidate block at a time. Vectors of
different lengths are compared as if padded with zeros.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def usable(vectors: DataFrame, id_col: str, vector_col: str, zero: bool = True) -> DataFrame:
    """``id, vector array<double>`` of the rows that take part; ``zero`` keeps vectors of zeros."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.filter("id is not null and vector is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    return rows if zero else rows.filter("exists(vector, x -> x != 0)")


def _blocks(rows: DataFrame, count: int, size: int, name: str) -> DataFrame:
    blocks = max(1, -(-count // size))
    dealt = rows.withColumn(f"{name}_block", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    return dealt.groupBy(f"{name}_block").agg(F.collect_list("id").alias(f"{name}_ids"), F.collect_list("vector").alias(f"{name}_vectors"))


def matrix(vectors: pa.Scalar) -> np.ndarray:
    """A list of lists of numbers, padded with zeros."""
    return padded(vectors.values)


def padded(lists: pa.ListArray) -> np.ndarray:
    width = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(width) and (width == width[0]).all():
        return flat.reshape(len(width), width[0])
    out = np.zeros((len(width), int(width.max(initial=0))))
    out[np.arange(out.shape[1]) < width[:, None]] = flat
    return out


def blockwise_top(rows: DataFrame, every: int, k: int, search: Search, query_block: int, block: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the best ``k`` of all rows but the query's own for each row whose id is divisible by ``every``.

    ``search(query_ids, queries, ids, vectors)`` returns query positions, candidate positions and scores of the best of
    one block. Rows that share a query's id count as its own. Query blocks go to each candidate block by a join on block numbers."""
    rows = staged(rows, "vectors")
    queries = rows.filter(f"id % {every} = 0")
    n = rows.count()
    candidates = staged(_blocks(rows, n, block, "c"), "vector-blocks")
    asked = _blocks(queries, queries.count(), query_block, "q")
    asked = asked.withColumn("c_block", F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-n // block)) - 1))))
    pairs = asked.join(candidates, "c_block").select("q_ids", "q_vectors", "c_ids", "c_vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, ids = (batch.column(c)[i].values.to_numpy() for c in (0, 2))
                q, v = (matrix(batch.column(c)[i]) for c in (1, 3))
                width = max(q.shape[1], v.shape[1])
                q, v = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, v))
                at, found, score = search(q_ids, q, ids, v)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(ids[found]), pa.array(score)], ["query_id", "vec_id", "score"])

    best = pairs.mapInArrow(run, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best: highest score first, then smallest id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= edge)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
