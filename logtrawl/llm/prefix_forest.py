"""Approximate nearest neighbours with a hash-prefix forest.

Each tree gives every vector of a block a long string of bits, the sides of random hyperplanes, orthogonal within a tree as far as
the dimensions reach, and keeps the strings in a sorted array. A query descends in each tree to the longest prefix that it shares
with any entry; then all trees ascend together, one bit at a time, until their matches, repeats included, are ``reach`` times
the rows of the block; in the last step only as many trees ascend as that needs. Entries with one string are one match of their
tree, so equal rows use up no more of the ascent than a single row. It goes on while the union of the matches has fewer than ``k`` rows
besides the query's own. The union is scored exactly.

For inner products, vectors get one more component that makes them equally long, and queries a zero there.
``reach`` and ``trees`` set the recall; every row is in every tree of its block, and blocks are bounded.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .vector_blocks import best_of, blockwise_top, usable

BITS = 24


def _planes(width: int, trees: int, seed: int) -> np.ndarray:
    """``trees x BITS`` normals, in orthogonal groups."""
    rng = np.random.default_rng(seed)
    groups = []
    while sum(map(len, groups)) < trees * BITS:
        groups.append(np.linalg.qr(rng.standard_normal((width, width)))[0].T)
    return np.concatenate(groups)[: trees * BITS]


def _codes(vectors: np.ndarray, planes: np.ndarray, trees: int) -> np.ndarray:
    """One string of bits for each tree and vector."""
    out = np.zeros((trees, len(vectors)), np.uint32)
    for t in range(trees):
        side = vectors @ planes[t * BITS : (t + 1) * BITS].T > 0
        for b in range(BITS):
            out[t] |= side[:, b].astype(np.uint32) << np.uint32(BITS - 1 - b)
    return out


def _ranges(sorted_codes: np.ndarray, query_codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """In each tree, where the entries begin and end that share the first ``length`` bits of each query."""
    shift = np.uint32(BITS - length)
    first = (query_codes >> shift) << shift
    begin, end = np.empty(query_codes.shape, np.int64), np.empty(query_codes.shape, np.int64)
    for t, codes in enumerate(sorted_codes):
        begin[t] = np.searchsorted(codes, first[t], "left")
        end[t] = np.searchsorted(codes, first[t] + (np.uint32(1) << shift) - np.uint32(1), "right")
    return begin, end


def block_search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, trees: int, reach: float, seed: int):
    """Positions of queries and rows, and exact inner products, of the ``k`` best matches of each query in one block."""
    n, m = len(ids), len(query_ids)
    if not n or not m:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    size = np.abs(vectors).max()
    scaled = vectors / size
    norm = (scaled**2).sum(axis=1)
    longer = np.concatenate([scaled, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]], axis=1)
    planes = _planes(longer.shape[1], trees, seed)
    codes = _codes(longer, planes, trees)
    order = np.argsort(codes, axis=1, kind="stable")
    sorted_codes = np.take_along_axis(codes, order, axis=1)
    largest = np.abs(queries).max(axis=1, keepdims=True)
    asked = np.concatenate([queries / np.where(largest > 0, largest, 1), np.zeros((m, 1))], axis=1)
    query_codes = _codes(asked, planes, trees)
    want = max(reach * n, trees * k)
    # how many different strings stand before a place
    strings = np.zeros((trees, n + 1), np.int64)
    strings[:, 1] = 1
    strings[:, 2:] = 1 + np.cumsum(sorted_codes[:, 1:] != sorted_codes[:, :-1], axis=1)
    mark = np.zeros(n, bool)

    def seen(i: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        mark[:] = False
        for t, (b, e) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
            if e > b:
                mark[order[t, b:e]] = True
        near = np.flatnonzero(mark)
        return near[ids[near] != query_ids[i]]

    def scored(i: int, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        with np.errstate(over="ignore", invalid="ignore"):
            rough = vectors[near] @ queries[i]
            if len(near) > k:  # equal rows must get equal scores, so the last digits come from row-wise sums
                edge = np.partition(rough, len(near) - k)[len(near) - k]
                near = near[rough >= edge - 1e-9 * max(1.0, abs(edge))] if np.isfinite(edge) else near
            score = (vectors[near] * queries[i]).sum(axis=1)
        best = best_of(ids[near], score, k)
        return np.full(len(best), i), near[best], score[best]

    out = []
    lower_begin, lower_end = _ranges(sorted_codes, query_codes, BITS)
    waiting = np.ones(m, bool)
    for length in range(BITS - 1, -1, -1):  # ascend together
        b, e = _ranges(sorted_codes, query_codes, length)
        wide, narrow = (np.take_along_axis(strings, y, axis=1) - np.take_along_axis(strings, x, axis=1) for x, y in ((b, e), (lower_begin, lower_end)))
        # with the first trees one step higher and the others still below
        matched = np.cumsum(wide, axis=0) + narrow.sum(axis=0) - np.cumsum(narrow, axis=0)
        stop = waiting & ((matched[-1] >= want) | (length == 0))
        risen = np.argmax((matched >= want) | (np.arange(trees)[:, None] == trees - 1), axis=0)
        for i in np.flatnonzero(stop).tolist():
            up = np.arange(trees) <= risen[i]
            near = seen(i, np.where(up, b[:, i], lower_begin[:, i]), np.where(up, e[:, i], lower_end[:, i]))
            if len(near) >= k or length == 0:
                out.append(scored(i, near))
                waiting[i] = False
        if not waiting.any():
            break
        lower_begin, lower_end = b, e
    at, found, scores = zip(*out, strict=True)
    return np.concatenate(at), np.concatenate(found), np.concatenate(scores)


def forest_search(vectors: DataFrame, k: int = 20, every: int = 20, trees: int = 96, reach: float = 0.8, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = 1024, block: int = 8192) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest found by inner product, ties to the smaller id. Zero vectors take no part."""

    def search(query_ids, queries, ids, rows):
        return block_search(query_ids, queries, ids, rows, k, trees, reach, seed)

    return blockwise_top(usable(vectors, id_col, vector_col, zero=False), every, k, search, query_block, block)
