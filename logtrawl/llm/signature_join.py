"""N-gram Jaccard join with signature trees, exact, as groups of linked documents.

A document is the set of its distinct word shingles. Equal sets are one node. Two nodes that link share a shingle among the
first quarter of either in any common order of all shingles; the order here puts the most repeated shingles last. Nodes that share such a
shingle are members of the group of the smallest of them, so every link lies in some group.

Each group is joined with itself by signature trees: leaves hold a few nodes of similar size, every tree node the OR of the token
bitmaps below it and their range of sizes. A dual traversal drops pairs of tree nodes whose sizes or common bits
leave no room for the needed overlap, and pairs that are all connected already; what is left is compared exactly. A
large group is cut into chunks, and pairs of chunks are joined in tasks of their own. Each task returns what it
connected as stars; rounds of minimum labels over these stars give the groups.

Texts never leave their partitions but for nodes that are members of a group. Copies are dropped within each batch before
anything is shuffled, and meet as equal keys of partial sums after it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, whole_text

WORDS = 5
NEED, OF = 75, 100  # a link needs NEED * union <= OF * intersection
PIECE = 1 << 20  # bytes of text worked on at once
HELD = 1_000_000  # shingles held before they are passed on
HOT = 200_000  # shingles with a place of their own in the common order; a matter of speed only
TARGET_TOKENS = 1_000_000  # prefix tokens of one target
HEAVY = 250_000  # a shingle that so many sets repeat is no target's; its nodes meet by joins
SALTS = 32  # parts of the nodes of one heavy shingle and size
CHUNK_TOKENS = 1_000_000  # shingles in one chunk of a group
CHUNK_NODES = 1024
LEAF = 8
MORE = 16  # a prefix has one token more for so many shingles
FILTER_BITS = 1 << 23
PAIR_WORDS = 1 << 20  # words of bitmaps compared at once
_ODD, _M1, _M2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_M1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_M2)
    return x ^ (x >> np.uint64(31))


@cache
def _tables():
    byte = np.arange(256, dtype=np.uint8)
    byte[65:91] += 32
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    marks = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))[byte]
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(PIECE, np.uint64(_ODD))]), dtype=np.uint64)
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(PIECE, np.uint64(pow(_ODD, -1, 2**64)))]), dtype=np.uint64)
    return space, marks, power, back


def _words(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of each word of ``data``; a word begins anew at each of ``begins``. At most PIECE bytes."""
    space, marks, power, back = _tables()
    n = len(data)
    blank = space[data]
    first, last = ~blank, ~blank
    first[1:] &= blank[:-1]
    last[:-1] &= blank[1:]
    inner = begins[(begins > 0) & (begins < n)]
    first[inner] = ~blank[inner]
    last[inner - 1] = ~blank[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(marks[data] * power[:n])])
    return _mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64)), start


def _all_words(data: np.ndarray) -> np.ndarray:
    """Word hashes of one text of any length."""
    out, space, at = [], _tables()[0], 0
    while at < len(data):
        stop = min(len(data), at + PIECE)
        if stop < len(data):
            blank = np.flatnonzero(space[data[at:stop]])
            if not len(blank):  # a word longer than a piece: its parts, each hashed
                end = stop + int(np.argmax(np.concatenate([space[data[stop:]], [True]])))
                parts = [_words(data[i : min(end, i + PIECE)], np.zeros(1, np.int64))[0] for i in range(at, end, PIECE)]
                whole = np.zeros(1, np.uint64)
                for p in parts:
                    whole = _mix(whole * np.uint64(_ODD) + p)
                out.append(whole)
                at = end
                continue
            stop = at + int(blank[-1])
        out.append(_words(data[at:stop], np.zeros(1, np.int64))[0])
        at = max(stop, at + 1)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _of_words(words: np.ndarray, docs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles and their documents from word hashes and their documents, in order."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    turn = [np.uint64(pow(_M2, j + 1, 2**64)) for j in range(size)]
    full = np.flatnonzero(docs[: max(0, n - size + 1)] == docs[size - 1 :])
    hashes = np.zeros(len(full), np.uint64)
    for j in range(size):
        hashes += words[full + j] * turn[j]
    # documents with fewer words: the whole sequence
    starts = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    count = np.diff(np.concatenate([starts, [n]]))
    short = np.flatnonzero(count < size)
    whole = count[short].astype(np.uint64) * np.uint64(_M1)
    for j in range(size - 1):
        has = count[short] > j
        whole[has] += words[starts[short[has]] + j] * turn[j]
    owner = np.concatenate([docs[full], docs[starts[short]]])
    order = np.argsort(owner, kind="stable")
    return _mix(np.concatenate([hashes, whole]))[order], owner[order]


def shingle_sets(texts: pa.Array, size: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """Position and sorted distinct shingles of each text with words, from a string array without nulls."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = int(np.searchsorted(offsets, offsets[i] + PIECE, side="right")) - 1
        if j <= i:
            words = _all_words(data[offsets[i] : offsets[i + 1]])
            docs, j = np.full(len(words), i), i + 1
        else:
            words, place = _words(data[offsets[i] : offsets[j]], offsets[i:j] - offsets[i])
            docs = i + np.searchsorted(offsets[i + 1 : j + 1] - offsets[i], place, side="right")
        hashes, owner = _of_words(words, docs, size)
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[new], owner[new]
        cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]])) if len(owner) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield int(owner[a]), hashes[a:b]
        i = j


def _node(tokens: np.ndarray) -> int:
    """A number for a set: with its size it stands for the set."""
    return int(_mix(np.array([int(_mix(tokens ^ np.uint64(_ODD)).sum(dtype=np.uint64)) ^ len(tokens)], np.uint64)).view(np.int64)[0])


def linked(common: int, a: int, b: int, need: int = NEED, of: int = OF) -> bool:
    return of * common >= need * (a + b - common)


# ---- signature trees


class Tree:
    """A signature tree over token sets. At each level: OR bitmaps, sizes from and to, and the most tokens a set has beyond
    its bits; level 0 has the sets themselves, in ``order``."""

    def __init__(self, bits: np.ndarray, size: np.ndarray, firsts: np.ndarray):
        order = np.lexsort((firsts, size))
        bits, size = bits[order], size[order]
        loss = size - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.order = order.tolist()
        self.levels = [(bits, size, size, loss)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, loss = self.levels[-1]
            at = np.arange(0, len(bits), LEAF)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(loss, at)))


def bitmap(tokens: np.ndarray, words: int) -> np.ndarray:
    """One bit for each token, ``words`` being a power of two."""
    out = np.zeros(words, np.uint64)
    place = tokens % np.uint64(words * 64)
    np.bitwise_or.at(out, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return out


def _width(n: int) -> int:
    """Words of the bitmap of a set of this size: four bits a token, as a power of two."""
    return 1 << max(0, int(4 * n - 1).bit_length() - 6)


def _tree_of_sets(sets: list[np.ndarray], words: int) -> Tree:
    return Tree(np.stack([bitmap(x, words) for x in sets]), np.array([len(x) for x in sets]), np.array([x[0] for x in sets], np.uint64))


def _descend(one: Tree, other: Tree, same: bool, stop: int, need: int, of: int) -> tuple[np.ndarray, np.ndarray]:
    """Dual traversal from both roots: the pairs at level ``stop`` that may hold a link."""
    level = max(len(one.levels), len(other.levels)) - 1
    top = lambda tree, n: tree.levels[min(n, len(tree.levels) - 1)]
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        if same:
            i, j = i[i <= j], j[i <= j]
        keep = _open(top(one, level), top(other, level), i, j, need, of)
        i, j = i[keep], j[keep]
        if level <= stop:
            return i, j
        level -= 1
        i, j = _children(i, one, level, j, other)


def _open(one, other, i: np.ndarray, j: np.ndarray, need: int, of: int) -> np.ndarray:
    """Which pairs of tree nodes may hold a link: by sizes, then by the most tokens their bits leave in common."""
    low, high = np.minimum(one[1][i], other[1][j]), np.maximum(one[1][i], other[1][j])
    ok = (of * one[2][i] >= need * other[1][j]) & (of * other[2][j] >= need * one[1][i])
    at = np.flatnonzero(ok)
    for part in np.array_split(at, max(1, len(at) * one[0].shape[1] // PAIR_WORDS)):
        a, b = i[part], j[part]
        common = np.bitwise_count(one[0][a] & other[0][b]).sum(axis=1).astype(np.int64) + np.minimum(one[3][a], other[3][b])
        ok[part] = (of + need) * common >= need * (low[part] + high[part])
    return ok


def tree_join(left: list[np.ndarray], right: list[np.ndarray] | None = None, need: int = NEED, of: int = OF) -> np.ndarray:
    """Component of each set (those of ``left``, then of ``right``), as the smallest position in it.

    Without ``right``, ``left`` is joined with itself; else only pairs between both sides are compared."""
    sets = left + (right or [])
    parent = np.arange(len(sets))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    def compare(a: int, b: int) -> None:
        ra, rb = root(a), root(b)
        if ra == rb:
            return
        x, y = sets[a], sets[b]
        small, large = (x, y) if len(x) <= len(y) else (y, x)
        at = np.searchsorted(large, small)
        common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
        if linked(common, len(x), len(y), need, of):
            parent[max(ra, rb)] = min(ra, rb)

    if len(sets) == 2:
        compare(0, 1)
    elif len(sets) > 2:
        words = min(_width(max(map(len, sets))), 1024)
        one = _tree_of_sets(left, words)
        other = one if right is None else _tree_of_sets(right, words)
        shift = 0 if right is None else len(left)
        level = min(1, max(len(one.levels), len(other.levels)) - 1)
        i, j = _descend(one, other, right is None, level, need, of)
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            # a pair of leaves; all in one component already needs no look inside
            rows = range(a * LEAF, min(a * LEAF + LEAF, len(left))) if level == 1 and len(one.levels) > 1 else [a]
            columns = range(b * LEAF, min(b * LEAF + LEAF, len(other.order))) if level == 1 and len(other.levels) > 1 else [b]
            roots = {root(one.order[x]) for x in rows} | {root(shift + other.order[y]) for y in columns}
            if len(roots) == 1:
                continue
            x, y = (g.ravel() for g in np.meshgrid(np.array(rows), np.array(columns)))
            if right is None and a == b:
                x, y = x[x < y], y[x < y]
            keep = _open(one.levels[0], other.levels[0], x, y, need, of)
            for p, q in zip(x[keep].tolist(), y[keep].tolist(), strict=True):
                compare(one.order[p], shift + other.order[q])
    return np.array([root(x) for x in range(len(sets))])


def may_link(sizes: np.ndarray, bitmaps: list[np.ndarray], side: np.ndarray | None = None, need: int = NEED, of: int = OF) -> np.ndarray:
    """Which sets may link with any other, by the dual traversal of trees over their bitmaps alone; with ``side``, only
    pairs of both sides count. Sets whose bitmaps differ in width by more than one doubling differ too much in size."""
    found = np.zeros(len(sizes), bool)
    width = np.array([len(b) for b in bitmaps])

    def tree(at: np.ndarray, words: int) -> Tree:
        rows = [b if len(b) == words else b[:words] | b[words:] for b in (bitmaps[i] for i in at.tolist())]
        return Tree(np.stack(rows), sizes[at], np.array([r[0] for r in rows], np.uint64))

    sides = [np.ones(len(sizes), bool)] * 2 if side is None else [side, ~side]
    for words in np.unique(width).tolist():
        for first, second in ((words, words), (words, 2 * words), (2 * words, words)):
            if side is None and first > second:
                continue
            a, b = (np.flatnonzero((width == w) & s) for w, s in ((first, sides[0]), (second, sides[1])))
            same = side is None and first == second
            if not len(a) or not len(b):
                continue
            one = tree(a, words)
            other = one if same else tree(b, words)
            i, j = _descend(one, other, same, 0, need, of)
            if same:
                i, j = i[i != j], j[i != j]
            found[a[np.array(one.order)[i]]] = True
            found[b[np.array(other.order)[j]]] = True
    return found


def _children(i: np.ndarray, one: Tree, level: int, j: np.ndarray, other: Tree) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of pairs; a tree that is lower keeps its root until the other has come down to it."""

    def below(at: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
        if level >= len(tree.levels) - 1:
            return at[:, None], np.ones((len(at), 1), bool)
        children = at[:, None] * LEAF + np.arange(LEAF)
        return children, children < len(tree.levels[level][0])

    a, has_a = below(i, one)
    b, has_b = below(j, other)
    shape = (len(i), a.shape[1], b.shape[1])
    both = has_a[:, :, None] & has_b[:, None, :]
    return np.broadcast_to(a[:, :, None], shape)[both], np.broadcast_to(b[:, None, :], shape)[both]


# ---- the join on Spark


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, text_key, n, node`` of every row, ``bits`` on the first row of a node in its batch, and on some rows ``heavy``: shingles with their counts that
    neighbouring rows repeat."""

    def repeated(seen: dict[int, np.ndarray]) -> bytes:
        tokens, count = np.unique(np.concatenate(list(seen.values())), return_counts=True)
        often = count > 1
        return np.stack([tokens[often], count[often].astype(np.uint64)]).astype("<u8").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            bits: list[bytes | None] = [None] * batch.num_rows
            heavy: list[bytes | None] = [None] * batch.num_rows
            seen: dict[int, np.ndarray] = {}
            sent: set[int] = set()
            held, last = 0, 0
            for i, tokens in shingle_sets(batch.column(1), size):
                n[i], node[i], last = len(tokens), _node(tokens), i
                if int(node[i]) not in sent:
                    sent.add(int(node[i]))
                    bits[i] = bitmap(tokens, _width(len(tokens))).astype("<u8").tobytes()
                if int(node[i]) not in seen:
                    seen[int(node[i])] = tokens
                    held += len(tokens)
                if held >= HELD:
                    heavy[i], seen, held = repeated(seen), {}, 0
            if seen:
                heavy[last] = repeated(seen)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n), pa.array(node), pa.array(bits, pa.binary()), pa.array(heavy, pa.binary())],
                ["doc_id", "text_key", "n", "node", "bits", "heavy"],
            )

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, n long, node long, bits binary, heavy binary")


def _hot(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most repeated shingles, the most frequent last: at most HOT; and those of them that HEAVY sets or more repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for heavy in batch.column(0).to_pylist():
                tokens, count = np.frombuffer(heavy, "<u8").reshape(2, -1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(count)], ["token", "n"])

    counted = sets.filter("heavy is not null").select("heavy").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    most = counted.filter("n >= 8").orderBy(F.desc("n"), "token").limit(HOT).toPandas()
    hot = most["token"].to_numpy(np.int64)[::-1].view(np.uint64).copy()
    return hot, hot[most["n"].to_numpy(np.int64)[::-1] >= HEAVY]


def _prefix_sets(texts: pa.Array, hot: np.ndarray, size: int, need: int, of: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Node, number of shingles and prefix tokens of the distinct nodes of a batch."""
    place = np.argsort(hot)
    known = hot[place]
    seen: set[int] = set()
    for _, tokens in shingle_sets(texts, size):
        node = _node(tokens)
        if node in seen:
            continue
        seen.add(node)
        n = len(tokens)
        length = n - -(-need * n // of) + 1 + n // MORE
        if len(known):
            at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
            rank = np.where(known[at] == tokens, place[at] + 1, 0)
            tokens = tokens[np.argsort(rank, kind="stable")]
        yield node, n, tokens[:length].copy()


def _prefixes(docs: DataFrame, hot: np.ndarray, heavy: np.ndarray, targets: int, size: int, need: int, of: int) -> DataFrame:
    """``target, packed``: the prefix tokens of each batch's distinct nodes but for the heavy ones, dealt to targets by token."""

    def packed(parts: list[np.ndarray], nodes: list[int], sizes: list[int]) -> pa.RecordBatch:
        tokens = np.concatenate(parts)
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        target = (_mix(tokens) % np.uint64(targets)).astype(np.int64)
        order = np.argsort(target, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(target[order]) != 0, [True]]))
        all_nodes, all_sizes = np.array(nodes, np.int64), np.array(sizes, np.int64)
        rows = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = order[a:b]
            used, local = np.unique(owner[own], return_inverse=True)
            head = np.array([len(used), len(own)], np.int64)
            rows.append((int(target[own[0]]), b"".join(x.tobytes() for x in (head, all_nodes[used], all_sizes[used], tokens[own], local.astype(np.uint32)))))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["target", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, nodes, sizes, held = [], [], [], 0
            for node, n, tokens in _prefix_sets(batch.column(0), hot, size, need, of):
                if len(heavy):
                    tokens = tokens[~np.isin(tokens, heavy)]
                    if not len(tokens):
                        continue
                parts.append(tokens)
                nodes.append(node)
                sizes.append(n)
                held += len(tokens)
                if held >= HELD // 2:
                    yield packed(parts, nodes, sizes)
                    parts, nodes, sizes, held = [], [], [], 0
            if parts:
                yield packed(parts, nodes, sizes)

    return docs.mapInArrow(run, "target long, packed binary")


def _heavy_met(docs: DataFrame, hot: np.ndarray, heavy: np.ndarray, size: int, need: int, of: int) -> DataFrame:
    """``anchor, node, n, anchor_n, alone`` for each heavy prefix token, as ``_members`` finds them for the others.

    The nodes of a token are summed up by size first. Its runs are told from these sizes alone, so no task holds its nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
            count = [len(x[2]) for x in held]
            token = np.concatenate([x[2] for x in held]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(token), *(pa.array(np.repeat(np.array([x[c] for x in held], np.int64), count)) for c in (0, 1))], ["token", "node", "n"])

        for batch in batches:
            held, count = [], 0
            for node, n, tokens in _prefix_sets(batch.column(0), hot, size, need, of):
                tokens = tokens[np.isin(tokens, heavy)]
                if len(tokens):
                    held.append((node, n, tokens))
                    count += len(tokens)
                if count >= HELD // 2:
                    yield rows(held)
                    held, count = [], 0
            if held:
                yield rows(held)

    entries = staged(docs.mapInArrow(run, "token long, node long, n long").distinct(), "join-heavy")
    sizes = entries.groupBy("token", "n").agg(F.min("node").alias("low"), F.count("*").alias("nodes"))
    # a run ends where the next size is too far; a token has one row for each size here
    by_size = Window.partitionBy("token").orderBy("n")
    before = F.lag("n").over(by_size)
    sizes = sizes.withColumn("begins", F.when(before.isNull() | (of * before < need * F.col("n")), 1).otherwise(0))
    sizes = sizes.withColumn("run", F.sum("begins").over(by_size))
    whole = Window.partitionBy("token", "run")
    sizes = sizes.withColumn("first", F.min(F.struct("low", "n")).over(whole)).withColumn("length", F.sum("nodes").over(whole))
    sizes = sizes.filter("length > 1").selectExpr("token", "n", "first.low as anchor", "first.n as anchor_n", "cast(length = 2 as long) as alone")
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = entries.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    return salted.join(sizes, ["token", "n", "salt"]).filter("node != anchor").select("anchor", "node", "n", "anchor_n", "alone")


def _members(prefixes: DataFrame, targets: int, need: int, of: int, heavy: DataFrame | None = None) -> DataFrame:
    """``anchor, node, n``: the nodes that share a prefix token, under the smallest of them (with itself); ``heavy`` has
    those that ``_heavy_met`` found.

    Two nodes that meet alone must do so at as many tokens as their lengthened prefixes guarantee for a link. Where
    three or more meet, one common token is enough. A target returns what it found packed, one row for each home of
    nodes; homes sum the pairs up, so a pair is one row in however many targets and tokens it meets."""

    names = ["anchor", "node", "n", "anchor_n", "alone", "least"]

    def summed(rows: np.ndarray) -> np.ndarray:
        """One row of each pair: ``alone`` added, the smallest ``least``."""
        if not len(rows):
            return rows
        rows = rows[np.lexsort((rows[:, 0], rows[:, 1]))]
        first = np.flatnonzero(np.concatenate([[True], (rows[1:, :4] != rows[:-1, :4]).any(axis=1)]))
        return np.concatenate([rows[first, :4], np.add.reduceat(rows[:, 4:5], first), np.minimum.reduceat(rows[:, 5:], first)], axis=1)

    def groups(packed: list[pa.Buffer]) -> np.ndarray:
        tokens, nodes, sizes = [], [], []
        for data in packed:
            used, count = np.frombuffer(data, np.int64, 2).tolist()
            at = 16 + 16 * used
            local = np.frombuffer(data, np.uint32, count, at + 8 * count)
            tokens.append(np.frombuffer(data, np.uint64, count, at))
            nodes.append(np.frombuffer(data, np.int64, used, 16)[local])
            sizes.append(np.frombuffer(data, np.int64, used, 16 + 8 * used)[local])
        token, node, n = np.concatenate(tokens), np.concatenate(nodes), np.concatenate(sizes)
        order = np.lexsort((node, n, token))
        token, node, n = token[order], node[order], n[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node, n = token[new], node[new], n[new]
        # a run ends with its token, or where the next size is too far
        begins = np.ones(len(token), bool)
        begins[1:] = (token[1:] != token[:-1]) | (of * n[:-1] < need * n[1:])
        run = np.cumsum(begins) - 1
        starts = np.flatnonzero(begins)
        if not len(starts):
            return np.empty((0, 6), np.int64)
        length = np.diff(np.concatenate([starts, [len(token)]]))[run]
        anchor = np.flatnonzero(node == np.minimum.reduceat(node, starts)[run])[run]  # a node stands once in a run
        keep = (length > 1) & (anchor != np.arange(len(token)))
        alone = (length == 2).astype(np.int64)
        return summed(np.stack([node[anchor], node, n, n[anchor], alone, alone], axis=1)[keep])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Buffer]]:
        """The packed rows of one key after another, as they lie in their batches."""
        now, held = None, []
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key != now and held:
                    yield held
                    held = []
                now = key
                held.append(data.as_buffer())
        if held:
            yield held

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in each(batches):
            rows = groups(held)
            home = (_mix(rows[:, 1].astype(np.uint64)) % np.uint64(targets)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(home[order]) != 0, [True]])) if len(rows) else np.zeros(1, np.int64)
            parts = [order[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([int(home[p[0]]) for p in parts], pa.int64()), pa.array([rows[p].tobytes() for p in parts], pa.binary())], ["home", "packed"])

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in each(batches):
            rows = summed(np.concatenate([np.frombuffer(data, np.int64) for data in held]).reshape(-1, 6))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T.copy()], names)

    dealt = prefixes.repartition(targets, "target").sortWithinPartitions("target")
    homes = dealt.mapInArrow(meet, "home long, packed binary").repartition(targets, "home").sortWithinPartitions("home")
    met = homes.mapInArrow(sum_up, ", ".join(f"{c} long" for c in names))
    if heavy is not None:
        met = met.union(heavy.withColumn("least", F.col("alone"))).groupBy("anchor", "node", "n", "anchor_n")
        met = met.agg(F.sum("alone").alias("alone"), F.min("least").alias("least"))
    met = staged(met.filter(f"least = 0 or alone >= 1 + floor(least(n, anchor_n) / {MORE})"), "join-met")
    return met.select("anchor", "node", "n").union(met.select("anchor", F.col("anchor").alias("node"), F.col("anchor_n").alias("n")).distinct())


def _bitset(members: DataFrame) -> np.ndarray:
    """A fixed number of bits that has one of each node's: what it lets through is checked by the join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) % np.uint64(FILTER_BITS)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        used = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(bits[used].astype(np.int64))], ["byte", "bits"])

    found = members.select("node").mapInArrow(run, "byte long, bits long").groupBy("byte").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    out[found["byte"].to_numpy(np.int64)] = found["bits"].to_numpy(np.uint8)
    return out


def _token_rows(docs: DataFrame, bits: np.ndarray, size: int) -> DataFrame:
    """``node, data`` (tokens) of nodes that pass the bits, once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, bytes] = {}
            for _, tokens in shingle_sets(batch.column(0), size):
                node = _node(tokens)
                at = (node & (2**64 - 1)) % FILTER_BITS
                if node not in found and bits[at >> 3] >> (at & 7) & 1:
                    found[node] = tokens.astype("<u8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["node", "data"])

    return docs.mapInArrow(run, "node long, data binary")


def _paired(members: DataFrame) -> DataFrame:
    """``anchor, a, b, chunk, node``: each group in chunks, and each chunk once for each pair of chunks (a <= b) it is in."""
    sizes = members.groupBy("anchor").agg(F.count("*").alias("nodes"), F.sum("n").alias("total"))
    chunks = F.greatest(F.ceil(F.col("nodes") / CHUNK_NODES), F.ceil(F.col("total") / CHUNK_TOKENS)).cast("int")
    rows = members.join(staged(sizes.filter("nodes > 1").select("anchor", chunks.alias("chunks")), "join-sizes"), "anchor")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.expr("sequence(0, chunks - 1)")))
    return rows.selectExpr("anchor", "least(chunk, with) as a", "greatest(chunk, with) as b", "chunk", "node", "n")


def _by_pair(rows: DataFrame, work, schema: str) -> DataFrame:
    """``work(held)`` for the rows of each pair of chunks; its columns are the last of them ``data``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["anchor", "a", "b", "chunk", "node", "n", "data"]
    dealt = rows.select(*columns).repartition(parts, "anchor", "a", "b").sortWithinPartitions("anchor", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for *row, data in zip(*(batch.column(c).to_pylist() for c in columns[:-1]), batch.column(columns[-1]), strict=True):
                if row[:3] != now and held:
                    yield work(held)
                    held = []
                now = row[:3]
                held.append((*row, data.as_buffer()))
        if held:
            yield work(held)

    return dealt.mapInArrow(run, schema)


def _near(members: DataFrame, bits: DataFrame, need: int, of: int) -> DataFrame:
    """``anchor, a, b, chunk, node, n``: who may link with another of its pair of chunks, by signatures alone."""

    def work(held: list) -> pa.RecordBatch:
        size = np.array([x[5] for x in held], np.int64)
        side = None if held[0][1] == held[0][2] else np.array([x[3] == x[1] for x in held])
        found = np.flatnonzero(may_link(size, [np.frombuffer(x[6], "<u8") for x in held], side, need, of)).tolist()
        return pa.RecordBatch.from_arrays([pa.array([held[i][c] for i in found], pa.int64()) for c in range(6)], ["anchor", "a", "b", "chunk", "node", "n"])

    rows = _paired(members).join(bits, "node")
    return _by_pair(rows, work, "anchor long, a long, b long, chunk long, node long, n long")


def _stars(near: DataFrame, tokens: DataFrame, need: int, of: int) -> DataFrame:
    """``node, other``: what the trees of all groups connect."""

    def work(held: list) -> pa.RecordBatch:
        left = [x for x in held if x[3] == x[1]]
        right = [x for x in held if x[3] != x[1]]
        sets = lambda xs: [np.frombuffer(x[6], "<u8") for x in xs]
        if held[0][1] == held[0][2]:
            component = tree_join(sets(left), None, need, of)
        else:
            component = tree_join(sets(left), sets(right), need, of) if left and right else np.arange(len(held))
        node = np.array([x[4] for x in left + right], np.int64)
        moved = np.flatnonzero(component != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[component[moved]])], ["node", "other"])

    rows = near.join(tokens.dropDuplicates(["node"]), "node")
    return _by_pair(rows, work, "node long, other long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of all nodes of the edges (``node, other``): the smallest node of each component.

    Each round takes the smallest label around a node and then the label of that label; every round is written to the shared folder."""
    both = staged(edges.select("node", "other").union(edges.select("other", "node")), "join-edges")
    labels = staged(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "join-labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        nearer = labels.join(around, "node").select("node", "label", F.least("label", "near").alias("near"))
        step = nearer.join(labels.selectExpr("node as near", "label as far"), "near").select("node", "label", F.least("near", "far").alias("next"))
        step = staged(step, "join-labels")
        if step.filter("next != label").isEmpty():
            return labels
        labels = step.selectExpr("node", "next as label")


def _grouped(docs: DataFrame, id_col: str, text_col: str, size: int, need: int, of: int) -> DataFrame:
    """``doc_id, text_key, n, label, first`` of every row with words: its component, and the smallest id there."""
    docs = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"), F.xxhash64(whole_text(text_col)).alias("text_key"))
    sets = staged(_sets(docs, size), "join-sets")
    hot, heavy = _hot(sets)
    total = sets.agg(F.sum("n")).first()[0] or 0
    targets = max(1, -(-int(total * (of - need) / of) // TARGET_TOKENS), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = docs.select("text")
    met = _heavy_met(texts, hot, heavy, size, need, of) if len(heavy) else None
    members = staged(_members(_prefixes(texts, hot, heavy, targets, size, need, of), targets, need, of, met), "join-members")
    bits = sets.filter("bits is not null").groupBy("node").agg(F.first("bits").alias("data")).join(members.select("node").distinct(), "node", "left_semi")
    near = staged(_near(members, bits, need, of), "join-near")
    tokens = _token_rows(texts, _bitset(near), size)
    stars = staged(_stars(near, tokens, need, of), "join-stars")
    firsts = sets.filter("n > 0").groupBy("node", "n").agg(F.min("doc_id").alias("first"))
    firsts = firsts.join(components(stars), "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = firsts.groupBy("label").agg(F.min("first").alias("first"))
    names = staged(firsts.select("node", "label").join(names, "label"), "join-names")
    return sets.select("doc_id", "text_key", "n", "node").join(names, "node", "left").drop("node")


def linked_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, need: int = NEED, of: int = OF) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: linked rows have the smallest id of all that they reach.

    Only A-Z are put in lower case; words end at blanks and control white space. Texts that are null or without words have no shingles and are linked with
    nothing, not even each other. Rows with equal texts are linked; rows that share an id are rows of their own, and null ids
    are never a component's name unless no row of it has another."""
    found = _grouped(docs, id_col, text_col, size, need, of)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.expr("if(n = 0, doc_id, first)").alias("component_id"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, need: int = NEED, of: int = OF) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group of linked rows the one with the smallest id stays (null
    ids last, then by a hash of the text; of repeated rows one). Rows without words all stay."""
    found = _grouped(docs, id_col, text_col, size, need, of).filter("n > 0")
    kept = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("kept"))
    kept = staged(kept.select(F.col("kept.doc_id").alias("_kept_id"), F.col("kept.text_key").alias("_kept_key")), "join-kept")
    words = whole_text(text_col).rlike(r"[^\x20\x09-\x0D]")
    keyed = docs.filter(words).withColumn("_own_key", F.xxhash64(whole_text(text_col)))
    stay = keyed.join(kept, (F.col("_own_key") == F.col("_kept_key")) & F.col(id_col).eqNullSafe(F.col("_kept_id")))
    first = F.row_number().over(Window.partitionBy("_own_key", id_col).orderBy(F.lit(0)))
    stay = stay.withColumn("_copy", first).filter("_copy = 1").select(*docs.columns)
    return stay.unionByName(docs.filter(~words))
