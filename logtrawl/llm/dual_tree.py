"""Ranked lexical search, exact, by dual-tree search: hierarchies over items and over documents hold coordinate maxima.

A document's coordinate of a term is what the term adds to a score for each unit of its weight; an item's coordinate is the weight of the
term times its repeats. A score is the inner product of both. Leaves of the document tree hold ``FAN`` documents, leaves of the item
tree ``ITEM_FAN`` items, every node above the largest coordinates below it, so the product of two nodes bounds every score
between them. Pairs of nodes whose bound is below the weakest kth score of the node's items are dropped with all that is below them. What
is left is scored exactly, the most promising leaves first, as each new kth score drops more.

Texts are read once for each group of items: documents become vectors over the terms of the items, and N, L and the document
frequencies are summed up over all documents on the way. These vectors are searched twice: first every ``SEED``th document, whose kth scores
are lower bounds for all, then all of them. A task keeps ``k`` rows an item; by the seeds, few of the rows that it returns are in vain.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, staged, whole_text

PIECE = 2 << 20  # bytes of text worked on at once
GROUP_TERMS = 100_000  # terms of the items that are searched together, one item at least: bounds what is sent to every task
COLUMNS = 8192  # distinct terms of the items of one tree, one item at least
CELLS, ITEM_CELLS = 1 << 24, 1 << 22  # coordinates of the documents, and of the items, of one tree
BLOCK = 4096  # documents of one tree
FAN, ITEM_FAN = 8, 8
CHUNK = 512  # documents scored before the kth scores are looked at again
SEED = 16
_ODD, _M1 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


@cache
def _tables():
    byte = np.arange(256, dtype=np.uint8)
    byte[65:91] += 32
    term = np.zeros(256, bool)
    term[48:58] = term[65:91] = term[97:123] = term[128:] = True
    marks = np.arange(1, 257, dtype=np.uint64) * np.uint64(_M1)
    marks ^= marks >> np.uint64(29)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(PIECE, np.uint64(_ODD))]), dtype=np.uint64)
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(PIECE, np.uint64(pow(_ODD, -1, 2**64)))]), dtype=np.uint64)
    return byte, term, marks, power, back


def _keys(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit key of each stretch of at most PIECE bytes in lower case."""
    _, _, marks, power, back = _tables()
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(marks[data] * power[: len(data)])])
    return (total[end] - total[first]) * back[first] ^ (end - first).astype(np.uint64)


def text_terms(text: str | None) -> list[bytes]:
    """The terms of a text: letters and digits of ASCII and everything beyond it, A-Z in lower case."""
    return [t.lower() for t in _TERM.findall((text or "").encode())]


class Terms:
    """A list of distinct terms that texts are looked up in."""

    def __init__(self, terms: list[bytes]):
        self.long = {t: i for i, t in enumerate(terms) if len(t) > PIECE}
        short = [i for i, t in enumerate(terms) if len(t) <= PIECE]
        keys = []
        for i in range(0, len(short), 10_000):
            part = [terms[s] for s in short[i : i + 10_000]]
            for t in [part] if sum(map(len, part)) <= PIECE else [[t] for t in part]:
                ends = np.cumsum([len(x) for x in t])
                keys.append(_keys(np.frombuffer(b"".join(t), np.uint8), np.concatenate([[0], ends[:-1]]), ends))
        keys = np.concatenate([np.empty(0, np.uint64), *keys])
        order = np.argsort(keys)
        self.keys, self.number = keys[order], np.array(short, np.int64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two terms of the items share a key")
        self.width = np.array([len(t) for t in terms], np.int64)
        self.start = np.cumsum(self.width) - self.width
        self.flat = np.frombuffer(b"".join(terms), np.uint8)

    def _look_up(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each term of ``data`` (at most PIECE bytes, a text begins at each of ``begins``) starts, and its number or -1."""
        lower, term = _tables()[:2]
        inside = term[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        inner = begins[(begins > 0) & (begins < len(data))]
        first[inner] = inside[inner]
        last[inner - 1] = inside[inner - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        number = np.full(len(start), -1)
        if not len(self.keys) or not len(start):
            return start, number
        data = lower[data]
        key = _keys(data, start, end)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == key)
        found = self.number[at[hit]]
        same = self.width[found] == (end - start)[hit]
        hit, found = hit[same], found[same]
        # the key told where to look; the bytes decide
        width = self.width[found]
        total = np.cumsum(width)
        if len(hit):
            step = np.arange(total[-1]) - np.repeat(total - width, width)
            differs = data[np.repeat(start[hit], width) + step] != self.flat[np.repeat(self.start[found], width) + step]
            same = np.add.reduceat(differs, total - width) == 0
            number[hit[same]] = found[same]
        return start, number

    def _one_text(self, data: np.ndarray) -> np.ndarray:
        """Numbers of the terms of one text of any length."""
        lower, term = _tables()[:2]
        out, at = [], 0
        while at < len(data):
            stop = min(len(data), at + PIECE)
            if stop < len(data):
                gap = np.flatnonzero(~term[data[at:stop]])
                if not len(gap):  # a term as long as a piece, or longer
                    end = stop + int(np.argmax(np.concatenate([~term[data[stop:]], [True]])))
                    if end > stop:
                        out.append(np.array([self.long.get(lower[data[at:end]].tobytes(), -1)]))
                    else:
                        out.append(self._look_up(data[at:end], np.zeros(1, np.int64))[1])
                    at = end
                    continue
                stop = at + int(gap[-1])
            out.append(self._look_up(data[at:stop], np.zeros(1, np.int64))[1])
            at = max(stop, at + 1)
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def counts(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Pieces of a string array without nulls: position of the first text, all terms of each text, and for each known
        term of a text the text (from the first), the term and how often it occurs, in this order."""
        if pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.string())
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
        i = 0
        while i < len(texts):
            j = int(np.searchsorted(offsets, offsets[i] + PIECE, side="right")) - 1
            if j <= i:
                j = i + 1
                number = self._one_text(data[offsets[i] : offsets[j]])
                doc = np.zeros(len(number), np.int64)
            else:
                start, number = self._look_up(data[offsets[i] : offsets[j]], offsets[i:j] - offsets[i])
                doc = np.searchsorted(offsets[i + 1 : j + 1] - offsets[i], start, side="right")
            known = number >= 0
            size = max(1, len(self.width))
            pair, times = np.unique(doc[known] * size + number[known], return_counts=True)
            yield i, np.bincount(doc, minlength=j - i), pair // size, pair % size, times
            i = j


def weight(documents: int, with_term: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * with_term + 1)))


def coordinates(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What a unit of weight adds for terms that occur ``tf`` times in documents of ``n`` terms."""
    if len(n) and 25 * int(n.max()) * documents >= 2**63:
        m = np.array([75 + 25 * x * documents // terms for x in n.tolist()], np.int64)
    else:
        m = 75 + 25 * n * documents // max(1, terms)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


# ---- trees


class Items:
    """A tree over items: their weights by term, in leaves of ITEM_FAN, and the largest weights of each level above."""

    def __init__(self, items: list[dict[int, int]], numbers: list[int]):
        self.columns = np.unique(np.concatenate([np.fromiter(i, np.int64, len(i)) for i in items]))
        most = max(sum(i.values()) for i in items) * 1_000_000
        #: float64 holds sums below 2**53 exactly; larger ones are added as integers
        self.kind = np.float64 if most < 2**53 else np.int64 if most < 2**63 else object
        rows = np.zeros((len(items), len(self.columns)), self.kind)
        for r, item in enumerate(items):
            rows[r, np.searchsorted(self.columns, np.fromiter(item, np.int64, len(item)))] = list(item.values())
        self.numbers, self.levels, self.fan = np.array(numbers), [rows], ITEM_FAN
        while len(self.levels[-1]) > 1:
            self.levels.append(np.maximum.reduceat(self.levels[-1], np.arange(0, len(self.levels[-1]), self.fan), axis=0))
        if len(self.levels) == 1:
            self.levels.append(rows)


def item_trees(items: list[dict[int, int]], frequency: np.ndarray) -> list[Items]:
    """Trees over items that hold terms, neighbours sharing their commonest and then their rarest term."""
    rank = lambda i: (max(items[i], key=lambda t: (frequency[t], t)), min(items[i], key=lambda t: (frequency[t], t)))
    order = sorted((i for i in range(len(items)) if items[i]), key=lambda i: (*rank(i), i))
    out, now, seen = [], [], set()
    for i in order:
        columns = len(seen | items[i].keys())
        if now and (columns > COLUMNS or columns * (len(now) + 1) > ITEM_CELLS):
            out.append(now)
            now, seen = [], set()
        now.append(i)
        seen |= items[i].keys()
    return [Items([items[i] for i in part], part) for part in [*out, now] if part]


class Best:
    """The k best documents of each item so far, and the score that one more needs."""

    def __init__(self, k: int, floor: np.ndarray):
        self.k, self.need = k, np.maximum(floor, 1)
        self.rows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.pairs = self.scored = 0

    def add(self, item: int, score: np.ndarray, null: np.ndarray, doc: np.ndarray) -> None:
        if item in self.rows:
            score, null, doc = (np.concatenate(x) for x in zip(self.rows[item], (score, null, doc), strict=True))
        if len(score) > self.k:
            first = np.lexsort((doc, null, -score))[: self.k]
            score, null, doc = score[first], null[first], doc[first]
        self.rows[item] = (score, null, doc)
        if len(score) == self.k:
            self.need[item] = max(self.need[item], score.min())


def _as(coordinates: np.ndarray, kind) -> np.ndarray:
    return coordinates.astype(np.int64).astype(object) if kind is object else coordinates.astype(kind)


def _levels(block: np.ndarray, kind, fan: int) -> list[np.ndarray]:
    """Largest coordinates of the nodes over a block of documents, from the leaves (of ``fan`` documents) to the root."""
    out = [_as(np.maximum.reduceat(block, np.arange(0, len(block), fan), axis=0), kind)]
    while len(out[-1]) > 1:
        out.append(np.maximum.reduceat(out[-1], np.arange(0, len(out[-1]), fan), axis=0))
    return out


def search_block(tree: Items, block: np.ndarray, ids: np.ndarray, null: np.ndarray, best: Best, fan: int = FAN, chunk: int = CHUNK) -> None:
    """Add to ``best`` what the documents of a block (a row of coordinates each, by the tree's columns) score for its items."""
    docs, items = _levels(block, tree.kind, fan), tree.levels
    needs = [best.need[tree.numbers]]
    while len(needs) < len(items):
        needs.append(np.minimum.reduceat(needs[-1], np.arange(0, len(needs[-1]), tree.fan)) if len(needs[-1]) > 1 else needs[-1])
    d, i = len(docs) - 1, len(items) - 1
    open_ = np.ones((len(docs[d]), len(items[i])), bool)
    while True:  # both trees level by level; the lower one waits at its leaves
        rows, columns = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
        bound = np.zeros(open_.shape, tree.kind)
        bound[np.ix_(rows, columns)] = docs[d][rows] @ items[i][columns].T
        open_ &= bound >= needs[i]
        if not open_.any() or (d == 0 and i <= 1):
            break
        if d:
            open_ = np.repeat(open_, fan, axis=0)[: len(docs[d - 1])]
        if i > 1:
            open_ = np.repeat(open_, tree.fan, axis=1)[:, : len(items[i - 1])]
        d, i = max(d - 1, 0), max(i - 1, 1)
    best.pairs += len(block) * len(items[0])
    for leaf in np.flatnonzero(open_.any(axis=0)).tolist():
        own = np.arange(leaf * tree.fan, min((leaf + 1) * tree.fan, len(items[0]))) if len(items[0]) > 1 else np.zeros(1, np.int64)
        used = np.flatnonzero(items[1][leaf])
        weights = items[0][np.ix_(own, used)].T
        leaves = np.flatnonzero(open_[:, leaf])
        leaves = leaves[np.argsort(-bound[leaves, leaf], kind="stable")]
        for at in range(0, len(leaves), chunk // fan):
            part = leaves[at : at + chunk // fan]
            numbers = tree.numbers[own]
            part = part[bound[part, leaf] >= best.need[numbers].min()]
            if not len(part):
                break
            rows = (part[:, None] * fan + np.arange(fan)).ravel()
            rows = rows[rows < len(block)]
            score = _as(block[np.ix_(rows, used)], tree.kind) @ weights
            best.scored += score.size
            for c, number in enumerate(numbers.tolist()):
                hit = np.flatnonzero(score[:, c] >= best.need[number])
                if len(hit):
                    best.add(number, score[hit, c].astype(np.int64), null[rows[hit]], ids[rows[hit]])


# ---- the search on Spark


def _vectors(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """``doc_id, n, terms, counts`` of each document that holds any of the terms; and for each task a row in which ``docs`` is
    the number of its documents that have terms, ``n`` all their terms, and ``counts`` how many of them hold each of ``terms``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(terms)
        holds, documents, total = np.zeros(len(terms), np.int64), 0, 0

        def rows(ids: pa.Array, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, count: np.ndarray, docs: int | None) -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((term, pa.int32()), (count, pa.int64()))]
            return pa.RecordBatch.from_arrays([ids, pa.array(n), *lists, pa.array([docs] * len(ids), pa.int64())], ["doc_id", "n", "terms", "counts", "docs"])

        for batch in by_bytes(batches, 1):
            for first, n, doc, term, count in known.counts(batch.column(1)):
                documents += int((n > 0).sum())
                total += int(n.sum())
                holds += np.bincount(term, minlength=len(terms))
                sizes = np.bincount(doc, minlength=len(n))
                some = np.flatnonzero(sizes)
                if len(some):
                    yield rows(batch.column(0).slice(first, len(n)).take(pa.array(some)), n[some], sizes[some], term, count, None)
        used = np.flatnonzero(holds)
        yield rows(pa.array([None], pa.int64()), np.array([total]), np.array([len(used)]), used, holds[used], documents)

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>, docs long")


def _search(vectors: DataFrame, trees: list[Items], floor: np.ndarray, documents: int, total: int, frequency: np.ndarray, k: int) -> DataFrame:
    """``item, doc_id, score``: the k best of each task for each item, of those that score at least ``floor``."""
    widest = max((len(t.columns) for t in trees), default=1)
    size, fan, chunk = max(1, min(BLOCK, CELLS // widest)), FAN, CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k, floor.copy())

        def search(ids: pa.Array, n: np.ndarray, doc: np.ndarray, term: np.ndarray, count: np.ndarray) -> None:
            value = coordinates(count, n[doc], documents, total)
            # neighbours share their commonest and their rarest term
            head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            often = np.lexsort((term, -frequency[term], doc))[head]
            seldom = np.lexsort((term, frequency[term], doc))[head]
            order = np.lexsort((n, term[seldom], term[often]))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            null, known = ids.is_null().to_numpy(zero_copy_only=False)[order], ids.fill_null(0).to_numpy()[order]
            for tree in trees:
                at = np.minimum(np.searchsorted(tree.columns, term), len(tree.columns) - 1)
                own = tree.columns[at] == term
                block = np.zeros((len(n), len(tree.columns)), np.float32)  # coordinates are below 2**24
                block[place[doc[own]], at[own]] = value[own]
                search_block(tree, block, known, null, best, fan, chunk)

        for batch in batches:
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                ids, n, terms, counts = (part.column(c) for c in range(4))
                sizes = np.diff(terms.offsets.to_numpy())
                search(ids, n.to_numpy(), np.repeat(np.arange(len(n)), sizes), terms.flatten().to_numpy(), counts.flatten().to_numpy())
        for item, (score, null, doc) in best.rows.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), item)), pa.array(doc, mask=null), pa.array(score)], ["item", "doc_id", "score"])

    return vectors.select("doc_id", "n", "terms", "counts").mapInArrow(run, "item long, doc_id long, score long")


def _of_group(docs: DataFrame, items: list[tuple[object, Counter]], k: int) -> DataFrame:
    """``item`` (its number in the list), ``rank, doc_id, score`` of items that are searched together."""
    terms = sorted(set().union(*(counter for _, counter in items)))
    number = {t: i for i, t in enumerate(terms)}
    vectors = staged(_vectors(docs, terms), "search-vectors")
    sums = vectors.filter("docs is not null").agg(F.sum("docs"), F.sum("n")).first()
    documents, total = sums[0] or 0, sums[1] or 0
    held = vectors.filter("docs is not null").select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("n"))
    frequency = np.zeros(max(1, len(terms)), np.int64)
    for term, n in held.collect():  # one row a term of these items
        frequency[term] = n
    weights = [{number[t]: times * weight(documents, int(frequency[number[t]])) for t, times in counter.items() if frequency[number[t]]} for _, counter in items]
    trees = item_trees(weights, frequency)
    vectors = vectors.filter("docs is null")
    floor = np.zeros(len(items), np.int64)
    best_first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)
    some = vectors.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(SEED)) == 0)
    for item, score in ranked(_search(some, trees, floor, documents, total, frequency, k)).filter(F.col("rank") == k).select("item", "score").collect():
        floor[item] = score
    return ranked(_search(vectors, trees, floor, documents, total, frequency, k)).select("item", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of each item that score highest above 0, all if fewer.

    Equal scores are ranked by ascending id, null ids last. Ids of documents are whole numbers; those of items may be of any type
    and null. Null and empty texts have no terms: such documents are in no result and no count, such items have no rows. Rows that
    share an id are documents, or items with rows of their own. Items are read one group after another (``GROUP_TERMS``), each group
    in one pass over the documents; an item must fit into a task."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    kind = items.schema["item_id"].dataType
    out: DataFrame | None = None

    def search(group: list[tuple[object, Counter]]) -> None:
        nonlocal out
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(group)], f"item long, item_id {kind.simpleString()}")
        found = staged(_of_group(docs, group, k), "search-ranked").join(F.broadcast(names), "item")  # a group is bounded
        found = found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.unionByName(found)

    group: list[tuple[object, Counter]] = []
    held = 0
    for name, text in items.toLocalIterator():
        counter = Counter(text_terms(text))
        if not counter:
            continue
        if group and held + len(counter) > GROUP_TERMS:
            search(group)
            group, held = [], 0
        group.append((name, counter))
        held += len(counter)
    if group:
        search(group)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
