"""Byte-level BPE by a pair occurrence index.

All distinct pre-tokens of a batch of a partition stand in one linked array of symbols. The index maps each
mergeable pair to all its positions in that array. The active ranks are taken in ascending order; all places of a
pair are merged together, and the lists of the pairs that this makes are extended. A place that a merge has
consumed since it was listed is recognised by its symbols and skipped.

A merge can only make pairs of a later rank, as their left or right part does not exist before it, so one ascending
pass is the same as repeating "merge the lowest-ranked pair" in every pre-token.
"""

from __future__ import annotations

import heapq
import json
from functools import cache

import numpy as np

from .pretoken import Encoder

_BASE = 1 << 20


class Vocabulary:
    """Merges, bytes of each id and special tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        vocab = data["model"]["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = dict(zip(printable, map(chr, printable), strict=True))
        shown |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.of_byte = np.array([vocab[shown[b]] for b in range(256)], np.int64)
        byte = {c: b for b, c in shown.items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = self.left * _BASE + self.right
        self.rank_order = np.argsort(key)
        self.keys = key[self.rank_order]
        self.widths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.starts = np.cumsum(self.widths) - self.widths

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it cannot be merged."""
        key = left * _BASE + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_order[at], -1)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, end to end."""
        width = self.widths[ids]
        total = np.cumsum(width)
        return self.flat[np.repeat(self.starts[ids] - (total - width), width) + np.arange(total[-1] if len(total) else 0)]


def merge_words(vocabulary: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pre-tokens end to end, and how many each has."""
    raw = [w.encode() for w in words]
    length = np.fromiter(map(len, raw), np.int64, len(raw))
    symbol = vocabulary.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
    n = len(symbol)
    ends = np.cumsum(length)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends[length > 0] - 1] = -1
    before[(ends - length)[length > 0]] = -1
    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def extend(place: np.ndarray) -> None:
        rank = vocabulary.ranks(symbol[place], symbol[after[place]])
        place, rank = place[rank >= 0], rank[rank >= 0]
        if not len(place):
            return
        if len(place) > 1:
            order = np.argsort(rank, kind="stable")
            place, rank = place[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for part, r in zip(np.split(place, cuts), rank[np.concatenate([[0], cuts])].tolist(), strict=True):
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(active, r)

    extend(np.flatnonzero(after >= 0))
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        place = lists[0] if len(lists) == 1 else np.concatenate(lists)
        a, b, made = vocabulary.left[r], vocabulary.right[r], vocabulary.made[r]
        gone = after[place]
        place = place[(symbol[place] == a) & (gone >= 0) & (symbol[gone] == b)]
        if a == b and len(place) > 1:  # of overlapping places, every other one from the left
            place.sort()
            chained = np.concatenate([[False], after[place[:-1]] == place[1:]])
            step = np.arange(len(place))
            place = place[(step - np.maximum.accumulate(np.where(chained, 0, step))) % 2 == 0]
        if not len(place):
            continue
        gone = after[place]
        symbol[place] = made
        symbol[gone] = -1
        follow = after[gone]
        after[place] = follow
        held = follow >= 0
        before[follow[held]] = place[held]
        front = before[place]
        touched = np.concatenate([front[front >= 0], place[held]])
        extend(np.unique(touched) if len(touched) > 1 else touched)
    left = symbol >= 0
    count = np.concatenate([[0], np.cumsum(left)])
    return symbol[left].astype(np.uint32), count[ends] - count[ends - length]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@cache
def pair_encoder(path: str) -> Encoder:
    """One encoder per Python worker."""
    own = vocabulary(path)
    return Encoder(lambda words: merge_words(own, words), own.special)
