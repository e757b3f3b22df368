"""Token ids of whole texts with a byte-level BPE vocabulary, by array operations over many texts at once.

The texts of a batch are laid end to end as code points. Where a pre-token begins follows from the class of each
character (letter, number, white space, other) and its neighbours, so all boundaries come from a few array passes.
Pre-tokens repeat a lot: each distinct one is encoded once per worker, the rest is a lookup. Memory is bounded by
``CHUNK`` code points at a time and ``WORDS`` remembered pre-tokens, whatever the number or the length of the texts.
"""

from __future__ import annotations

import itertools
import re
import sys
import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd

CHUNK = 1_000_000
WORDS = 500_000
TOGETHER = 6_000_000  # code points whose new pre-tokens are encoded together
OTHER, LETTER, NUMBER, SPACE, EDGE = 0, 1, 2, 3, 9
#: a place where a pre-token always ends: between a character and a blank with a letter behind it
_CUT = re.compile(r"(?<=\S)(?= [^\W\d_])")
_ODD = 0x9E3779B97F4A7C15


@cache
def _classes() -> np.ndarray:
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    table[:] = [kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)]
    for first, last in ((9, 13), (32, 32), (133, 133), (160, 160), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        table[first : last + 1] = SPACE
    return table


@cache
def _numbers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random 64-bit number for each character, the powers of an odd number, and those of its inverse."""
    marks = np.random.default_rng(20240229).integers(0, 2**64, sys.maxunicode + 1, np.uint64)
    power, back = np.empty(CHUNK + 1, np.uint64), np.empty(CHUNK + 1, np.uint64)
    for out, base in ((power, _ODD), (back, pow(_ODD, -1, 2**64))):
        out[0], out[1] = 1, base
        done = 2
        while done <= CHUNK:
            n = min(done, CHUNK + 1 - done)
            out[done : done + n] = out[:n] * np.uint64(pow(base, done, 2**64))
            done += n
    return marks, power, back


def boundaries(text: str, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of ``text``, and the first and last (exclusive) position of each pre-token.

    ``edges`` are positions of single characters between texts; they belong to no pre-token."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = _classes()[code]
    kind[edges] = EDGE
    n = len(code)
    start = np.ones(n + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    # the last white space before something else stands alone; a blank is drawn to what follows
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != EDGE))
    start[last] = True
    start[last[code[last] == 32] + 1] = False
    # 's 't 'm 'd 're 've 'll
    mark = np.flatnonzero((code[:-1] == 39) & start[: n - 1] & (kind[1:] == LETTER)) if n > 1 else np.empty(0, np.int64)
    if len(mark):
        one = code[mark + 1]
        two = np.where(kind[np.minimum(mark + 2, n - 1)] == LETTER, code[np.minimum(mark + 2, n - 1)], 0) * (mark + 2 < n)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[mark[short | long] + 1] = False
        start[mark[short] + 2] = True
        start[mark[long] + 3] = True
    start[n] = True
    at = np.flatnonzero(start)
    first, end = at[:-1], at[1:]
    real = kind[first] != EDGE
    return code, first[real], end[real]


class Encoder:
    """Encodes lists of texts; remembers distinct pre-tokens. ``words_to_ids`` encodes a list of distinct pre-tokens
    and returns their ids end to end and their counts. ``special`` is matched in texts before anything else."""

    def __init__(self, words_to_ids: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], special: dict[str, int], words: int = WORDS):
        self.words_to_ids, self.special, self.words = words_to_ids, special, words
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.ids, self.offsets, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _pieces(self, texts: list[str]):
        """(text index, piece, special id or None); a piece has at most about CHUNK characters and whole pre-tokens."""
        for i, text in enumerate(texts):
            parts = self.split.split(text) if self.split and any(s in text for s in self.special) else [text]
            for j, part in enumerate(parts):
                if j % 2:
                    yield i, "", self.special[part]
                    continue
                while len(part) > CHUNK // 2:
                    found = _CUT.search(part, CHUNK // 2, CHUNK - 1)
                    if not found:  # one unbroken run: encode as it is, in arrays of its own length
                        break
                    yield i, part[: found.start()], None
                    part = part[found.start() :]
                if part:
                    yield i, part, None

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end (uint32), and the number of ids of each text."""
        ids, counts, i = [np.empty(0, np.uint32)], [np.empty(0, np.int64)], 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= TOGETHER):
                size += len(texts[j])
                j += 1
            for out, found in zip((ids, counts), self._encode(texts[i:j]), strict=True):
                out.append(found)
            i = j
        return np.concatenate(ids), np.concatenate(counts)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.slots) > self.words:
            self._forget()
        groups, group, size = [], [], 0
        pending: list[str] = []
        for piece in self._pieces(texts):
            if group and size + len(piece[1]) + 1 > CHUNK:
                groups.append(self._slots(group, pending))
                group, size = [], 0
            group.append(piece)
            size += len(piece[1]) + 1
        if group:
            groups.append(self._slots(group, pending))
        if pending:
            ids, counts = self.words_to_ids(pending)
            self.offsets = np.concatenate([self.offsets, len(self.ids) + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        lengths = np.zeros(len(texts), np.int64)
        out = []
        for owner, special, tokens, slots in groups:
            counts = self.counts[slots]
            total = np.concatenate([[0], np.cumsum(counts)])
            flat = self.ids[np.repeat(self.offsets[slots] - total[:-1], counts) + np.arange(total[-1])]
            ends = np.cumsum(tokens)
            sizes = total[ends] - total[ends - tokens]
            if special is not None:
                flat = np.insert(flat, np.cumsum(sizes)[special >= 0] - sizes[special >= 0], special[special >= 0].astype(np.uint32))
                sizes = sizes + (special >= 0)
            np.add.at(lengths, owner, sizes)
            out.append(flat)
        return np.concatenate(out) if out else np.empty(0, np.uint32), lengths

    def _slots(self, group, pending):
        """For the pieces of a group: their text, special ids, numbers of pre-tokens, and the slot of each pre-token."""
        owner = np.array([i for i, _, _ in group])
        special = np.array([-1 if s is None else s for _, _, s in group]) if any(s is not None for _, _, s in group) else None
        length = np.array([len(p) for _, p, _ in group])
        edges = np.cumsum(length + 1) - 1
        text = "\n".join(p for _, p, _ in group) + "\n"
        code, first, end = boundaries(text, edges)
        tokens = np.diff(np.concatenate([[0], np.searchsorted(first, edges)]))
        marks, power, back = _numbers() if len(code) <= CHUNK else _long_numbers(len(code))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(marks[code] * power[: len(code)])])
        key = (total[end] - total[first]) * back[first] + (end - first).astype(np.uint64)
        seen, distinct = pd.factorize(key)
        where = np.empty(len(distinct), np.int64)
        where[seen[::-1]] = np.arange(len(seen))[::-1]
        keys = distinct.tolist()
        slot = np.fromiter(map(self.slots.get, keys, itertools.repeat(-1)), np.int64, len(keys))
        for i in np.flatnonzero(slot < 0).tolist():
            slot[i] = self.slots[keys[i]] = len(self.slots)
            pending.append(text[first[where[i]] : end[where[i]]])
        return owner, special, tokens, slot[seen]


def _long_numbers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    marks = _numbers()[0]
    with np.errstate(over="ignore"):
        ramp = lambda base: np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(base))]), dtype=np.uint64)
        return marks, ramp(_ODD), ramp(pow(_ODD, -1, 2**64))


@cache
def library_encoder(path: str, words: int = WORDS) -> Encoder:
    """The ids of the tokenizers library, one encoder per Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(counts.sum())), counts

    return Encoder(encode, {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}, words)
