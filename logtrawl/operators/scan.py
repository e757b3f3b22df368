"""All places of many patterns in a batch of lines, by array operations.

Every stretch of the batch that is as long as some pattern has a key, the difference of two running sums; keys of one length are
compared with those of the patterns of that length, through a table of marks that turns most places away at once. What is found
is compared byte by byte. Work grows with the bytes and with the number of different lengths, at most ``HEAD``: a longer
pattern is looked for by its first ``HEAD`` bytes and compared where these stand.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

HEAD = 32
PIECE = 1 << 20  # bytes worked on at once
SLICE_BYTES = 8_000_000  # of the lines whose matches are held at once
_ODD = 0x9E3779B97F4A7C15

FOUND = T.ArrayType(T.StructType([T.StructField("pattern_id", T.IntegerType()), T.StructField("occurrence", T.LongType()), T.StructField("match_pos", T.LongType())]))


def _powers(base: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(PIECE + HEAD, np.uint64(base))]), dtype=np.uint64)


class Scan:
    """Distinct patterns, none empty, as bytes; ``places`` finds them by their number."""

    def __init__(self, patterns: Sequence[bytes]):
        self.width = np.array([len(p) for p in patterns], np.int64)
        self.start = np.cumsum(self.width) - self.width
        self.flat = np.frombuffer(b"".join(patterns), np.uint8)
        self.mark = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) ^ np.uint64(0x94D049BB133111EB)
        by_length = defaultdict(list)
        for n, p in enumerate(patterns):
            by_length[min(len(p), HEAD)].append(n)
        self.power = self.back = None
        self._prepare()
        self.tables = []
        for length, numbers in sorted(by_length.items()):
            heads = np.frombuffer(b"".join(patterns[n][:length] for n in numbers), np.uint8)
            keys = np.concatenate([self._keys(heads[i : i + PIECE // HEAD * length], length)[::length] for i in range(0, len(heads), PIECE // HEAD * length)])
            order = np.argsort(keys, kind="stable")
            bits = max(10, min(22, int(16 * len(keys) - 1).bit_length()))
            marks = np.zeros(1 << bits, bool)
            marks[keys >> np.uint64(64 - bits)] = True
            self.tables.append((length, bits, marks, keys[order], np.array(numbers, np.int64)[order]))
        self.power = self.back = None  # made anew where it is used

    def _prepare(self) -> None:
        if self.power is None:
            self.power, self.back = _powers(_ODD), _powers(pow(_ODD, -1, 2**64))

    def _sums(self, data: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.mark[data] * self.power[: len(data)])])

    def _keys(self, data: np.ndarray, length: int, sums: np.ndarray | None = None) -> np.ndarray:
        """The key of each stretch of ``length`` bytes."""
        sums = self._sums(data) if sums is None else sums
        count = max(0, len(data) - length + 1)
        return (sums[length : length + count] - sums[:count]) * self.back[:count]

    def _candidates(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and pattern numbers where keys agree, for each piece and length; places of one pattern ascend."""
        for base in range(0, len(data), PIECE):
            piece = data[base : base + PIECE + HEAD - 1]
            sums = self._sums(piece)
            for length, bits, marks, keys, numbers in self.tables:
                own = self._keys(piece, length, sums)[:PIECE]
                at = np.flatnonzero(marks[own >> np.uint64(64 - bits)])
                own = own[at]
                low, high = np.searchsorted(keys, own, side="left"), np.searchsorted(keys, own, side="right")
                hit = np.flatnonzero(high > low)
                at, low, count = at[hit], low[hit], (high - low)[hit]
                if len(at) and count.max() > 1:  # patterns with one head, or keys that happen to agree
                    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    at, low = np.repeat(at, count), np.repeat(low, count) + step
                yield base + at, numbers[low]

    def places(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Line, pattern and place in the line of every occurrence, ordered so; lines end at ``ends``, the last being the end of ``data``."""
        self._prepare()
        lines, numbers, places = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at, number in self._candidates(data):
            line = np.searchsorted(ends, at, side="right")
            inside = at + self.width[number] <= ends[line]
            at, number, line = at[inside], number[inside], line[inside]
            for i in range(0, len(at), PIECE):
                a, n = at[i : i + PIECE], number[i : i + PIECE]
                same = self._same(data, a, n)
                lines.append(line[i : i + PIECE][same])
                numbers.append(n[same])
                places.append(a[same])
        line, number, place = map(np.concatenate, (lines, numbers, places))
        order = np.argsort(line * len(self.width) + number, kind="stable")
        line = line[order]
        return line, number[order], place[order] - np.concatenate([[0], ends])[line]

    def _same(self, data: np.ndarray, at: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Whether the bytes agree; long patterns are compared some at a time."""
        width = self.width[number]
        ok = np.zeros(len(at), bool)
        ends = np.cumsum(width)
        i = 0
        while i < len(at):
            base = ends[i] - width[i]
            j = max(i + 1, int(np.searchsorted(ends, base + 4 * PIECE, side="right")))
            w = width[i:j]
            begin = ends[i:j] - w - base
            step = np.arange(ends[j - 1] - base) - np.repeat(begin, w)
            differs = data[np.repeat(at[i:j], w) + step] != self.flat[np.repeat(self.start[number[i:j]], w) + step]
            ok[i:j] = np.add.reduceat(differs, begin) == 0
            i = j
        return ok


def found_in(scan: Scan, column: int, schema: T.StructType):
    """For ``mapInArrow``: batches with one more column, all occurrences in the lines of a column as ``FOUND``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(column)
            offsets = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64) if len(lines) else np.zeros(1, np.int64)
            raw = lines.buffers()[2] if len(lines) else None
            data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
            i = 0
            while i < len(lines):
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1)
                line, number, place = scan.places(data[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i])
                new = np.ones(len(line), bool)
                new[1:] = (line[1:] != line[:-1]) | (number[1:] != number[:-1])
                first = np.flatnonzero(new)
                nth = np.arange(len(line)) - np.repeat(first, np.diff(np.append(first, len(line))))
                found = pa.StructArray.from_arrays([pa.array(number.astype(np.int32)), pa.array(nth), pa.array(place)], ["pattern_id", "occurrence", "match_pos"])
                cuts = np.searchsorted(line, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.ListArray.from_arrays(cuts, found)], schema.names)
                i = j

    return run
