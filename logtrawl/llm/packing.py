"""Sum-of-squares online packing of documents into windows of a fixed number of tokens.

A document's full windows are cut off from its front. What is left goes, in the order of the rows, to the fill level
whose choice leaves the smallest sum of squares of the counts of partially filled windows; a level array holds those
counts. Each partition packs its own rows in one pass, without a shuffle. It holds its open windows with their ids: at most
``OPEN``. At that number, and at the end of a partition, the emptiest open windows are cut to fill the fullest,
and at the very end the one window that is left over is cut into lengths that are powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, whole_text
from .pretoken import library_encoder

OPEN = 4096


class Packer:
    """Packs pieces of one partition. A piece is ``(row, start, ids)``; ``emit(piece, sequence, offset)`` takes each
    piece once its place is final."""

    def __init__(self, window: int, emit, open_windows: int = OPEN):
        self.window, self.emit, self.most = window, emit, open_windows
        self.level = np.zeros(window + 1, np.int64)  # of each fill, how many windows; 0 and window are never counted
        self.at: list[list[list]] = [[] for _ in range(window)]  # windows by fill, each a list of pieces
        self.open, self.next = 0, 0

    def add(self, row, ids: np.ndarray) -> None:
        full = len(ids) - len(ids) % self.window
        for start in range(0, full, self.window):
            self._close([(row, start, ids[start : start + self.window])])
        if full < len(ids):
            self._place((row, full, ids[full:]))

    def _place(self, piece) -> None:
        size = len(piece[2])
        last = self.window - size
        # change of the sum of squares for each level a window may have now
        change = 2 * self.level[size:] + 1
        change[last] = 0  # a full window isn't counted
        change[1:] += 1 - 2 * self.level[1 : last + 1]
        change[1:][self.level[1 : last + 1] == 0] = np.iinfo(np.int64).max
        fill = last - int(np.argmin(change[::-1]))  # the fullest of equals
        if fill:
            held = self.at[fill].pop()
            self.level[fill] -= 1
        else:
            held = []
            self.open += 1
        held.append(piece)
        if fill == last:
            self.open -= 1
            self._close(held)
        else:
            self.at[fill + size].append(held)
            self.level[fill + size] += 1
            if self.open > self.most:
                self._settle()

    def _close(self, pieces: list) -> None:
        offset = 0
        for piece in pieces:
            self.emit(piece, self.next, offset)
            offset += len(piece[2])
        self.next += 1

    def _settle(self) -> None:
        """Cut the emptiest open windows to fill the fullest; at most one stays open."""
        windows = [(fill, held) for fill in range(1, self.window) for held in self.at[fill]]
        self.at, self.open = [[] for _ in range(self.window)], 0
        self.level[:] = 0
        low, high = 0, len(windows) - 1
        spare: list = []
        while low <= high:
            fill, held = windows[high]
            high -= 1
            while fill < self.window:
                if not spare:
                    if low > high:
                        break
                    spare = windows[low][1][::-1]
                    low += 1
                row, start, ids = spare.pop()
                room = self.window - fill
                held.append((row, start, ids[:room]))
                if len(ids) > room:
                    spare.append((row, start + room, ids[room:]))
                fill += min(room, len(ids))
            if fill == self.window:
                self._close(held)
            else:
                spare = held[::-1]
                break
        fill = sum(len(p[2]) for p in spare)
        if fill:
            self.at[fill].append(spare[::-1])
            self.level[fill], self.open = 1, 1

    def finish(self) -> None:
        self._settle()
        spare = next((held[0][::-1] for held in self.at if held), [])
        left = sum(len(p[2]) for p in spare)
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            held = []
            while room:
                row, start, ids = spare.pop()
                held.append((row, start, ids[:room]))
                if len(ids) > room:
                    spare.append((row, start + room, ids[room:]))
                room -= min(room, len(ids))
            self._close(held)


def pack_documents(docs: DataFrame, vocabulary_path: str, end_id: int, window: int = 1024, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row a piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, and ``ids`` if asked for.

    Each document is its ids and ``end_id``; a null text is empty. Null and repeated ids are packed as any row. A sequence's number holds
    the partition in its upper bits; a partition with rows fills all its windows but such whose length is a power of two."""
    frame = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out = library_encoder(vocabulary_path), []
        top = TaskContext.get().partitionId() << 40

        def emit(piece, sequence, offset):
            (doc_id, tokens), start, ids = piece
            out.append((doc_id, start, len(ids), zlib.crc32(ids), tokens, top + sequence, offset, ids if keep_ids else None))

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            kinds = [kind, *[pa.int64()] * 6]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
            if keep_ids:
                arrays.append(pa.array([x.tolist() for x in columns[7]], pa.list_(pa.int32())))
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        packer, kind = Packer(window, emit), pa.int64()
        for batch in by_bytes(batches, 1):
            kind = batch.schema.field(0).type
            ids, counts = encoder.encode(batch.column(1).to_pylist())
            ids = np.ascontiguousarray(np.insert(ids, np.cumsum(counts), end_id), "<u4")
            ends = np.cumsum(counts + 1).tolist()
            begin = 0
            for doc_id, end in zip(batch.column(0).to_pylist(), ends, strict=True):
                packer.add((doc_id, end - begin), ids[begin:end])
                begin = end
                if len(out) >= 20_000:
                    yield rows()
            for held in packer.at:  # pieces that stay open keep their own ids, not those of the batch
                for pieces in held:
                    pieces[:] = [(r, s, x.copy() if x.base is not None else x) for r, s, x in pieces]
        packer.finish()
        if out:
            yield rows()

    schema = T.StructType([frame.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]])
    if keep_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    return frame.mapInArrow(run, schema)
