"""Byte-level BPE encoding and decoding of texts, with the pair occurrence index of ``pair_bpe``.

A map over the partitions as they are read, without a shuffle. A null text counts as empty: no ids, empty decoded
text. Repeated rows give repeated rows; the id column may be null or of any type; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, whole_text
from .pair_bpe import pair_encoder, vocabulary


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))


def encode_texts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` of every whole text."""
    frame = _prepared(docs, id_col, text_col)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pair_encoder(vocabulary_path)
        for batch in by_bytes(batches, 1):
            ids, counts = encoder.encode(batch.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, ids.astype(np.int32))], ["doc_id", "ids"])

    return frame.mapInArrow(encode, T.StructType([frame.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode_ids(coded: DataFrame, vocabulary_path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; bytes that are no UTF-8 become U+FFFD. Null ids give a null text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(vocabulary_path)
        for batch in batches:
            texts = [None if ids is None else known.decode(np.array(ids, np.int64)).tobytes().decode(errors="replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    frame = coded.select("doc_id", "ids")
    return frame.mapInArrow(decode, T.StructType([frame.schema["doc_id"], T.StructField("text", T.StringType())]))


def round_trip_digests(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode its ids, and return digests of both: ``doc_id, n_tokens, ids_sha256`` (of the
    decimal ids joined by commas) and ``decoded_sha256`` (of the decoded text in UTF-8)."""
    frame = _prepared(docs, id_col, text_col)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, known = pair_encoder(vocabulary_path), vocabulary(vocabulary_path)
        size = len(known.bytes_of)
        shown = np.frombuffer(b"".join(b"%d," % i for i in range(size)), np.uint8)
        width = np.array([len(str(i)) + 1 for i in range(size)], np.int64)
        begin = np.cumsum(width) - width
        for batch in by_bytes(batches, 1):
            texts = batch.column(1).to_pylist()
            ids, counts = encoder.encode(texts)
            ends = np.cumsum(counts)
            decoded_sha, ids_sha = [], []
            for i, j in _runs(ends):
                part = ids[ends[i] - counts[i] : ends[j - 1]]
                stop = ends[i:j] - (ends[i] - counts[i])
                for out, pool, starts, widths, comma in ((decoded_sha, known.flat, known.starts, known.widths, 0), (ids_sha, shown, begin, width, 1)):
                    w = widths[part]
                    total = np.concatenate([[0], np.cumsum(w)])
                    view = memoryview(pool[np.repeat(starts[part] - total[:-1], w) + np.arange(total[-1])])
                    places = total[np.concatenate([[0], stop])].tolist()
                    for a, b in zip(places[:-1], places[1:], strict=True):
                        data = view[a : b - comma] if b > a else b""
                        if not comma:
                            data = _utf8(data)
                        out.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    fields = [frame.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return frame.mapInArrow(digest, T.StructType(fields))


def _utf8(data) -> bytes:
    """Decoded bytes as text and back."""
    return str(data, "utf-8", "replace").encode() if len(data) else b""


def _runs(ends: np.ndarray, ids: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Neighbouring rows of about so many ids together."""
    i = 0
    while i < len(ends):
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + ids, side="right")))
        yield i, j
        i = j
