"""Token ids in binary files: Simple-8b word-aligned coding.

A 64-bit word has a selector in its upper four bits; selector ``s`` says that the lower 60 bits hold ``COUNTS[s]``
values of ``WIDTHS[s]`` bits, the first lowest. Selector 0 is the escape: the lower bits say how many words with one
plain 64-bit value each follow.

A file is a row of frames. A frame holds whole documents: a header, their ids and token counts, the offset of each
block of ``BLOCK`` tokens in words, and the words. Every block begins with a new word, so blocks decode on their own and,
as all words of one selector are unpacked together, without a loop over values.

    frame  = magic(8) words(u64 x 6: documents, words of counts, tokens, words of tokens, blocks, 1 if an id is null)
             [valid u64 x documents] doc_id i64 x documents, counts, block offsets u64, token words, end(8)

Files are written by Spark's own text writer, one frame a line with ``END`` as the line end, so any file system
that Spark knows will do, and lost tasks leave nothing behind. ``PART_FRAMES`` frames bound a file's size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_bytes, new_folder, staged, whole_text
from .pretoken import library_encoder

# fixed values of the format
COUNTS = (0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
MAGIC = b"S8BFRAME"
END = "S8B-END\n"
BLOCK = 65_536
FRAME_TOKENS = 1_000_000
PART_FRAMES = 16
WORDS = 900_000  # pre-tokens remembered by a Python worker


def pack(values: np.ndarray) -> np.ndarray:
    """Words for unsigned 64-bit values, each word taking as many as it can."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.empty(0, np.uint64)
    small = values.astype(np.uint32) if int(values.max()) < 2**32 else values
    take, selector = np.ones(n, np.uint8), np.zeros(n, np.uint8)
    narrow = np.arange(n, dtype=np.int32)
    for s in range(len(COUNTS) - 1, 0, -1):  # from one wide value a word to many narrow ones
        count, width = COUNTS[s], WIDTHS[s]
        if small.dtype.itemsize * 8 > width:
            narrow = narrow[small[narrow] < small.dtype.type(1 << width)]
        first = narrow[: max(0, len(narrow) - count + 1)]
        first = first[narrow[count - 1 :] - first == count - 1]
        if not len(first):  # what takes more and narrower values fits nowhere either
            break
        take[first], selector[first] = count, s
    step, heads, at = take.tolist(), [], 0
    while at < n:
        heads.append(at)
        at += step[at]
    heads = np.array(heads)
    kind = selector[heads]
    words = np.empty(len(heads), np.uint64)
    for s in np.unique(kind).tolist():
        at = np.flatnonzero(kind == s)
        if s:
            word = np.full(len(at), np.uint64(s << 60))
            for i in range(COUNTS[s]):
                word |= values[heads[at] + i] << np.uint64(i * WIDTHS[s])
            words[at] = word
    if (kind == 0).any():
        return _escaped(words, kind, values[heads])
    return words


def _escaped(words: np.ndarray, kind: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Puts an escape word before each run of plain values."""
    plain = kind == 0
    words = np.where(plain, values, words)
    first = np.flatnonzero(plain & ~np.concatenate([[False], plain[:-1]]))
    last = np.flatnonzero(plain & ~np.concatenate([plain[1:], [False]]))
    return np.insert(words, first, (last - first + 1).astype(np.uint64))


def unpack(words: np.ndarray) -> np.ndarray:
    """The values of words."""
    words = np.ascontiguousarray(words, np.uint64)
    kind = (words >> np.uint64(60)).astype(np.int64)
    count = np.array(COUNTS + (0,), np.int64)[kind]
    plain = np.zeros(len(words), bool)
    if (kind == 0).any():  # what follows an escape may look like anything
        count[kind == 0] = 0
        at = 0
        for e in np.flatnonzero(kind == 0).tolist():
            if e >= at:
                at = e + 1 + int(words[e])
                plain[e + 1 : at] = True
        kind[plain], count[plain] = 0, 1
    start = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.uint64)
    for s in np.unique(kind).tolist():
        if s:
            at = np.flatnonzero(kind == s)
            mask = np.uint64((1 << WIDTHS[s]) - 1)
            for i in range(COUNTS[s]):
                out[start[at] + i] = (words[at] >> np.uint64(i * WIDTHS[s])) & mask
    out[start[plain]] = words[plain]
    return out


def frame_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One frame of whole documents, without its end mark."""
    blocks = [pack(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)])[:-1].astype(np.uint64)
    coded = pack(counts)
    valid = np.array([d is not None for d in doc_ids], np.uint64)
    numbers = np.array([d or 0 for d in doc_ids], np.int64)
    nulls = int(len(valid) and not valid.all())
    head = np.array([len(numbers), len(coded), len(ids), sum(map(len, blocks)), len(blocks), nulls], np.uint64)
    parts = [head, *([valid] if nulls else []), numbers, coded, offsets, *blocks]
    return MAGIC + b"".join(p.astype("<u8" if p.dtype == np.uint64 else "<i8").tobytes() for p in parts)


def read_frames(content: bytes) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Document ids, token counts and ids of each frame of a file."""
    at = 0
    while at < len(content):
        if content[at : at + 8] != MAGIC:
            raise ValueError("not a frame")
        head = np.frombuffer(content, "<u8", 6, at + 8).tolist()
        docs, coded, tokens, words, blocks, nulls = head
        at += 56

        def take(n: int, kind: str = "<u8") -> np.ndarray:
            nonlocal at
            at += 8 * n
            return np.frombuffer(content, kind, n, at - 8 * n)

        valid = take(docs) if nulls else np.ones(docs)
        numbers = [d if v else None for d, v in zip(take(docs, "<i8").tolist(), valid.tolist(), strict=True)]
        counts = unpack(take(coded)).astype(np.int64)
        cuts = [*take(blocks).tolist(), words]
        body = take(words)
        ids = np.concatenate([unpack(body[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)] or [np.empty(0, np.uint64)]).astype(np.uint32)
        if len(ids) != tokens or content[at : at + len(END)] != END.encode():
            raise ValueError("a damaged frame")
        at += len(END)
        yield numbers, counts, ids


def write_ids(docs: DataFrame, folder: str, vocabulary_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id``, and write files in ascending order of the id column.

    A null text is empty (its only id is ``end_id``); null ids come first; rows with one id are all kept."""
    spark = docs.sparkSession
    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frame = frame.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(vocabulary_path, WORDS)
        for batch in by_bytes(batches, 1):
            ids, counts = encoder.encode(batch.column(1).to_pylist())
            ids = np.insert(ids, np.cumsum(counts), end_id)
            counts = counts + 1
            ends = np.cumsum(counts)
            doc_ids = batch.column(0).to_pylist()
            i = 0
            while i < len(counts):
                base = int(ends[i] - counts[i])
                j = max(i + 1, int(np.searchsorted(ends, base + FRAME_TOKENS, side="right")))
                yield pa.RecordBatch.from_arrays([pa.array([frame_bytes(doc_ids[i:j], counts[i:j], ids[base : ends[j - 1]])], pa.binary())], ["frame"])
                i = j

    frames = frame.mapInArrow(code, "frame binary")
    # the cast keeps the bytes; the writer adds END after each frame
    frames.select(F.col("frame").cast("string")).write.option("lineSep", END).option("maxRecordsPerFile", PART_FRAMES).text(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``part, sub`` (the file's place in the order), ``doc_id, local`` (tokens before it in the file), ``n_tokens,
    ids_crc32`` of every document in the files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part, sub = map(int, re.search(r"part-(\d+)-.*-c(\d+)\.txt$", path).groups())
                local = 0
                for doc_ids, counts, ids in read_frames(content.as_py()):
                    ends = np.cumsum(counts)
                    data = memoryview(ids.astype("<u4")).cast("B")
                    crc = [zlib.crc32(data[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                    n = len(counts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * n, pa.int32()), pa.array([sub] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(local + ends - counts), pa.array(counts), pa.array(crc, pa.int64())],
                        ["part", "sub", "doc_id", "local", "n_tokens", "ids_crc32"],
                    )
                    local += int(ends[-1]) if n else 0

    return files.mapInArrow(decode, "part int, sub int, doc_id long, local long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files to the shared folder, read them back, and return ``doc_id, start, n_tokens, ids_crc32``.

    The global start of a document is its place in its file plus the sizes of the files before; only one row a file
    meets in one task for that."""
    spark = docs.sparkSession
    folder = new_folder(spark, "ids")
    write_ids(docs, folder, vocabulary_path, end_id, id_col, text_col)
    rows = staged(read_ids(spark, folder), "ids-read")
    files = rows.groupBy("part", "sub").agg(F.sum("n_tokens").alias("tokens"))
    before = F.sum("tokens").over(Window.orderBy("part", "sub").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("part", "sub", F.coalesce(before, F.lit(0)).alias("base"))
    return rows.join(files, ["part", "sub"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
