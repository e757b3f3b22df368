"""Byte-level BPE encoding and decoding by recursive queries, from a file of ranks.

Each Python worker holds the ranks in DuckDB tables in memory: ``merges`` (which pair of ids makes which) and ``vocabulary`` (the
bytes of each id). The distinct pre-tokens of a slice of a partition become rows ``place, word, id``, one for each byte. A
recursive query joins neighbouring rows with the merges and contracts in every word its leftmost pair of the lowest rank,
until no word has such a pair. Decoding joins ids with their bytes and puts these together by an ordered aggregation.

Words beyond ``SHORT`` bytes take a second query, in which a step contracts all places of a word's lowest pair, from the left,
without those that overlap one taken already. That is what repeating the leftmost one comes to, as a contraction makes pairs of later rank only.
It ends after ``STEPS`` steps and goes on from its last rows, so that a long word never piles up more than that.

A map over the partitions as they are read, without a shuffle; DuckDB runs in one thread and writes no files. A null text counts as
empty: no ids, no bytes. Repeated rows give repeated rows; the id column may be null or of any type; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, whole_text
from .pretoken import Encoder

SHORT = 64
STEPS = 32
WORD_BYTES = 600_000  # of words in one query
TOKENS = 500_000  # ids decoded in one query
WORDS = 1_000_000  # remembered by a Python worker
MEMORY = "700MB"

#: rows of words that still have a pair go on, those of the others are done; the pair is told by rank and place in one number
LEFTMOST = """WITH RECURSIVE step(place, word, id, done) AS (
  SELECT place, word, id, false FROM start
  UNION ALL
  (WITH paired AS (
     SELECT place, word, id, lead(place) OVER w AS right_place, lead(id) OVER w AS right_id, lead(word) OVER w AS right_word
     FROM step WHERE NOT done WINDOW w AS (ORDER BY place)),
   best AS (
     SELECT word, min(made * 4294967296 + place) AS best, arg_min(right_place, made * 4294967296 + place) AS gone
     FROM paired JOIN merges ON merges.left_id = id AND merges.right_id = paired.right_id WHERE word = right_word GROUP BY word)
   SELECT place, word, CASE WHEN place = best % 4294967296 THEN (best // 4294967296)::INT ELSE id END, best IS NULL
   FROM step LEFT JOIN best USING (word) WHERE NOT done AND place IS DISTINCT FROM gone))
SELECT place, word, id, done FROM step WHERE done ORDER BY place"""

#: of hits that overlap, which only those of a pair of equal ids can, every other one is taken
ALL_PLACES = f"""WITH RECURSIVE step(place, word, id, turn, done) AS (
  SELECT place, word, id, 0, false FROM start
  UNION ALL
  (WITH paired AS (
     SELECT place, word, id, lead(place) OVER w AS right_place, lead(id) OVER w AS right_id, lead(word) OVER w AS right_word
     FROM step WHERE NOT done AND turn < {STEPS} WINDOW w AS (ORDER BY place)),
   ranked AS (
     SELECT place, word, right_place, made
     FROM paired JOIN merges ON merges.left_id = id AND merges.right_id = paired.right_id WHERE word = right_word),
   lowest AS (SELECT word, min(made) AS made FROM ranked GROUP BY word),
   hits AS (
     SELECT place, right_place, word, made, row_number() OVER (PARTITION BY word ORDER BY place) AS nth
     FROM ranked JOIN lowest USING (word, made)),
   taken AS (
     SELECT place, right_place, made FROM hits
     QUALIFY row_number() OVER (PARTITION BY word, place - nth * (right_place - place) ORDER BY place) % 2 = 1),
   changes AS (SELECT place, made FROM taken UNION ALL SELECT right_place, -1 FROM taken)
   SELECT place, word, coalesce(changes.made, id)::INT, turn + 1, lowest.word IS NULL
   FROM step LEFT JOIN lowest USING (word) LEFT JOIN changes USING (place)
   WHERE NOT done AND turn < {STEPS} AND changes.made IS DISTINCT FROM -1))
SELECT place, word, id, done FROM step WHERE done OR turn = {STEPS} ORDER BY place"""

DECODE = "SELECT doc, unhex(string_agg(shown, '' ORDER BY place)) AS data FROM coded JOIN vocabulary USING (id) GROUP BY doc ORDER BY doc"


class Ranks:
    """A file of ranks (a token in base64 and its rank a line; the rank is the id) and its tables."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.rank = {base64.b64decode(token): int(number) for token, number in map(bytes.split, file)}
        missing = [b for b in range(256) if bytes([b]) not in self.rank]
        if missing:
            raise ValueError(f"the ranks lack single bytes: {missing[:5]}")
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.rank.get(token[:i], -1), self.rank.get(token[i:], -1), made) for token, made in self.rank.items() for i in range(1, len(token))]
        pairs = np.array([p for p in pairs if p[0] >= 0 and p[1] >= 0], np.int64).reshape(-1, 3)
        self.duck = duckdb.connect(":memory:", config={"threads": "1", "memory_limit": MEMORY, "temp_directory": ""})
        self._keep("merges", pa.table({"left_id": pairs[:, 0].astype(np.int32), "right_id": pairs[:, 1].astype(np.int32), "made": pairs[:, 2]}))
        self._keep("vocabulary", pa.table({"id": pa.array(list(self.rank.values()), pa.int32()), "shown": [token.hex() for token in self.rank]}))

    def _keep(self, name: str, rows: pa.Table) -> None:
        self.duck.register("given", rows)
        self.duck.execute(f"CREATE TABLE {name} AS FROM given")
        self.duck.unregister("given")

    def _query(self, name: str, rows: pa.Table, query: str) -> pa.Table:
        self.duck.register(name, rows)
        found = self.duck.sql(query).to_arrow_table()
        self.duck.unregister(name)
        return found

    def _contracted(self, words: list[bytes], query: str) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers and ids, in order, of the words after all contractions."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        rows = pa.table({"place": np.arange(len(ids)), "word": np.repeat(np.arange(len(words), dtype=np.int32), length), "id": ids})
        done = []
        while rows.num_rows:
            found = self._query("start", rows, query)
            done.append(found.filter(found["done"]))
            over = done[-1].num_rows == found.num_rows
            rows = found.slice(0, 0) if over else found.filter(pa.compute.invert(found["done"])).select(["place", "word", "id"])
        out = done[0] if len(done) == 1 else pa.concat_tables(done).sort_by("place")
        return out["word"].to_numpy(), out["id"].to_numpy()

    def words_to_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each has."""
        raw = [w.encode() for w in words]
        known = np.array([self.rank.get(w, -1) for w in raw], np.int64)  # a word that is a token is that token
        count = np.ones(len(raw), np.int64)
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        parts = []
        for long, query in ((False, LEFTMOST), (True, ALL_PLACES)):
            left = np.flatnonzero((known < 0) & ((length > SHORT) == long))
            ends = np.cumsum(length[left])
            i = 0
            while i < len(left):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + WORD_BYTES, side="right")))
                own = left[i:j]
                word, ids = self._contracted([raw[w] for w in own.tolist()], query)
                count[own] = np.bincount(word, minlength=len(own))
                parts.append((own[word], ids))
                i = j
        whole = np.flatnonzero(known >= 0)
        owner = np.concatenate([whole, *(p[0] for p in parts)])
        ids = np.concatenate([known[whole], *(p[1] for p in parts)]).astype(np.uint32)
        return ids[np.argsort(owner, kind="stable")], count

    def decoded(self, ids: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """``(text number, bytes)`` in order, from the ids of texts end to end; a long text comes in several parts."""
        doc = np.repeat(np.arange(len(counts)), counts)
        for at in range(0, len(ids), TOKENS):
            part = ids[at : at + TOKENS].astype(np.int32)
            found = self._query("coded", pa.table({"doc": doc[at : at + TOKENS], "place": np.arange(len(part), dtype=np.int32), "id": part}), DECODE)
            yield from zip(found["doc"].to_pylist(), found["data"].to_pylist(), strict=True)


@cache
def _ranks(path: str) -> Ranks:
    return Ranks(path)


@cache
def _encoder(path: str) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(_ranks(path).words_to_ids, {}, WORDS)


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))


def encode_texts(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` of every whole text."""
    frame = _prepared(docs, id_col, text_col)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            ids, counts = _encoder(ranks_path).encode(batch.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, ids.astype(np.int32))], ["doc_id", "ids"])

    return frame.mapInArrow(encode, T.StructType([frame.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode_ids(coded: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id, data binary`` from ``doc_id, ids``: the bytes of the ids. Null ids give null, an id without a rank an error."""
    frame = coded.select("doc_id", "ids")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _ranks(ranks_path)
        known = np.fromiter(ranks.rank.values(), np.int64)
        for batch in batches:
            rows = batch.column(1).to_pylist()
            counts = np.array([len(r or ()) for r in rows], np.int64)
            ids = np.array([i for r in rows for i in r or ()], np.int64)
            if not np.isin(ids, known).all():
                raise ValueError("an id that has no rank")
            out = [None if r is None else b"" for r in rows]
            for i, data in ranks.decoded(ids, counts):
                out[i] += data
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "data"])

    return frame.mapInArrow(decode, T.StructType([frame.schema["doc_id"], T.StructField("data", T.BinaryType())]))


def round_trip_digests(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode its ids, and return digests of both: ``doc_id, n_tokens, ids_sha256`` (of the decimal
    ids joined by one space) and ``decoded_sha256`` (of the decoded bytes)."""
    frame = _prepared(docs, id_col, text_col)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ranks = _encoder(ranks_path), _ranks(ranks_path)
        number = [b"%d " % i for i in range(max(ranks.rank.values()) + 1)]
        for batch in by_bytes(batches, 1):
            ids, counts = encoder.encode(batch.column(1).to_pylist())
            numbers, texts = [hashlib.sha256() for _ in counts], [hashlib.sha256() for _ in counts]
            ends = np.cumsum(counts).tolist()
            for i, (end, n) in enumerate(zip(ends, counts.tolist(), strict=True)):
                for at in range(end - n, end, TOKENS):
                    shown = b"".join(map(number.__getitem__, ids[at : min(end, at + TOKENS)].tolist()))
                    numbers[i].update(shown[:-1] if at + TOKENS >= end else shown)
            for i, data in ranks.decoded(ids, counts):
                texts[i].update(data)
            shas = [pa.array([h.hexdigest() for h in x], pa.string()) for x in (numbers, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), *shas], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    fields = [frame.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return frame.mapInArrow(digest, T.StructType(fields))
