"""Token files, encoding and decoding, packing: against the tokenizers library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from logtrawl.llm import packing, queries, simple8b, token_text
from logtrawl.llm.common import byte_bpe_path, new_folder
from logtrawl.llm.pair_bpe import pair_encoder
from logtrawl.llm.pretoken import Encoder, library_encoder

from .conftest import DATA


@pytest.fixture(scope="session")
def tokenizer():
    return Tokenizer.from_file(byte_bpe_path())


def plain_ids(tokenizer, texts):
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("make", [library_encoder, pair_encoder])
def test_ids_are_the_library_s(tokenizer, texts, make, monkeypatch):
    rnd = random.Random(4)
    odd = [t or "" for t in texts] + ["".join(rnd.choice("ab 's'\n\t1!é lredvm中<|") for _ in range(rnd.randrange(50))) for _ in range(2000)]
    want = plain_ids(tokenizer, odd)
    known = make(byte_bpe_path())
    for chunk in (1_000_000, 3_000):  # long texts are cut in the second
        monkeypatch.setattr("logtrawl.llm.pretoken.CHUNK", chunk)
        monkeypatch.setattr("logtrawl.llm.pretoken.TOGETHER", chunk * 4)
        ids, counts = Encoder(known.words_to_ids, known.special, words=50).encode(odd)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for i in range(200):
        values = rng.integers(0, 2 ** int(rng.integers(1, 63)), rng.integers(0, 300), dtype=np.uint64)
        if i % 3 == 0 and len(values):  # escapes
            values[rng.integers(0, len(values), 5)] = rng.integers(2**61, 2**63, 5, dtype=np.uint64) * np.uint64(2)
        assert (simple8b.unpack(simple8b.pack(values)) == values).all()
    assert len(simple8b.pack(np.zeros(60, np.uint64))) == 1


def test_damaged_frames_raise():
    frame = simple8b.frame_bytes([1, None], np.array([1, 2]), np.array([5, 6, 7], np.uint32)) + simple8b.END.encode()
    assert [(d, c.tolist(), i.tolist()) for d, c, i in simple8b.read_frames(frame)] == [([1, None], [1, 2], [5, 6, 7])]
    with pytest.raises(ValueError):
        list(simple8b.read_frames(frame[8:]))


def test_token_files(spark, tokenizer, odd_docs, empty_docs, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    got = simple8b.token_files(odd_docs, byte_bpe_path(), end_id=2).orderBy("start").collect()
    ids = [i + [2] for i in plain_ids(tokenizer, [t for _, t in rows])]
    want = sorted(((d is not None, d or 0), len(i), crc(i)) for (d, _), i in zip(rows, ids, strict=True))
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.doc_id is not None and r.doc_id for r in got] == sorted(r.doc_id is not None and r.doc_id for r in got)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    assert simple8b.token_files(empty_docs, byte_bpe_path(), end_id=2).count() == 0


def test_files_hold_the_ids(spark, tokenizer):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    folder = new_folder(spark, "files")
    simple8b.write_ids(docs, folder, byte_bpe_path(), 2)
    found = {}
    for row in spark.read.format("binaryFile").load(f"{folder}/part-*").collect():
        for doc_ids, counts, ids in simple8b.read_frames(bytes(row.content)):
            found |= dict(zip(doc_ids, (x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])), strict=True))
    rows = docs.collect()
    assert found == {r.doc_id: i + [2] for r, i in zip(rows, plain_ids(tokenizer, [r.text for r in rows]), strict=True)}


def digests(tokenizer, rows):
    for (doc_id, _), ids in zip(rows, plain_ids(tokenizer, [t for _, t in rows]), strict=True):
        text = tokenizer.decode(ids, skip_special_tokens=False)
        yield doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_digests(spark, tokenizer, odd_docs, empty_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    got = token_text.round_trip_digests(odd_docs, byte_bpe_path()).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, digests(tokenizer, rows)))
    assert token_text.round_trip_digests(empty_docs, byte_bpe_path()).count() == 0
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op9_pair_index(spark, DATA).collect())) == sorted(digests(tokenizer, rows))


def test_encode_then_decode(odd_docs):
    coded = token_text.encode_texts(odd_docs, byte_bpe_path())
    back = token_text.decode_ids(coded, byte_bpe_path())
    assert sorted(r.text for r in back.collect()) == sorted(r.text or "" for r in odd_docs.collect())


def check_packing(tokenizer, rows, pieces, window):
    """Every id in one piece, sequences without gaps, no padding but below powers of two."""
    held, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        held[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    for (doc_id, _), ids in zip(rows, plain_ids(tokenizer, [t for _, t in rows]), strict=True):
        ids, at = ids + [0], 0
        for p in sorted(held[doc_id], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), crc(ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == window or at < window and at & (at - 1) == 0


def test_packing(spark, tokenizer, texts, empty_docs):
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for window in (1024, 100):
        check_packing(tokenizer, rows, packing.pack_documents(docs, byte_bpe_path(), 0, window).collect(), window)
    assert packing.pack_documents(empty_docs, byte_bpe_path(), 0).count() == 0
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    check_packing(tokenizer, rows, queries.op7_sum_of_squares(spark, DATA).collect(), 1024)


def test_null_and_repeated_ids_are_packed(odd_docs):
    pieces = packing.pack_documents(odd_docs, byte_bpe_path(), 0, keep_ids=True).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in odd_docs.select("doc_id").collect()}
    assert all(len(p.ids) == p.length and crc(p.ids) == p.ids_crc32 for p in pieces)


@pytest.mark.parametrize("most", [3, 4096])
def test_sum_of_squares(most):
    """The level chosen leaves the smallest sum of squares; few open windows are enough."""
    rng, out = np.random.default_rng(2), []
    packer = packing.Packer(50, lambda p, s, o: out.append((p[0], p[1], len(p[2]), s, o)), most)
    total = 0
    for row in range(400):
        ids = np.arange(int(rng.integers(0, 130)), dtype=np.uint32)
        before = packer.level.copy()
        packer.add(row, ids)
        total += len(ids)
        size = len(ids) % 50
        if size and most > 400:
            options = []
            for fill in [0, *np.flatnonzero(before[: 50 - size + 1]).tolist()]:
                level = before.copy()
                level[fill] -= fill > 0
                level[fill + size] += fill + size < 50
                options.append(int((level[1:50] ** 2).sum()))
            assert int((packer.level[1:50] ** 2).sum()) == min(options)
    packer.finish()
    assert sum(n for _, _, n, _, _ in out) == total
    fills = defaultdict(int)
    for _, _, n, s, _ in out:
        fills[s] += n
    assert all(f == 50 or f & (f - 1) == 0 for f in fills.values()) and total % 50 == sum(f for f in fills.values() if f != 50)


