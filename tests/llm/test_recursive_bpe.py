"""Encoding by recursive queries: against the tiktoken library."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from logtrawl.llm import queries, recursive_bpe
from logtrawl.llm.common import byte_ranks_path

from .conftest import DATA


@pytest.fixture(scope="session")
def library():
    with open(byte_ranks_path(), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digests(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()


def test_ids_are_the_library_s(library, texts, monkeypatch):
    rnd = random.Random(5)
    odd = [t or "" for t in texts] + ["".join(rnd.choice("ab 's'\n\t1!é lredvm中<|") for _ in range(rnd.randrange(200))) for _ in range(1000)]
    odd += ["".join(rnd.choice("etaoinshr") for _ in range(3000)), "ab" * 700 + "a" * 701, "=" * 129, "abc" * 21 + "x", "abc" * 21 + "xy"]
    want = [library.encode_ordinary(t) for t in odd]
    ranks = recursive_bpe._ranks(byte_ranks_path())
    for some in (600_000, 5_000):  # several queries in the second
        monkeypatch.setattr(recursive_bpe, "WORD_BYTES", some)
        monkeypatch.setattr(recursive_bpe, "TOKENS", some)
        ids, counts = recursive_bpe.Encoder(ranks.words_to_ids, {}, 50).encode(odd)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
        out = [b""] * len(odd)
        for i, data in ranks.decoded(ids, counts):
            out[i] += data
        assert out == [t.encode() for t in odd]


def test_digests(spark, library, odd_docs, empty_docs, monkeypatch):
    got = recursive_bpe.round_trip_digests(odd_docs, byte_ranks_path())
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    want = sorted((key((d, *digests(library, t))) for d, t in odd_docs.select("doc_id", "text").collect()))
    assert sorted(key(tuple(r)) for r in got.collect()) == want
    assert recursive_bpe.round_trip_digests(empty_docs, byte_ranks_path()).count() == 0


def test_encode_and_decode(spark, library, odd_docs):
    coded = recursive_bpe.encode_texts(odd_docs.withColumnRenamed("doc_id", "name"), byte_ranks_path(), id_col="name")
    back = recursive_bpe.decode_ids(coded, byte_ranks_path())
    texts = lambda rows: sorted(((r[0] is not None, r[0] or 0), bytes(r[1])) for r in rows)
    assert texts(back.collect()) == texts([(r.doc_id, (r.text or "").encode()) for r in odd_docs.collect()])
    nulls = spark.createDataFrame([(1, None), (2, []), (3, [0])], "doc_id long, ids array<int>")
    assert [r.data for r in recursive_bpe.decode_ids(nulls, byte_ranks_path()).orderBy("doc_id").collect()] == [None, b"", b"!"]
    with pytest.raises(Exception, match="no rank"):
        recursive_bpe.decode_ids(spark.createDataFrame([(1, [50256])], "doc_id long, ids array<int>"), byte_ranks_path()).collect()


def test_ranks_without_single_bytes(tmp_path):
    (tmp_path / "ranks").write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError, match="single bytes"):
        recursive_bpe.Ranks(str(tmp_path / "ranks"))


def test_query(spark, library):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op13_recursive_merges(spark, DATA).collect()
    assert sorted(map(tuple, got)) == sorted((r.doc_id, *digests(library, r.text)) for r in rows)
