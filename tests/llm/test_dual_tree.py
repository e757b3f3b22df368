"""Ranked search by dual trees, against scores of every pair."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from logtrawl.llm import dual_tree, queries

from .conftest import DATA

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    """(item, rank, id, score) of every item row by scoring all documents."""
    counted = [(d, Counter(terms(t))) for d, t in docs]
    n_docs = sum(bool(c) for _, c in counted)
    total = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counted:
            if c:
                m = 75 + (25 * sum(c.values()) * n_docs) // total
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
                if score > 0:
                    found.append((-score, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return out


def key(row):
    return tuple((x is not None, x or 0) for x in row)


ITEMS = [(1, "the of and né"), (2, None), (3, ""), (4, "You, YOU, you! stupid 3.5"), (5, "中文 über_straße x"), (5, "one two two three"), (None, "the the the"), (6, "unheard-of zzzz"), (7, "w1 w2 w3 new7 w9"), (8, "." * 40)]


@pytest.mark.parametrize(("k", "block", "chunk", "group"), [(3, 4096, 512, 100_000), (2, 16, 8, 9), (20, 5, 8, 1)])
def test_search_is_that_of_all_pairs(spark, odd_docs, monkeypatch, k, block, chunk, group):
    for name, value in (("BLOCK", block), ("CHUNK", chunk), ("GROUP_TERMS", group), ("SEED", 3), ("COLUMNS", 12 if k == 2 else 8192), ("ITEM_FAN", 2), ("FAN", 3)):
        monkeypatch.setattr(dual_tree, name, value)
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    got = dual_tree.ranked_search(odd_docs, items, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = plain([(r.doc_id, r.text) for r in odd_docs.collect()], ITEMS, k)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_long_texts_and_terms(monkeypatch):
    """Texts and terms longer than a piece are looked up whole."""
    monkeypatch.setattr(dual_tree, "PIECE", 50)
    dual_tree._tables.cache_clear()
    try:
        rnd = random.Random(2)
        long = "É" * 40 + "Ab" * 30
        texts = [" ".join(rnd.choice(["ab", "Cd", "é", long, "x" * 50, "x" * 51]) for _ in range(rnd.randrange(40))) for _ in range(60)] + [long, "-" * 200 + "cd", "", "ab", "é" * 25, "." * 50 + "ab"]
        known = [t.encode() for t in (terms(long)[0], "cd", "x" * 51, "x" * 50, "ab", "é" * 25)]
        got = [[0, Counter()] for _ in texts]
        for first, n, doc, term, count in dual_tree.Terms(known).counts(pa.array(texts)):
            for i, x in enumerate(n.tolist()):
                got[first + i][0] += x
            for d, t, c in zip(doc.tolist(), term.tolist(), count.tolist(), strict=True):
                got[first + d][1][known[t]] += c
        want = [[len(terms(t)), Counter(x.encode() for x in terms(t) if x.encode() in known)] for t in texts]
        assert got == want
    finally:
        dual_tree._tables.cache_clear()


def test_empty_tables(spark, empty_docs):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert dual_tree.ranked_search(empty_docs, items).count() == 0
    docs = spark.createDataFrame([(1, "the")], "doc_id long, text string")
    assert dual_tree.ranked_search(docs, items.filter("false")).schema == dual_tree.ranked_search(docs, items).schema


def test_large_sums_are_exact():
    """Sums from 2**53 on are added as integers."""
    huge = dual_tree.Items([{0: 2**52, 1: 3}, {0: 2**52, 1: 2}], [0, 1])
    assert huge.kind is object
    best = dual_tree.Best(1, np.zeros(2, np.int64))
    dual_tree.search_block(huge, np.array([[1024, 1], [1024, 2]], np.float32), np.array([5, 6]), np.zeros(2, bool), best)
    assert best.rows[0][0].tolist() == [2**62 + 6]
    assert best.rows[1][0].tolist() == [2**62 + 4]


def test_node_pairs_are_dropped_whole():
    """Documents of separate topics: most pairs are never scored."""
    rng = np.random.default_rng(1)
    items = [{10 * (i % 8) + t: 1000 + i for t in range(10)} for i in range(64)]
    tree = dual_tree.item_trees(items, np.ones(80, np.int64))
    assert len(tree) == 1
    block = np.zeros((1024, 80), np.float32)
    for d in range(1024):
        topic = d // 128
        block[d, 10 * topic : 10 * topic + 10] = rng.integers(0, 1000, 10)
    best = dual_tree.Best(5, np.zeros(64, np.int64))
    dual_tree.search_block(tree[0], block, np.arange(1024), np.zeros(1024, bool), best)
    assert best.pairs == 64 * 1024
    assert best.scored < best.pairs // 4
    weights = np.zeros((64, 80), np.int64)
    for i, item in enumerate(items):
        weights[i, list(item)] = list(item.values())
    scores = block.astype(np.int64) @ weights.T
    for i in range(64):
        assert best.rows[i][2].tolist() == sorted(range(1024), key=lambda d: (-scores[d, i], d))[:5]


def test_query_and_its_sql(spark):
    read = lambda name, *cols: [tuple(r) for r in spark.read.parquet(f"{DATA}/{name}.parquet").select(*cols).collect()]
    want = sorted(plain(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"), 20))
    assert sorted(map(tuple, queries.op11_dual_tree(spark, DATA).collect())) == want
    sql = queries.OP11_SQL.replace("FROM documents", f"FROM '{DATA}/documents.parquet'").replace("FROM benchmark", f"FROM '{DATA}/benchmark.parquet'")
    by_item = defaultdict(list)
    for item, rank, doc, score in sorted(duckdb.sql(sql).fetchall()):
        by_item[item].append((item, rank, doc, score))
    assert sorted(x for xs in by_item.values() for x in xs) == want
