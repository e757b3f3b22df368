"""The trie of conversations, against a plain one of nested prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from logtrawl.llm import prefix_trie, queries

from .conftest import DATA

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    """Each conversation's turns after its first ones are taken from every hundredth; equal turns by their hash."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(int(c / 100) * 100, [])[:h] + turns[c][h:]
    return out


def plain_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for key, own in members.items():
        below = [k for k in members if k[: len(key)] == key]
        children = [k for k in below if len(k) == len(key) + 1]
        leaves = sum(not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in below) for k in below)
        saved = sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k)
        ends = ",".join(map(str, sorted(c for c in own if len(convs[c]) == len(key))))
        out.append((min(own), len(key), min(members[key[:-1]]) if key else None, len(own), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def odd_turns(seed=3):
    rnd = random.Random(seed)
    rows = []
    for c in range(90):
        for t in range(rnd.randrange(5)):
            rows.append((c, t, rnd.choice(["user", "bot"]), rnd.choice(["hi", "né 😀", "x" * 40])))
    for c in range(100, 190):  # a hot conversation, and one without the hundredth
        rows += [(c, t, "user", f"turn {t}") for t in range(7)]
    for c in range(305, 330):
        rows += [(c, t, None if c % 2 else "", None if t % 2 else "") for t in range(rnd.randrange(1, 9))]
    rows += [(400, None, "user", "late"), (400, 5, "user", "a"), (400, 5, "bot", "b"), (400, 5, "bot", "b"), (None, 1, "user", "x"), (401, 0, "user", None), (500, 2**40, "user", "y"), (-7, 0, "user", "z")]
    rows += [(600, t, "user", f"long {t % 3}") for t in range(300)] + [(1200, t, "user", f"long {t % 3}") for t in range(280)]
    return rows


def key(row):
    return tuple((x is not None, x) if x is None or isinstance(x, int) else (True, x) for x in row)


@pytest.mark.parametrize(("parts", "cells"), [(1, 1_000_000), (1, 8), (4, 40), (13, 1), (40, 3)])
def test_nodes_are_those_of_a_plain_trie(spark, monkeypatch, parts, cells):
    monkeypatch.setattr(prefix_trie, "CELLS", cells)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = odd_turns()
        turns = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit(1), "id": F.lit("x"), "shard": F.lit(2)})
        got = prefix_trie.shared_head_trie(turns)
        assert got.columns == COLUMNS
        assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_trie(rebuilt(rows)), key=key)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_other_names_and_no_heads(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "b", "b"), (2, 0, "u", "a"), (3, 0, "u", "a"), (3, 1, "b", "c")]
    turns = spark.createDataFrame(rows, "c int, n int, who string, said string")
    got = prefix_trie.trie_nodes(prefix_trie.conversation_rows(turns, "c", "n", "who", "said")).orderBy("depth", "conv_id").collect()
    assert [tuple(r)[:7] for r in got] == [(1, 0, None, 3, 1, 2, 2), (1, 1, 1, 3, 2, 2, 2), (1, 2, 1, 1, 0, 1, 0), (3, 2, 1, 1, 0, 1, 0)]


def test_no_conversations(spark):
    assert prefix_trie.shared_head_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie.shared_head_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0


def test_only_turnless_rebuilt_conversations(spark):
    rows = [(c, 0, "u", "t") for c in range(201, 230) if zlib.crc32(str(c).encode()) % 6]  # no 200: nothing is left of them
    got = prefix_trie.shared_head_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [tuple(r) for r in got] == plain_trie(rebuilt(rows))


def test_query_and_its_sql(spark):
    rows = spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    want = sorted(plain_trie(rebuilt([tuple(r) for r in rows])), key=key)
    assert sorted(map(tuple, queries.op12_turn_matrices(spark, DATA).collect()), key=key) == want
    sql = queries.OP12_SQL.replace("FROM conversations", f"FROM '{DATA}/conversations.parquet'")
    assert sorted(duckdb.sql(sql).fetchall(), key=key) == want
