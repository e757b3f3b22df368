"""Trie of the common prefixes of conversations, from padded matrices of turn ids.

A conversation becomes one row: the ids of its turns end to end (``TURN`` bytes each, a hash of role and text) and the code points of each
text. Rows are dealt to range shards by these ids and then by conversation, so a shard is a stretch of the trie in depth-first order,
and many equal conversations spread over several shards. In a shard, rows come in blocks. A block is a matrix of turn ids, padded to its
longest row, sorted by ``np.lexsort``. Where a column differs from the row before, everything to its right does too: the change masks
accumulated by OR mark in each column where a node of that depth starts, and ``reduceat`` between these starts sums each depth up, from
the deepest to the root.

Only the nodes on a block's first path as far as the row before it, and on its last path, may go on in other blocks. Of these, a
block returns sums under the hash of their path, and the members that end there as packed numbers; sums recombine by path,
members in the order of blocks. Every sum is such that parts just add up: a node counts as begun in the one block where it starts, and
as having children in the one block where its first child does, which the row before a block tells.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

TURN = 16  # bytes of the id of a turn
CELLS = 1_000_000  # turns in the matrix of one block, padding included; one row at least
EMPTY = hashlib.sha256(b"").hexdigest()
ROOT = hashlib.md5(b"").digest()
#: ``key`` is null for nodes that are whole; ``ends`` are the members that end at a node of several blocks
NODES = """shard long, block long, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long,
 begun long, branched long, saved_tokens long, ends_sha256 string, ends binary"""
NAMES = [c.split()[0] for c in NODES.split(",")]


def turn_id(role: str, text: str) -> Column:
    """``TURN`` bytes for a role and a text, null being empty: the MD5 hash of the role's length, a colon, the role and the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    return F.unhex(F.md5(F.encode(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), "UTF-8")))


def conversation_rows(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turns array<struct<turn, id, chars>>`` in order: by turn, null first, and of equal turns by the hash of role and text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    one = F.struct(F.col(turn_col).cast("long").alias("turn"), turn_id(role_col, text_col).alias("id"), F.char_length(text).alias("chars"))
    rows = turns.select(F.col(id_col).cast("long").alias("conv_id"), one.alias("one")).filter("conv_id is not null")
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("turns"))


def with_shared_heads(rows: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """The first ``h`` turns of each conversation ``c`` replaced by those of ``c - c % every``, where ``h`` is the CRC-32 of ``c`` in decimals
    modulo ``heads``; of a conversation that isn't there, none."""
    given = rows.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    rows = rows.withColumn("base", F.expr(f"conv_id - conv_id % {every}")).withColumn("h", F.expr(f"cast(crc32(cast(cast(conv_id as string) as binary)) % {heads} as int)"))
    rows = rows.join(given, "base", "left")
    return rows.select("conv_id", F.expr("concat(slice(coalesce(head, array()), 1, h), slice(turns, h + 1, size(turns)))").alias("turns"))


def _keys(path: bytes) -> list[bytes]:
    """A key of the root and of each node on a path, for all of them in one pass."""
    state, out = hashlib.md5(), [ROOT]
    for at in range(0, len(path), TURN):
        state.update(path[at : at + TURN])
        out.append(state.copy().digest())
    return out


def _matrix(paths: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Length of each path in turns, and their ids: two 64-bit columns a turn, padded with zeros."""
    length = np.fromiter(map(len, paths), np.int64, len(paths)) // TURN
    flat = np.frombuffer(b"".join(paths), ">u8").reshape(-1, 2).astype(np.uint64)
    out = np.zeros((len(paths), int(length.max()), 2), np.uint64)
    out[np.arange(out.shape[1]) < length[:, None]] = flat
    return length, out


def _sha(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


class Block:
    """Node sums of rows that are neighbours in the order of paths; ``before`` is the path of the row in front of them."""

    def __init__(self, convs: np.ndarray, paths: list[bytes], chars: list[np.ndarray], before: bytes | None):
        length, matrix = _matrix([b"" if before is None else before, *paths])
        width = matrix.shape[1]
        columns = [matrix[1:, c, half] for c in range(width) for half in (0, 1)]
        order = np.lexsort((convs, length[1:], *reversed(columns)))
        self.convs, self.paths = convs[order], [paths[i] for i in order.tolist()]
        matrix[1:], length[1:] = matrix[1:][order], length[1:][order]
        self.chars = np.zeros((len(paths), width), np.int64)
        self.chars[np.arange(width) < length[1:, None]] = np.concatenate([chars[i] for i in order.tolist()] or [np.empty(0, np.int64)])
        self.length, self.length_before = length[1:], length[:-1].copy()
        active = np.arange(width) < length[:, None]
        change = (matrix[1:] != matrix[:-1]).any(axis=2) | (active[1:] != active[:-1])
        np.logical_or.accumulate(change, axis=1, out=change)
        if before is None:  # nothing is in front
            change[0] = True
            self.length_before[0] = -1
        self.active, self.change = active[1:], change
        #: nodes up to these depths may have rows in other blocks: on the first path, and on the last
        self.open_first, self.open_last = min(int((~change[0]).sum()), int(self.length[0])), int(self.length[-1])

    def nodes(self, shard: int, block: int) -> pa.RecordBatch:
        rows, width = len(self.convs), int(self.length.max())
        first_keys, last_keys = _keys(self.paths[0]), _keys(self.paths[-1])
        begun, branched, saved = (np.zeros(rows, np.int64) for _ in range(3))  # of the nodes below, kept at their first rows
        children = np.zeros(rows, bool)
        found = []
        for depth in range(width, -1, -1):
            at = np.flatnonzero(self.active[:, depth - 1]) if depth else np.arange(rows)
            change = self.change[at, depth - 1] if depth else np.zeros(rows, bool)
            start = change.copy()
            start[0] = True
            runs = np.flatnonzero(start)
            total = lambda x: np.add.reduceat(x[at].astype(np.int64), runs)  # noqa: B023, E731
            first, real = at[runs], change[runs]
            # the first child of a node starts where the node does, or behind a row that ends at the node
            own_branch = children.copy()
            own_branch[at] &= change | (self.length_before[at] == depth)
            n, chars = np.diff(np.append(runs, len(at))), self.chars[first, depth - 1] if depth else np.zeros(1, np.int64)
            node = {"n_convs": n, "conv_id": np.minimum.reduceat(self.convs[at], runs), "n_children": total(children), "begun": total(begun), "branched": total(branched)}
            saved[first] += n * chars - real * chars
            node["saved_tokens"] = total(saved)
            found.append((depth, at, runs, first, node, total(self.length == depth)))
            begun[first] += real
            branched[first] += total(own_branch)
            children = np.zeros(rows, bool)
            children[first[real]] = True
        return self._batch(found[::-1], first_keys, last_keys, shard, block)

    def _batch(self, found, first_keys: list[bytes], last_keys: list[bytes], shard: int, block: int) -> pa.RecordBatch:
        out: dict[str, list] = {c: [] for c in NAMES}
        parents, parent_keys, of_row = np.empty(0, np.int64), [], np.zeros(len(self.convs), np.int64)
        for depth, at, runs, first, node, ends in found:
            n = len(runs)
            keys: list[bytes | None] = [None] * n
            if depth <= self.open_first:
                keys[0] = first_keys[depth]
            if depth <= self.open_last:
                keys[-1] = last_keys[depth]
            parent = of_row[first]  # which node of the depth above
            whole = np.array([k is None for k in keys])
            ended: list[bytes | None] = [None] * n
            shas: list[str | None] = [EMPTY if w else None for w in whole.tolist()]
            for i in np.flatnonzero(ends).tolist():
                ids = self.convs[first[i] : first[i] + ends[i]]
                if keys[i] is None:
                    shas[i] = _sha(ids)
                else:
                    ended[i] = ids.astype("<i8").tobytes()
            above = [parent_keys[k] for k in parent.tolist()] if depth else [None] * n
            out["shard"] += [shard] * n
            out["block"] += [block] * n
            out["key"] += keys
            out["parent_key"] += above
            out["conv_id"] += node["conv_id"].tolist()
            out["depth"] += [depth] * n
            out["parent_conv_id"] += [None] * n if not depth else [None if a is not None else p for a, p in zip(above, parents[parent].tolist(), strict=True)]
            for c in ("n_convs", "n_children", "begun", "branched", "saved_tokens"):
                out[c] += node[c].tolist()
            out["ends_sha256"] += shas
            out["ends"] += ended
            of_row[at] = np.repeat(np.arange(n), np.diff(np.append(runs, len(at))))
            parents, parent_keys = node["conv_id"], keys
        kinds = {"key": pa.binary(), "parent_key": pa.binary(), "ends": pa.binary(), "ends_sha256": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()], NAMES)


def block_nodes(rows: DataFrame) -> DataFrame:
    """``NODES`` of every block, from ``shard, conv_id, path, chars, before`` sorted within its shard; ``before`` is the last path of the shard in front."""
    cells = CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before = None, 0, None
        held: list[tuple[int, bytes, np.ndarray]] = []
        widest = 0

        def done() -> pa.RecordBatch:
            nonlocal block, before, held, widest
            made = Block(np.array([h[0] for h in held], np.int64), [h[1] for h in held], [h[2] for h in held], before)
            out = made.nodes(shard, block)
            block, before, held, widest = block + 1, held[-1][1], [], 0
            return out

        for batch in batches:
            for now, conv, path, chars, last in zip(*(batch.column(c).to_pylist() for c in ("shard", "conv_id", "path", "chars", "before")), strict=True):
                if now != shard:
                    if held:
                        yield done()
                    shard, block, before = now, 0, last
                if held and (len(held) + 1) * max(widest, len(chars)) > cells:
                    yield done()
                held.append((conv, path, np.array(chars, np.int64)))
                widest = max(widest, len(chars), 1)
        if held:
            yield done()

    return rows.select("shard", "conv_id", "path", "chars", "before").mapInArrow(run, NODES)


def _shards(rows: DataFrame) -> DataFrame:
    """``shard, conv_id, path, chars, before`` of conversations, dealt by ranges of path and id and sorted there."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flat = rows.selectExpr("conv_id", "unhex(array_join(transform(turns, t -> hex(t.id)), '')) as path", "transform(turns, t -> t.chars) as chars")
    ranged = flat.repartitionByRange(parts, "path", "conv_id").withColumn("shard", F.spark_partition_id().cast("long"))
    ranged = staged(ranged, "trie-shards")
    last = ranged.groupBy("shard").agg(F.max("path").alias("last"))  # one row a shard
    last = last.select("shard", F.lag("last").over(Window.orderBy("shard")).alias("before"))
    return ranged.join(F.broadcast(last) if parts <= 10_000 else last, "shard").repartition(parts, "shard").sortWithinPartitions("shard", "path", "conv_id")


def _ends(parts: DataFrame) -> DataFrame:
    """``key, ends_sha256``: the digests of ids that lie in several blocks, read one block after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

        for batch in batches:
            for key, ends in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if key != now:
                    if state is not None:
                        yield row()
                    now, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(",".join(map(str, np.frombuffer(ends, "<i8").tolist())).encode())
        if state is not None:
            yield row()

    parts = parts.filter("ends is not null").select("key", "shard", "block", "ends")
    return parts.repartition("key").sortWithinPartitions("key", "shard", "block").mapInArrow(run, "key binary, ends_sha256 string")


def trie_nodes(rows: DataFrame) -> DataFrame:
    """One row for each node of the trie of conversations (``conv_id, turns`` as ``conversation_rows`` gives them): ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id`` (that of the parent; root: null),
    ``n_convs``, ``n_children``, ``n_leaves`` (nodes without children in its subtree), ``saved_tokens`` (code points of last texts that
    all but one member repeat, over its subtree) and ``ends_sha256`` (of the members that end there, in ascending order, comma-joined).

    Conversations without turns are members of the root. No conversations give no nodes, not even a root. Nodes are told apart
    by 128-bit hashes of their turns. A conversation is one row, of 20 bytes a turn: this bounds its turns, not its text."""
    found = staged(block_nodes(_shards(staged(rows, "trie-rows"))), "trie-nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "begun", "branched", "saved_tokens")]
    joint = found.filter("key is not null").groupBy("key", "parent_key", "depth").agg(F.min("conv_id").alias("conv_id"), *sums)
    joint = joint.join(_ends(found), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    joint = staged(joint, "trie-joint")
    columns = ["conv_id", "depth", "n_convs", "n_children", "begun", "branched", "saved_tokens", "ends_sha256"]
    whole = found.filter("key is null")
    inner = whole.filter("parent_key is null").select(*columns, "parent_conv_id")
    outer = whole.filter("parent_key is not null").select(*columns, "parent_key").unionByName(joint.select(*columns, "parent_key"))
    outer = outer.join(joint.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")), "parent_key", "left").drop("parent_key")
    leaves = F.expr("begun - branched + if(n_children = 0, 1, 0)").alias("n_leaves")
    return inner.unionByName(outer).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", leaves, "saved_tokens", "ends_sha256")


def shared_head_trie(turns: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """``trie_nodes`` of conversations (``conv_id, turn, role, text``) whose first turns are those of every hundredth one.

    Turns are in the order of ``turn``, null first; null roles and texts are empty; rows without a ``conv_id`` take no part; rows that
    repeat a turn are turns of their own, in the order of a hash of role and text."""
    return trie_nodes(with_shared_heads(staged(conversation_rows(turns), "trie-turns"), every, heads))
