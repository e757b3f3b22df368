"""Vector searches against all inner products."""

import numpy as np
import pytest

from logtrawl.llm import exact_top, prefix_forest, queries

from .conftest import DATA


def table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    return np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)


def all_best(ids, scores, query_ids, k):
    out = []
    for i, row in zip(query_ids.tolist(), scores, strict=True):
        best = [j for j in np.lexsort((ids, -row)).tolist() if ids[j] != i][:k]
        out += [(i, r + 1, int(ids[j]), row[j].item()) for r, j in enumerate(best)]
    return out


def test_exact_query(spark):
    ids, v = table(spark, DATA)
    whole = np.floor(256 * v).astype(np.int64)
    q = ids % 50 == 0
    assert sorted(map(tuple, queries.op2_no_random_access(spark, DATA).collect())) == sorted(all_best(ids, whole[q] @ whole.T, ids[q], 5))


@pytest.mark.parametrize("block", [16, 128, 4096])
def test_exact_in_blocks(spark, block):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 12))
    v[50:120] = v[7]  # many equal rows
    v[200:210] = 0
    docs = spark.createDataFrame([(i, [float(x) for x in row], 1) for i, row in enumerate(v)], "vec_id long, embedding array<double>, score int")
    whole = np.floor(256 * v).astype(np.int64)
    ids = np.arange(300)
    got = exact_top.exact_top(docs, k=5, every=10, block=block, query_block=7).collect()
    assert sorted(map(tuple, got)) == sorted(all_best(ids, whole[::10] @ whole.T, ids[::10], 5))


def test_recall(spark):
    sf_dir = "/root/testdata/sf0.1"
    ids, v = table(spark, sf_dir)
    q = ids % 20 == 0
    want = all_best(ids, v[q] @ v.T, ids[q], 20)
    got = queries.op5_prefix_forest(spark, sf_dir).collect()
    assert len(got) == len(want)
    pairs = {(a, b) for a, _, b, _ in want}
    assert len(pairs & {(r.query_id, r.vec_id) for r in got}) / len(pairs) >= 0.9
    place = {int(i): n for n, i in enumerate(ids)}
    for r in got[:500]:
        assert r.score == pytest.approx(float(v[place[r.query_id]] @ v[place[r.vec_id]]), abs=1e-12)


@pytest.mark.parametrize("search", [exact_top.exact_top, prefix_forest.forest_search])
def test_odd_vectors(spark, search):
    """Nulls, non-finite and empty vectors, other lengths, huge components, repeated ids, no rows."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, []), (6, [3.0]), (7, [0.0, 0.0]), (8, [1.0, 1.0, 1.0]), (8, [2.0, 2.0]), (None, [1.0, 1.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [(r.query_id, r.vec_id) for r in search(docs, k=5, every=4).collect()]
    zero = {5, 7} if search is exact_top.exact_top else set()
    assert {v for _, v in found} <= {0, 6, 8} | zero and (0, 8) in found and (0, 0) not in found and (8, 8) not in found
    assert search(docs.filter("false"), k=5, every=4).count() == 0
    huge = spark.createDataFrame([(i, [1e300 * i, -1.0]) for i in range(4)], "vec_id long, embedding array<double>")
    assert search(huge, k=2, every=2).count() == 4 if search is exact_top.exact_top else search(huge, k=2, every=2).count() > 0


def test_forest_finds_all_with_full_reach():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 8)) * rng.uniform(0.1, 3, (400, 1))
    ids = np.arange(400)
    at, found, scores = prefix_forest.block_search(ids[:40], v[:40], ids, v, 10, trees=8, reach=8.0, seed=1)
    got = sorted((int(ids[a]), int(f)) for a, f in zip(at, found, strict=True))
    assert got == sorted((a, b) for a, _, b, _ in all_best(ids, v[:40] @ v.T, ids[:40], 10))


def test_forest_returns_all_rows(spark):
    """As many rows as there are, up to k: with huge components, and for queries in clusters of exactly k rows."""
    huge = spark.createDataFrame([(i, [1e300 * i, -1.0]) for i in range(4)], "vec_id long, embedding array<double>")
    assert prefix_forest.forest_search(huge, k=2, every=2).count() == 4
    rng = np.random.default_rng(2)
    for noise in (0, 1e-9):
        v = rng.normal(size=(500, 32))
        v[40:60] = v[40] + noise * rng.normal(size=(20, 32))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        ids = np.arange(500)
        at, found, _ = prefix_forest.block_search(ids[40:60], v[40:60], ids, v, 20, trees=96, reach=0.8, seed=7)
        assert np.bincount(at).tolist() == [20] * 20
        assert all(len(set(found[at == i]) & set(range(40, 60))) == 19 for i in range(20))


@pytest.mark.parametrize("noise", [0, 1e-9])
def test_recall_beside_a_hot_cluster(noise):
    """A third of the rows (nearly) equal: queries beside them find the others no worse."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 64))
    v[2000:] = v[0] + noise * rng.normal(size=(1000, 64))
    v[1:101] = v[0] + 0.9 * v[1:101]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[2000:] *= 0.7  # so that others are among the best
    ids = np.arange(3000)
    at, found, _ = prefix_forest.block_search(ids[1:101], v[1:101], ids, v, 20, trees=96, reach=0.8, seed=7)
    want = {(a, b) for a, _, b, _ in all_best(ids, v[1:101] @ v.T, ids[1:101], 20)}
    got = {(int(a) + 1, int(f)) for a, f in zip(at, found, strict=True)}
    assert len(want & got) / len(want) >= 0.99


def moved_bytes(df):
    """Bytes that the exchanges of a query wrote when it ran."""
    df.collect()
    waiting, total = [df._jdf.queryExecution().executedPlan()], 0
    while waiting:
        node = waiting.pop()
        metrics = node.metrics()
        if node.nodeName() == "Exchange" and metrics.contains("dataSize"):
            total += metrics.apply("dataSize").value()
        if node.nodeName() == "AdaptiveSparkPlan":
            waiting.append(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            waiting.append(node.plan())
        waiting += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_exact_moves_little(spark):
    """Queries go to bounded shares of the rows, not to every block: 64 blocks here."""
    v = np.random.default_rng(4).normal(size=(4096, 16))
    docs = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for large tables
    try:
        found = exact_top.exact_top(docs, k=1, every=4, block=64, query_block=64)
        assert 0 < moved_bytes(found) < 4 * v.nbytes
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    whole = np.floor(256 * v).astype(np.int64)
    ids = np.arange(4096)
    assert sorted(map(tuple, found.collect())) == sorted(all_best(ids, whole[::4] @ whole.T, ids[::4], 1))


@pytest.mark.parametrize("share", [1, 3000, 10**8])
def test_exact_in_shares(spark, share):
    """Small and large components, other lengths, many equal rows and repeated ids over many shares."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(400, 12))
    v[60:200] = v[3]
    v[::17] *= 1e4
    v[::41] *= 1e9
    v[5::7, 8:] = 0  # left out below
    v[300] = 0
    rows = [(i, [float(x) for x in (row[:8] if i % 7 == 5 else row)]) for i, row in enumerate(v)]
    bad = [(None, [1.0]), (4, None), (8, [None, 1.0]), (12, [float("nan")]), (16, [float("-inf"), 2.0]), (20, [])]
    docs = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").repartition(5)
    # the empty vector scores zero with all; it shares the id of another row, as query and as candidate
    ids = np.append(np.arange(400), 20)
    whole = [[int(x) for x in row] for row in np.floor(256 * np.vstack([v, np.zeros((1, 12))]))]
    want = {}
    for i in range(401):
        if ids[i] % 4 == 0:
            want.setdefault(int(ids[i]), []).extend((max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[i], w, strict=True)))), int(j)) for j, w in zip(ids, whole, strict=True) if j != ids[i])
    want = [(q, r + 1, j, s) for q, x in want.items() for r, (s, j) in enumerate(sorted(x, key=lambda y: (-y[0], y[1]))[:5])]
    found = exact_top.exact_top(docs, k=5, every=4, block=32, query_block=16, share=share).collect()
    assert sorted(map(tuple, found)) == sorted(want)


def test_exact_stops_early():
    """Where a few rows stand out, queries stop before the ends of the lists; nothing is lost."""
    rng = np.random.default_rng(8)
    v = np.floor(rng.normal(size=(600, 6)) * 20)
    v[np.arange(0, 600, 30), rng.integers(0, 6, 20)] = 9000
    q = np.zeros((50, 6))
    q[np.arange(50), rng.integers(0, 6, 50)] = rng.choice([-300, 300, 7], 50)
    q[40:] = rng.normal(size=(10, 6)).round(1) * 1000
    ids, query_ids = np.arange(600), np.arange(50) * 3
    block, asked = exact_top.sorted_lists(ids, v.astype(np.int16)), exact_top.asked_rows(query_ids, q)
    assert len(block.heads) > 2
    score = (q @ v.T).astype(np.int64)
    for edge in (np.full(50, -np.inf), np.partition(score, -6, axis=1)[:, -6].astype(float)):
        best = exact_top.Best(50, 5)
        at, found, got = exact_top.block_top(asked, block, 5, edge)
        assert (got == score[at, block.ids[found]]).all() and len(at) < 50 * 600 / 4
        best.add(at, block.ids[found], got)
        for i in range(50):
            assert list(best.ids[i]) == [j for j in np.lexsort((ids, -score[i])).tolist() if j != query_ids[i]][:5]
