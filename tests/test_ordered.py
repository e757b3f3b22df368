import random

import pytest

from logtrawl import lines_of
from logtrawl.operators import analysis, ordered


@pytest.fixture
def table(spark):
    """Rows in many files and blocks, with a hot rule and gaps."""
    rng = random.Random(3)
    rows, n = [], 0
    for rank in sorted(rng.sample(range(-5, 200000), 30)):
        for pos in sorted(rng.sample(range(60), rng.randrange(1, 25))):
            n += 1
            rows.append((rank, pos, rng.choice("aaab"), rng.choice([None, n * 7 % 101, n])))
    frame = spark.createDataFrame(rows, "file_rank bigint, pos bigint, rule string, v bigint").repartition(5)
    return rows, lines_of(frame, line="rule", block_rows=8, keep=["rule", "v"])


@pytest.mark.parametrize("per_group", [1 << 16, 7])
@pytest.mark.parametrize("across", [True, False])
@pytest.mark.parametrize("by", [(), ("rule",)])
def test_against_one_pass(table, monkeypatch, per_group, across, by):
    monkeypatch.setattr(ordered, "FILES_PER_GROUP", per_group)
    rows, frame = table
    totals, lasts = {}, {}
    want_total, want_last, want_before = {}, {}, {}
    for rank, pos, rule, v in rows:
        key = (rule if by else None, None if across else rank)
        totals[key] = totals.get(key, 0) + (v or 0)
        want_total[rank, pos] = totals[key]
        if v is not None:
            want_before[rank, pos] = lasts.get(key)
            lasts[key] = v
        want_last[rank, pos] = lasts.get(key)
    got = ordered.running_total(frame, {"t": "coalesce(v, 0)"}, ["pos"], by, across)
    assert {(r.file_rank, r.pos): r.t for r in got.collect()} == want_total
    got = ordered.carry_last(frame, {"c": "v"}, ["pos"], by, across)
    assert {(r.file_rank, r.pos): r.c for r in got.collect()} == want_last
    got = ordered.previous(frame.filter("v IS NOT NULL"), "p", "v", ["pos"], by, across)
    assert {(r.file_rank, r.pos): r.p for r in got.collect()} == want_before


def test_max_count(table):
    rows, frame = table
    for n in (1, 3, 50, 10**6):
        seen, want = {}, set()
        for rank, pos, rule, _ in rows:
            seen[rule] = seen.get(rule, 0) + 1
            if seen[rule] <= n:
                want.add((rank, pos))
        got = analysis.max_count(frame, n, ["pos"], ["rule"])
        assert {(r.file_rank, r.pos) for r in got.collect()} == want
    assert analysis.max_count(frame, 0, ["pos"], ["rule"]).count() == len(rows)


def test_until(table):
    rows, frame = table
    key = "struct(file_rank, pos)"
    stops = [(rank, pos) for rank, pos, rule, _ in rows if rule == "b"]
    got = analysis.until(frame, frame.filter("rule = 'b'"), key)
    assert {(r.file_rank, r.pos) for r in got.collect()} == {r[:2] for r in rows if r[:2] <= min(stops)}
    assert analysis.until(frame, frame.filter("rule = 'c'"), key).count() == len(rows)


def test_rows_never_meet_in_one_task(spark, tmp_path):
    """Ordered operators place rows by block; only edge rows reach the windows over all files."""
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id % 3 AS file_rank", "id AS pos", "string(id) AS line", "id AS v").write.parquet(path)
    frame = lines_of(spark.read.parquet(path), block_rows=10, keep=["v"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = ordered.running_total(frame, {"t": "v"}, ["pos"])
        plan = df._jdf.queryExecution().sparkPlan().toString()
        full = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = [row.lstrip(" :+-*()0123456789") for row in full.splitlines()]
    # the only single task gets one row per group of files
    single = [n for n, row in enumerate(rows) if row.startswith("Exchange SinglePartition")]
    assert single and all(rows[n + 1].startswith("HashAggregate(keys=[_group") for n in single)
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    # the lines are moved once, by block, for the window; the join back finds them in place
    join = next(n for n, row in enumerate(rows) if row.startswith("SortMergeJoin [file_rank"))
    assert rows[join + 1].startswith("Window") and rows[join + 3].startswith("Exchange hashpartitioning(file_rank")
