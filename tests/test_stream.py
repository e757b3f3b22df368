import os
import random

import pytest

import logtrawl as lt
from logtrawl.functions import times

PATTERNS = ["x", "yy", "never"]


@pytest.fixture
def arriving(tmp_path):
    """Three files that arrive one after the other."""
    rng = random.Random(11)
    folder = tmp_path / "in"
    folder.mkdir()
    files = []
    for f in range(3):
        lines = []
        for n in range(15):
            stamp = f"2020-01-01 00:{f:02d}:{n:02d}.5 " if rng.random() < 0.8 else ""
            lines.append(stamp + rng.choice(["x", "yyy", "x yy x", "none"]))
        files.append((folder / f"app.log-{f}", lines))
    return folder, files


def feed(query, files):
    """Let each file arrive and be worked before the next."""
    for path, lines in files:
        path.write_text("\n".join(lines) + "\n")
        query.processAllAvailable()
    query.stop()


def hits(line, pattern):
    return sum(line.startswith(pattern, i) for i in range(len(line)))


def test_search_and_counts(spark, arriving, tmp_path):
    folder, files = arriving
    found = lt.stream_search(lt.stream_lines(spark, str(folder), "app.log"), PATTERNS)
    query = found.writeStream.format("memory").queryName("found").start()
    counts = lt.stream_counts(lt.stream_lines(spark, str(folder), "app.log"), PATTERNS)
    counted = counts.writeStream.format("memory").queryName("counted").outputMode("complete").start()
    (folder / "other.log").write_text("x\n")
    feed(query, files)
    counted.processAllAvailable()
    counted.stop()
    want = {p: sum(hits(line, p) for _, lines in files for line in lines) for p in PATTERNS}
    assert {r.pattern: r.n for r in spark.table("counted").collect()} == want
    got = {r.pattern: r["count"] for r in spark.table("found").groupBy("pattern").count().collect()}
    assert got == {p: n for p, n in want.items() if n}


def collect_into(rows):
    def sink(df, batch_id):
        rows[batch_id] = df.collect()

    return sink


def test_intervals(spark, arriving, tmp_path):
    folder, files = arriving
    rows = {}
    query = lt.stream_intervals(
        lt.stream_lines(spark, str(folder)), PATTERNS, collect_into(rows), str(tmp_path / "state")
    )
    feed(query, files)
    want = {p: [] for p in PATTERNS}
    for p in PATTERNS:
        last = None
        for _, lines in files:
            for line in lines:
                if line.startswith("2020"):
                    at = times.stamp_span(line[:21])[0]
                    for _ in range(hits(line, p)):
                        if last is not None:
                            want[p].append(at - last)
                        last = at
    got = {p: [] for p in PATTERNS}
    for batch in sorted(rows):
        for r in sorted(rows[batch], key=lambda r: (r.file_rank, r.block, r.pos)):
            got[r.pattern].append(r.interval_us)
    assert {p: sorted(v) for p, v in got.items()} == {p: sorted(v) for p, v in want.items()}


def test_max_count_goes_on_after_a_restart(spark, arriving, tmp_path):
    folder, files = arriving
    rows = {}

    def start():
        return lt.stream_max_count(
            lt.stream_lines(spark, str(folder)), PATTERNS, 12, collect_into(rows), str(tmp_path / "state")
        )

    feed(start(), files[:1])
    feed(start(), files[1:])
    # what a batch wrote for itself is gone, of the states two are left
    shared = spark.conf.get("spark.checkpoint.dir")
    assert not [n for n in os.listdir(f"{shared}/logtrawl") if n.startswith("batch-")]
    assert sorted(n for n in os.listdir(tmp_path / "state" / "rules") if n.isdigit()) == ["1", "2"]
    got = {}
    for batch in rows.values():
        for r in batch:
            got.setdefault(r.pattern, []).append(r.line)
    for p in PATTERNS:
        every = [line for _, lines in files for line in lines for _ in range(hits(line, p))]
        assert sorted(got.get(p, [])) == sorted(every[:12])
