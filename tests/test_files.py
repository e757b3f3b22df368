import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

import logtrawl as lt
from logtrawl.functions import times
from logtrawl.operators import select
from logtrawl.sources import catalog as cat_module

DAY = 86400


def write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    data = data if isinstance(data, bytes) else data.encode()
    with (gzip.open if str(path).endswith(".gz") else open)(path, "wb") as out:
        out.write(data)


@pytest.fixture
def logs(tmp_path):
    """A live file, rotated files (compressed and not), a look-alike and another family."""
    root = tmp_path / "a-1" / "logs"
    day = 1600300800  # 2020-09-17 00:00:00 UTC
    write(root / "app.log", "2020-09-19 00:00:01.000000 live one\nsecond\n")
    write(root / "old" / f"app.log-20200916-{day}.gz", "2020-09-16 08:00:00.000000 first\n  more\n2020-09-16 09:00:00 b\n")
    write(root / "old" / f"app.log-20200917-{day + DAY}", "2020-09-17 10:00:00.500000 x\r\nlone\rcr\n2020-09-17 11:00:00 y")
    write(root / "old" / f"app.log-20200918-{day + 2 * DAY}.gz", "no stamp\n2020-09-18 12:00:00 z é\n")
    write(root / "other.log", "2020-01-01 00:00:00 no\n")
    write(root / "my-app.log", "2020-01-01 00:00:00 no\n")
    return str(root)


NOW = times.stamp_span("2020-09-20 00:00:00")[0]


def names(df):
    return [os.path.basename(r.path) for r in df.orderBy("file_rank").collect()]


ALL = ["app.log-20200916-1600300800.gz", "app.log-20200917-1600387200", "app.log-20200918-1600473600.gz", "app.log"]


def test_catalog(spark, logs):
    files = lt.catalog(spark, logs, "app.log", NOW)
    assert names(files) == ALL
    rows = files.orderBy("file_rank").collect()
    assert [r.is_live for r in rows] == [False, False, False, True]
    assert [r.is_gz for r in rows] == [True, False, True, False]
    firsts = [r.us for r in files.selectExpr("file_rank", "unix_micros(first_ts) AS us").orderBy("file_rank").collect()]
    stamps = ["2020-09-16 08:00:00", "2020-09-17 10:00:00.5", None, "2020-09-19 00:00:01"]
    assert firsts == [s and times.stamp_span(s)[0] for s in stamps]
    assert rows[3].size_bytes == os.path.getsize(f"{logs}/app.log")
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_special_characters_in_a_name(spark, tmp_path):
    for name in ("a[1].log", "a*.log", "ab.log", "a1.log"):
        write(tmp_path / "l" / name, "x\n")
    assert names(lt.catalog(spark, str(tmp_path / "l"), "a[1]", NOW)) == ["a[1].log"]
    assert names(lt.catalog(spark, str(tmp_path / "l"), "a*", NOW)) == ["a*.log"]


def test_rotation_times(spark):
    paths = ["/a-1/app.log", "/x/app.log-20200916-1600317601.gz", "app.log-20200916-1600317601", "/x/app.log-20200916.gz"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    rows = rows.selectExpr("path", f"unix_micros({cat_module.rotate_ts('path')}) AS us")
    got = {r.path: r.us for r in rows.collect()}
    assert got[paths[0]] is None
    assert got[paths[1]] == got[paths[2]] == times.stamp_span("2020-09-17 04:40:01")[0]


def test_same_rotation_second_keeps_both(spark):
    rows = [("/l/b.log-20200916-1600317601", 1), ("/l/a.log-20200916-1600317601", 2)]
    files = cat_module.describe(spark.createDataFrame(rows, "path string, size_bytes bigint"), "x", NOW, first_lines=False)
    assert names(files) == ["a.log-20200916-1600317601", "b.log-20200916-1600317601"]


def test_choose_files(spark, logs):
    files = lt.catalog(spark, logs, "app.log", NOW)
    assert names(lt.choose_files(files, now=NOW)) == ALL[::-1]
    # a file without a first timestamp cannot be ruled out
    assert names(lt.choose_files(files, before="2020-09-17 12:00:00", now=NOW)) == ALL[1::-1]
    assert names(lt.choose_files(files, after="2020-09-17 12:00:00", now=NOW)) == ALL[1:]
    assert names(lt.choose_files(files, after="1:days", now=NOW)) == ALL[3:]
    assert names(lt.choose_files(files, before="9:weeks", now=NOW)) == []
    assert names(lt.choose_files(files, after="2030-01-01", now=NOW)) == []
    with pytest.raises(ValueError):
        lt.choose_files(files, before="1:days", after="2:days")


def test_listing(spark, logs):
    files = lt.catalog(spark, logs, "app.log", NOW)
    assert names(lt.list_logs(files)) == ALL
    # the third file begins without a timestamp, so only its end can exclude it
    assert names(lt.list_logs(files, at="2020-09-17 12:00:00")) == ALL[1:3]
    assert names(lt.list_logs(files, at="2020-09-19 12:00:00")) == ALL[3:]
    assert names(lt.list_logs(files, at="2020-09-18")) == ALL[1:3]
    assert names(lt.list_logs(files, start="2020-09-16 09:00:00", end="24:00:00")) == [ALL[0], ALL[2]]
    assert names(lt.list_logs(files, start="2020-09-18 09:00:00", end="2020-09-19 06:00:00")) == ALL[2:]
    total = lt.list_summary(files).first()
    assert total.files == 4 and (total.days, total.hours) == (3, 16) and total.unit == "MB"
    assert total.est_bytes == 20 * sum(os.path.getsize(f"{logs}/old/{n}") for n in ALL if n.endswith(".gz"))


def read(spark, files, **kw):
    lines = lt.with_positions(lt.read_logs(spark, files), **kw)
    return lines.orderBy("file_rank", "lineno").collect()


def test_lines(spark, logs):
    rows = read(spark, lt.catalog(spark, logs, "app.log", NOW), offset=True)
    texts = [
        ["2020-09-16 08:00:00.000000 first", "  more", "2020-09-16 09:00:00 b"],
        ["2020-09-17 10:00:00.500000 x\r", "lone\rcr", "2020-09-17 11:00:00 y"],
        ["no stamp", "2020-09-18 12:00:00 z é"],
        ["2020-09-19 00:00:01.000000 live one", "second"],
    ]
    want = []
    for rank, lines in enumerate(texts):
        at = 0
        for n, line in enumerate(lines):
            want.append((rank, n, at, line))
            at += len(line.encode()) + 1
    assert [(r.file_rank, r.lineno, r.line_offset, r.line) for r in rows] == want


def test_joined_gzip_members_and_paths(spark, tmp_path):
    path = tmp_path / "two.gz"
    path.write_bytes(gzip.compress(b"a\nb\n") + gzip.compress(b"c\n"))
    plain = tmp_path / "with space+100%é.log"
    plain.write_text("d\n")
    rows = read(spark, [str(plain), str(path)])
    assert [(r.file_rank, r.lineno, r.line) for r in rows] == [(0, 0, "d"), (1, 0, "a"), (1, 1, "b"), (1, 2, "c")]
    files = lt.catalog(spark, str(tmp_path), "with space", NOW)
    assert [r.line for r in read(spark, files)] == ["d"]
    assert lt.read_logs(spark, []).count() == 0


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_positions_over_many_blocks(spark, tmp_path, small_splits):
    rng = random.Random(5)
    paths, want = [], []
    for rank in range(3):
        lines = ["".join(rng.choice("abé ") for _ in range(rng.randrange(60))) for _ in range(rng.randrange(40, 90))]
        path = tmp_path / f"f{rank}{'.gz' if rank == 1 else ''}"
        write(path, "\n".join(lines) + "\n" * (rank != 2))
        paths.append(str(path))
        at = 0
        for n, line in enumerate(lines if lines[-1] or rank != 2 else lines[:-1]):
            want.append((rank, n, at, line))
            at += len(line.encode()) + 1
    lines = lt.read_logs(spark, paths)
    assert lines.select("file_rank", "block").distinct().count() > 8
    rows = read(spark, paths, offset=True)
    assert [(r.file_rank, r.lineno, r.line_offset, r.line) for r in rows] == want


def test_time_range_over_block_edges(spark, tmp_path, small_splits):
    texts = ["  head without a stamp"]
    for n in range(60):
        texts.append(f"2020-09-17 10:{n:02d}:00 event {n}")
        texts += [f"    frame {n}.{i} " + "x" * 40 for i in range(n % 4)]
    path = tmp_path / "big.log"
    write(path, "\n".join(texts) + "\n")
    lines = lt.read_logs(spark, [str(path)])
    start, end = times.stamp_span("2020-09-17 10:07:00")[0], times.stamp_span("2020-09-17 10:23:00")[0]
    got = [r.line for r in lt.time_range(lines, start, end).orderBy("block", "pos").collect()]
    assert got == texts[texts.index("2020-09-17 10:07:00 event 7"): texts.index("2020-09-17 10:24:00 event 24")]
    got = [r.line for r in lt.time_range(lines, start=end).orderBy("block", "pos").collect()]
    assert got == texts[texts.index("2020-09-17 10:23:00 event 23"):]
    got = [r.line for r in lt.time_range(lines, end=start).orderBy("block", "pos").collect()]
    assert got == texts[1 : texts.index("2020-09-17 10:08:00 event 8")]
    with pytest.raises(ValueError):
        lt.time_range(lines, start, start)


def test_time_range_like_one_reader(spark, lines):
    """Blocks inside, outside and across the ends, times that go back, heads without a time, open ends."""
    rng = random.Random(8)
    for turn in range(6):
        files = {
            rank: [
                (f"2020-09-17 10:{rng.randrange(30) if turn % 2 else rank * 20 + n:02d}:00 " if rng.random() < 0.6 else "") + f"{rank}.{n}"
                for n in range(rng.randrange(1, 20))
            ]
            for rank in range(3)
        }
        start, end = (times.stamp_span(f"2020-09-17 10:{m:02d}:00")[0] for m in (5, 24))
        for low, high in ((start, end), (start, None), (None, end), (None, None)):
            want, at = [], None
            for rank in files:
                for line in files[rank]:
                    at = times.stamp_span(line[:19])[0] if line.startswith("2020") else at
                    if at is not None and (low is None or at >= low) and (high is None or at <= high):
                        want.append(line)
            got = lt.time_range(lines(files, block_rows=rng.choice([2, 3, 50])), low, high)
            assert [r.line for r in got.orderBy("file_rank", "pos").collect()] == want


def test_blocks_inside_a_range_stay_where_they_are(spark, lines):
    table = lines({0: [f"2020-09-17 10:{n:02d}:00 x" for n in range(40)]}, block_rows=5)
    at = lambda m: times.stamp_span(f"2020-09-17 10:{m:02d}:00")[0]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    # the ends of the range are ends of blocks: no line needs a window
    assert "Window" not in plan(lt.time_range(table, at(5), at(14)))
    assert "Window" in plan(lt.time_range(table, at(6), at(14)))


def test_cat_reads_only_files_of_the_range(spark, logs):
    files = lt.catalog(spark, logs, "app.log", NOW)
    seen = []

    def reader(session, chosen):
        seen.extend(names(chosen))
        return lt.read_logs(session, chosen)

    got = lt.cat(spark, files, "2020-09-16 08:30:00", "25:15:00", read=reader)
    assert seen == [ALL[0], ALL[2]]
    assert [r.line for r in got.orderBy("file_rank", "pos").collect()] == ["2020-09-16 09:00:00 b"]
    got = lt.cat(spark, files, "2020-09-16 08:00:00", "2020-09-17 10:30:00")
    assert got.count() == 5
    with pytest.raises(ValueError):
        lt.cat(spark, files, "2020-09-16 08:00:00", "00:00:00")


def test_split_and_write(spark, logs, tmp_path):
    lines = lt.read_logs(spark, lt.catalog(spark, logs, "app.log", NOW))
    cut = lt.split_by_size(lines, 60)
    total, chunks = 0, {}
    for r in lines.orderBy("file_rank", "block", "pos").collect():
        total += len(r.line.encode()) + 1
        chunks.setdefault((total - 1) // 60, []).append(r)
    want = {}
    for chunk, rows in chunks.items():
        base = os.path.basename(rows[0].path).removesuffix(".gz")
        want[f"a{chr(97 + chunk)}-{base}"] = [r.line for r in rows]
    got = {}
    for r in cut.orderBy("file_rank", "block", "pos").collect():
        got.setdefault(r.chunk_name, []).append(r.line)
    assert got == want
    out = str(tmp_path / "out")
    lt.write_lines(cut, out, "chunk_name")
    written = {}
    for name in want:
        folder = f"{out}/chunk_name={name}"
        parts = sorted(p for p in os.listdir(folder) if p.startswith("part"))
        written[name] = "".join(open(f"{folder}/{p}", newline="").read() for p in parts)
    assert written == {name: "".join(line + "\n" for line in rows) for name, rows in want.items()}


def test_chunk_names(spark):
    from logtrawl.operators.select import chunk_letters

    rows = spark.range(1500).selectExpr("id", f"{chunk_letters('id')} AS name").orderBy("id").collect()
    listed = [r.name for r in rows]
    assert listed[:2] == ["aa", "ab"] and listed[26] == "ba" and listed[675] == "zz" and listed[676] == "zzaa"
    assert listed == sorted(set(listed))


def test_context(spark, lines):
    files = {0: [f"l{n}" for n in range(9)], 1: ["hit", "a", "b"]}
    files[0][4] = files[0][5] = "a hit"
    table = lines(files)
    got = lt.context_lines(table, lt.search_lines(table, ["hit"]), before=2, after=1)
    rows = sorted((r.file_rank, r.lineno, r.is_hit) for r in got.collect())
    assert rows == [
        (0, 2, False), (0, 3, False), (0, 4, True), (0, 5, True), (0, 6, False), (1, 0, True), (1, 1, False)
    ]


@pytest.mark.parametrize(("before", "after", "size"), [(0, 0, 3), (2, 1, 3), (1, 4, 1), (7, 0, 2), (0, 9, 4), (3, 3, 100)])
def test_context_of_many_hits(spark, lines, monkeypatch, before, after, size):
    """Hits go with the lines to their blocks, and reach into the blocks around, however small these are."""
    monkeypatch.setattr(select, "BROADCAST_BYTES", 0)
    rng = random.Random(before * 10 + size)
    files = {f: ["a hit" if rng.random() < 0.25 else "line" for _ in range(rng.randrange(1, 40))] for f in range(4)}
    table = lines(files).withColumn("block", F.expr(f"lineno div {size}"))
    got = lt.context_lines(table, lt.search_lines(table, ["hit"]), before, after)
    assert got.columns == [*table.columns, "is_hit"]
    want = [
        (f, n, text == "a hit", text)
        for f, texts in files.items()
        for n, text in enumerate(texts)
        if any(texts[k] == "a hit" for k in range(max(n - after, 0), min(n + before + 1, len(texts))))
    ]
    assert sorted((r.file_rank, r.lineno, r.is_hit, r.line) for r in got.collect()) == want


def test_files_named_one_by_one(spark, logs):
    """No rotations are looked for, and the given order stays."""
    old = f"{logs}/old/app.log-20200917-{1600300800 + DAY}"
    only = lt.catalog_of(spark, f"{logs}/app.log", NOW)
    assert names(lt.list_logs(only)) == ["app.log"]
    got = lt.cat(spark, f"{logs}/app.log", "2020-09-01 00:00:00", "2020-10-01 00:00:00")
    assert sorted(r.line for r in got.collect()) == ["2020-09-19 00:00:01.000000 live one", "second"]
    both = lt.catalog_of(spark, [f"{logs}/app.log", old], NOW)
    assert [(r.file_rank, os.path.basename(r.path)) for r in both.orderBy("file_rank").collect()] == [(0, "app.log"), (1, os.path.basename(old))]
    assert both.columns == lt.catalog(spark, logs, "app.log", NOW).columns or set(both.columns) == set(lt.catalog(spark, logs, "app.log", NOW).columns)
    lines = lt.cat(spark, [f"{logs}/app.log", old], "2020-09-17 10:00:00", "12:00:00")
    assert [r.line for r in lines.orderBy("file_rank", "pos").collect()] == ["2020-09-17 10:00:00.500000 x\r", "lone\rcr", "2020-09-17 11:00:00 y"]


def test_store_that_only_spark_knows(spark, logs):
    """The same catalog through a path that nothing but Spark's file systems can open."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.only.link./in", f"file://{logs}")
    there, here = lt.catalog(spark, "viewfs://only/in", "app.log", NOW), lt.catalog(spark, logs, "app.log", NOW)
    shown = lambda df: [(r.file_rank, os.path.basename(r.path), r.first_ts, r.rotate_ts) for r in df.orderBy("file_rank").collect()]
    assert shown(there) == shown(here) and sum(r[2] is not None for r in shown(there)) == 3
    found = [sorted(r.line for r in lt.cat(spark, files, "2020-09-17 10:00:00", "12:00:00").collect()) for files in (there, here)]
    assert found[0] == found[1] and len(found[0]) == 4


def test_kept_catalog_opens_only_new_files(spark, logs, tmp_path):
    store = str(tmp_path / "store [1]")
    shown = lambda df: [(os.path.basename(r.path), r.size_bytes, r.first_ts) for r in df.orderBy("file_rank").collect()]
    first = shown(lt.kept_catalog(spark, logs, "app.log", store, NOW))
    assert first == shown(lt.catalog(spark, logs, "app.log", NOW))
    assert shown(lt.kept_catalog(spark, logs, "app.log", store, NOW)) == first and os.listdir(store) == ["version-0"]
    # other bytes, but neither size nor time changed: the file is not opened again
    old = f"{logs}/old/app.log-20200917-{1600300800 + DAY}"
    stat, data = os.stat(old), open(old, "rb").read()
    write(old, data.replace(b"2020-09-17 10", b"2020-09-17 09"))
    os.utime(old, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    new = f"{logs}/old/app.log-20200919-{1600300800 + 3 * DAY}"
    write(new, "2020-09-18 20:00:00 new\n")
    again = shown(lt.kept_catalog(spark, logs, "app.log", store, NOW))
    assert [r for r in again if r[0] != os.path.basename(new)] == first and len(again) == len(first) + 1
    assert dict((r[0], str(r[2])) for r in again)[os.path.basename(new)] == "2020-09-18 20:00:00"
    os.utime(old, (1, 1))  # changed: opened
    os.remove(new)
    last = dict((r[0], str(r[2])) for r in shown(lt.kept_catalog(spark, logs, "app.log", store, NOW)))
    assert last[os.path.basename(old)].startswith("2020-09-17 09") and os.path.basename(new) not in last
    assert sorted(os.listdir(store)) == ["version-1", "version-2"]


def test_granularity_of_lines(spark, logs):
    files = lt.catalog(spark, logs, "app.log", NOW)
    after = lambda g: lt.read_chosen(spark, files, after="2020-09-17 10:30:00", now=NOW, granularity=g)
    before = lambda g: lt.read_chosen(spark, files, before="2020-09-17 10:30:00", now=NOW, granularity=g)
    shown = lambda df: [r.line for r in df.orderBy("file_rank", "pos").collect()]
    x, lone, y = "2020-09-17 10:00:00.500000 x\r", "lone\rcr", "2020-09-17 11:00:00 y"
    late = ["no stamp", "2020-09-18 12:00:00 z é", "2020-09-19 00:00:01.000000 live one", "second"]
    early = ["2020-09-16 08:00:00.000000 first", "  more", "2020-09-16 09:00:00 b"]
    assert shown(after("file")) == [x, lone, y, *late] and shown(after("line")) == [y, *late]
    assert shown(before("file")) == [x, lone, y, *early] and shown(before("line")) == [x, lone, *early]
    assert before("line").columns == before("file").columns
    with pytest.raises(ValueError):
        after("byte")


def test_stop_early(spark, tmp_path):
    paths = []
    for n in range(20):
        path = tmp_path / "s" / f"app.log-20200916-{1600300800 + n}"
        write(path, f"2020-09-16 00:00:{n:02d} line\n" + ("stop here\nafter\n" if n == 11 else "b\n"))
        paths.append(str(path))
    files = lt.catalog(spark, str(tmp_path / "s"), "app.log", NOW, first_lines=False)
    rules = [lt.Rule("line", lt.Print("${lineno} ${line}\n")), lt.Rule("stop", lt.Print(), lt.Exit())]
    leading = lt.files_until_exit(spark, rules, files, first=2)
    assert leading.count() == 16
    texts = []
    for chosen in (leading, files):
        out = lt.run(rules, lt.with_positions(lt.read_logs(spark, chosen)))
        texts.append([r.text for r in lt.in_order(out).collect()])
    assert texts[0] == texts[1] and len(texts[0]) == 13 and texts[0][-1] == "stop here\n"
    assert lt.files_until_exit(spark, rules[:1], files).count() == 20
    limited = [lt.Rule("line", lt.MaxCount(3, exit=True), lt.Print("${line}"))]
    assert lt.files_until_exit(spark, limited, files, first=2).count() == 4


def test_names_are_no_globs(spark, tmp_path):
    """Names with glob characters are read once each and as themselves; names that Spark hides are refused."""
    names = ["app[1].log", "app1.log", "app{a,b}.log", "appa.log", "app*.log", "app?.log", "app x%20.log"]
    for name in names:
        (tmp_path / name).write_text(f"in {name}\n")
    read = lt.read_logs(spark, [str(tmp_path / n) for n in names])
    assert [r.line for r in read.orderBy("file_rank").collect()] == [f"in {n}" for n in names]
    (tmp_path / "_hidden.log").write_text("x\n")
    with pytest.raises(ValueError):
        lt.read_logs(spark, [str(tmp_path / "app1.log"), str(tmp_path / "_hidden.log")])
    with pytest.raises(ValueError):
        lt.catalog(spark, str(tmp_path), ".hidden")


def test_other_splits_are_noticed(spark, tmp_path):
    """Splits that change between counting and reading give the same numbers or an error, never fewer lines."""
    path = tmp_path / "many.log"
    path.write_text("".join(f"line {n}\n" for n in range(20_000)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        lines = lt.with_positions(lt.read_logs(spark, [str(path)]))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "48k")
        try:
            got = sorted((r.lineno, r.line) for r in lines.collect())
        except Exception as error:
            assert "split otherwise" in str(error)
        else:
            assert got == [(n, f"line {n}") for n in range(20_000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
