import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtrawl import Print, Rule, count_patterns, output_lines, run, search, search_lines, search_table
from logtrawl.functions import text
from logtrawl.operators import match, scan
from logtrawl.operators.match import MATCH_ORDER, check_patterns
from logtrawl.plans.sql import register_log
from logtrawl.sources import tables


def naive(line, pattern):
    raw, wanted = line.encode(), pattern.encode()
    return [i for i in range(len(raw) - len(wanted) + 1) if raw[i : i + len(wanted)] == wanted] if wanted else []


def found(df):
    return sorted((r.file_rank, r.pos, r.pattern, r.occurrence, r.match_pos, r.match_end) for r in df.collect())


def expected(files, patterns):
    return sorted(
        (rank, n, p, i, at, at + len(p.encode()))
        for rank, texts in files.items()
        for n, line in enumerate(texts)
        for p in patterns
        for i, at in enumerate(naive(line, p))
    )


FILES = {0: ["aaaa", "x x", "éaébé", ""], 1: ["nothing", "abc", "a|b\\E$[.*", "${v} 'q'", "tab\there"]}


def test_occurrences(lines):
    patterns = ["aa", "x", "é", "abc", "bc", "c", "|b\\E", "${v}", "'q'", "\t", ".*", ""]
    got = search(lines(FILES), patterns)
    assert found(got) == expected(FILES, [p for p in patterns if p])


def test_suffix_order(lines):
    rows = search(lines({0: ["abc"]}), ["c", "abc", "bc"]).orderBy(*[f for f in ["file_rank", "pos", "match_end"]]).collect()
    assert MATCH_ORDER == ("pos", "match_end", "-match_len")
    assert [r.pattern for r in sorted(rows, key=lambda r: (r.match_end, -r.match_len))] == ["abc", "bc", "c"]


def test_many_hits_in_one_line(lines):
    line = "ab" * 700
    for pattern in ("ab", "b", "abab"):
        got = search(lines({0: [line]}), [pattern]).select("match_pos").collect()
        assert sorted(r.match_pos for r in got) == naive(line, pattern)


def test_chunk_edges(spark):
    for count in (1, 127, 128, 129, 255, 256, 257, 300):
        row = spark.createDataFrame([("x,yy" * count,)], "line string")
        assert row.selectExpr(f"{text.positions('line', ',')} AS p").first().p == naive("x,yy" * count, ",")


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.text(alphabet="abé|\\. ", max_size=25), min_size=1, max_size=8),
    st.lists(st.text(alphabet="abé|\\. ", min_size=1, max_size=4), min_size=1, max_size=4, unique=True),
)
def test_against_plain_search(lines, texts, patterns):
    files = {0: texts}
    assert found(search(lines(files), patterns)) == expected(files, patterns)
    counts = {r.pattern: r.n for r in count_patterns(lines(files), patterns).collect()}
    assert counts == {p: sum(len(naive(t, p)) for t in texts) for p in patterns}


def test_three_ways_agree(spark, lines, monkeypatch):
    rng = random.Random(7)
    files = {f: ["".join(rng.choice("abcé ") for _ in range(rng.randrange(30))) for _ in range(9)] for f in range(3)}
    patterns = sorted({"".join(rng.choice("abcé ") for _ in range(rng.randrange(1, 5))) for _ in range(160)})
    assert len(patterns) > match.INLINE_PATTERNS
    want = expected(files, patterns)
    assert found(search(lines(files), patterns)) == want
    counts = {r.pattern: r.n for r in count_patterns(lines(files), [*patterns, "never", ""]).collect()}
    assert counts == {p: sum(w[2] == p for w in want) for p in [*patterns, "never", ""]}
    rows = {(r.file_rank, r.pos) for r in search_lines(lines(files), [*patterns, ""]).collect()}
    assert rows == {w[:2] for w in want}
    table = spark.createDataFrame([(p,) for p in [*patterns, patterns[0], ""]] + [(None,)], "pattern string")
    assert found(search_table(lines(files), table)) == want
    monkeypatch.setattr(match, "PATTERN_BYTES", 0)
    assert found(search_table(lines(files), table)) == want


RAW = [
    b"x\xff\xfeab cd ab", b"\xe2ab\x82ab\xc3\xa9", b"\xef\xbf\xbd\xff\xef\xbf\xbd", b"aaaa\x80aa\xf0aa", b"", b"\xc3\xa9" * 3 + b"\xc3ab",
]


@pytest.mark.parametrize("more", [0, 20, 1000])
def test_bytes_of_any_encoding(spark, lines, more):
    """Offsets and counts are those of the bytes, whatever they are and however many patterns are asked for."""
    rng = random.Random(more)
    raws = RAW + [bytes(rng.choice(b"ab \xc3\xa9\xff\xe2\x82\xef\xbf\xbd") for _ in range(rng.randrange(40))) for _ in range(30)]
    patterns = ["ab", "aa", "é", "\ufffd", "b ", "a"] + [f"no {n}" for n in range(more)]
    log = lines({0: [raw.hex() for raw in raws]}).withColumn("line", F.expr("string(unhex(line))"))
    want = sorted(
        (n, p, i, at)
        for n, raw in enumerate(raws)
        for p in patterns
        for i, at in enumerate(k for k in range(len(raw)) if raw[k:].startswith(p.encode()))
    )
    got = search(log, patterns)
    assert sorted((r.pos, r.pattern, r.occurrence, r.match_pos) for r in got.drop("line").collect()) == want
    counts = {r.pattern: r.n for r in count_patterns(log, patterns).collect()}
    assert counts == {p: sum(w[1] == p for w in want) for p in patterns}
    hit = search_lines(log, patterns).selectExpr("pos").collect()
    assert {r.pos for r in hit} == {w[0] for w in want}


def test_printed_bytes_stay(lines):
    log = lines({0: [raw.hex() for raw in RAW]}).withColumn("line", F.expr("string(unhex(line))"))
    out = output_lines(run([Rule("a", Print())], log)).selectExpr("hex(binary(line)) AS h").collect()
    want = [raw.hex().upper() for raw in RAW for _ in range(raw.count(b"a"))]
    assert sorted(r.h for r in out) == sorted(want)


def test_trie_takes_the_longest():
    words = ["he", "she", "hers", "h", "s+e", *[chr(97 + n) + "x" for n in range(26)]]
    regex = re.compile(text.trie_regex(words))
    for value in ("hershey", "hexhe", "s+ehx", "zx", "q"):
        for at in range(len(value)):
            longest = max((w for w in words if value.startswith(w, at)), key=len, default=None)
            hit = regex.match(value, at)
            assert (hit and hit.group()) == longest


def test_beginnings_of_beginnings(spark, lines):
    """Many patterns, each the beginning of the next; and a pattern of a table far longer than the rest."""
    patterns = ["a" * n for n in range(1, 701)] + ["ab", "b"]
    files = {0: ["a" * 750, "aab" * 3, "b", "", "x" * 9 + "aaa"]}
    want = expected(files, patterns)
    assert found(search(lines(files), patterns)) == want
    counts = {r.pattern: r.n for r in count_patterns(lines(files), patterns).collect()}
    assert counts == {p: sum(w[2] == p for w in want) for p in patterns}
    assert search_lines(lines(files), patterns).count() == 4


def test_hot_line_among_many_patterns(lines):
    line = "ab" * 900 + "é" + "abab" * 40
    patterns = ["ab", "b", "abab", "éa", *[f"no {n}" for n in range(20)]]
    assert found(search(lines({0: [line, "b"]}), patterns)) == expected({0: [line, "b"]}, patterns)


@pytest.mark.parametrize("broadcast", [match.BROADCAST_BYTES, 0])
def test_rare_grams(spark, lines, monkeypatch, broadcast):
    """Patterns of every length around a gram, across pieces of lines, beside each other and overlapping."""
    monkeypatch.setattr(match, "PATTERN_BYTES", 0)
    monkeypatch.setattr(match, "PIECE_BYTES", 16)
    monkeypatch.setattr(match, "BROADCAST_BYTES", broadcast)
    rng = random.Random(9)
    files = {f: ["".join(rng.choice("abcé ") for _ in range(rng.choice([0, 3, 15, 16, 17, 40, 90]))) for _ in range(12)] for f in range(3)}
    every = [line[i : i + n] for texts in files.values() for line in texts for n in (1, 3, 4, 5, 16, 21) for i in range(0, len(line), 7)]
    patterns = sorted({p for p in every if p} | {"aaaa", "never there", "é"})
    table = spark.createDataFrame([(p,) for p in [*patterns, ""]], "pattern string")
    assert found(search_table(lines(files), table)) == expected(files, patterns)
    assert search_table(lines(files), table.filter("pattern = ''")).count() == 0


def test_few_places_become_rows(spark, monkeypatch):
    """Of the bytes of the documents, only those with the rarest gram of a pattern are looked at again."""
    monkeypatch.setattr(match, "GRAM_SAMPLE", 1)  # so small a table has too few lines for a sample
    log = tables.document_log(spark, "/root/testdata/sf0.001")
    texts = log.selectExpr("substring(line, 11, 24) AS pattern").filter("octet_length(pattern) >= 24").distinct()
    chosen = match._rarest_grams(log, texts).cache()
    read = log.selectExpr("sum(octet_length(line)) AS n").first().n
    shuffled = match._gram_places(log, [match.GRAM]).filter(match._may_stand(chosen, chosen.count())).join(chosen, "_gram").count()
    assert chosen.count() > 500
    assert shuffled < read / 20
    chosen.unpersist()


def test_many_patterns_are_one_pass(lines):
    """Lines and counts need no Python; matches are found in one pass, without a join or a copy of a line."""
    patterns = [f"word {n}" for n in range(100)]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (search_lines(lines({0: ["a b"]}), patterns), count_patterns(lines({0: ["a b"]}), patterns)):
        assert not any(word in plan(df) for word in ("Python", "Pandas", "Arrow"))
    found = plan(search(lines({0: ["a b"]}), patterns))
    assert found.count("MapInArrow") == 1 and "Join" not in found


def test_scan_against_plain_search(monkeypatch):
    """Pieces and heads of any size; patterns that share a head; lines side by side."""
    rng = random.Random(3)
    for piece in (1 << 20, 64):
        monkeypatch.setattr(scan, "PIECE", piece)
        for _ in range(12):
            raws = [bytes(rng.choice(b"ab \xc3\xa9") for _ in range(rng.choice([0, 1, 5, 40, 200]))) for _ in range(12)]
            patterns = {bytes(rng.choice(b"ab \xc3\xa9") for _ in range(rng.choice([1, 2, 3, 31, 32, 33, 40]))) for _ in range(30)}
            patterns = sorted(patterns | {raw[3:50] for raw in raws if len(raw) > 60} | {b"a" * n for n in (31, 32, 33, 34)})
            ends = np.cumsum([len(raw) for raw in raws])
            got = scan.Scan(patterns).places(np.frombuffer(b"".join(raws), np.uint8), ends)
            want = [
                (i, n, at) for i, raw in enumerate(raws) for n, p in enumerate(patterns)
                for at in range(len(raw) - len(p) + 1) if raw.startswith(p, at)
            ]
            assert list(zip(*(x.tolist() for x in got), strict=True)) == want


def test_slices_of_a_batch(lines, monkeypatch):
    files = {0: ["ab" * n for n in range(40)] + [None, "b"]}
    patterns = ["ab", "b", "ba", *[f"no {n}" for n in range(20)]]
    data = np.frombuffer(b"".join((t or "").encode() for t in files[0]), np.uint8)
    assert len(data) > 1000
    schema = T.StructType([T.StructField("line", T.StringType()), T.StructField("_found", scan.FOUND)])
    monkeypatch.setattr(scan, "SLICE_BYTES", 100)
    run_ = scan.found_in(scan.Scan([p.encode() for p in patterns]), 0, schema)
    whole = pa.RecordBatch.from_arrays([pa.array(["cut", *files[0], "cut"])], ["line"])
    got = [row for batch in run_(iter([whole.slice(1, len(files[0])), whole.slice(0, 0)])) for row in batch.to_pylist()]
    assert [r["line"] for r in got] == files[0]
    for r in got:
        assert [(patterns[f["pattern_id"]], f["occurrence"], f["match_pos"]) for f in r["_found"]] == [
            (p, i, at) for p in patterns for i, at in enumerate(naive(r["line"] or "", p))
        ]


def test_counts_zero_and_overlap(lines):
    got = {r.pattern: r.n for r in count_patterns(lines(FILES), ["aa", "never", "é"]).collect()}
    assert got == {"aa": 3, "never": 0, "é": 3}
    assert {r.n for r in count_patterns(lines({0: ["x"]}).filter("false"), ["a"]).collect()} == {0}


def test_pattern_checks():
    with pytest.raises(ValueError):
        check_patterns(["a\nb"])
    with pytest.raises(ValueError):
        check_patterns(["a", "a"])
    assert check_patterns(["a", "b", "a", ""], on_duplicate="last") == ["b", "a"]


def test_filter_is_pushed_to_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("some line",)], "line string").write.parquet(path)
    plan = search_lines(spark.read.parquet(path), ["a", "b"])._jdf.queryExecution().toString()
    assert "StringContains(line,a)" in plan and "StringContains(line,b)" in plan
    assert search_lines(spark.read.parquet(path), [""]).count() == 0


SLICES = [(2, 5), (-3, None), (None, -2), (9, 1), (0, 2), (1, None), (-100, 3), (3, -100), (-2, -1), (None, None)]


def test_slices(spark):
    texts = ["abcdef", "éa", "", "x"]
    rows = spark.createDataFrame([(t,) for t in texts], "line string")
    exprs = [f"hex(binary({text.byte_slice('line', a, b)})) AS _{n}" for n, (a, b) in enumerate(SLICES)]
    for row in rows.selectExpr("line", *exprs).collect():
        for n, (a, b) in enumerate(SLICES):
            assert row[f"_{n}"] == row.line.encode()[a:b].hex().upper(), (row.line, a, b)


def test_match_extras(spark):
    rows = spark.createDataFrame([("a user_id=7 b", 1), ("end user_id=", 3)], "line string, at bigint")
    shown = rows.selectExpr(
        f"{text.match_until('line', 'at', chr(39) + ' user_id=' + chr(39), ' ')} AS until",
        f"{text.match_plus('line', 'at', chr(39) + ' user_id=' + chr(39), 2)} AS plus",
    ).collect()
    assert [r.until for r in shown] == [" user_id=7", " user_id="]
    assert [r.plus for r in shown] == [" user_id=7 ", " user_id="]


def test_capture(spark):
    rows = spark.createDataFrame([("id=12 x",), ("none",)], "line string")
    got = rows.selectExpr(f"{text.capture('line', 'id=([0-9]+)')} AS g", f"{text.capture('line', 'id=[0-9]+')} AS w").collect()
    assert [tuple(r) for r in got] == [("12", "id=12"), (None, None)]


LONGEST = ["(a|ab)(c|bcd)?", "x*(b|bc|bcd)d?", "(a+|ab|abc)+", "(ab|a)(bc|c)?$", "^(a|ab|b)+", "(b?)(ab)?(c|abc)*", "((a|ab)(c|bcd))(d*)", "a|abc|ab", "(é|éa|b)*c?", "[|(a]+b?", "(a|(ab))+"]


@pytest.mark.parametrize("regex", LONGEST)
def test_longest_captures(spark, regex):
    """Of the matches that begin first the longest; of the ways to match as much, the first that is tried."""
    rng = random.Random(len(regex))
    values = ["", "abcd", "xabcd", "zzabbcd", "abab", "|(ab", "a\rb", "😀abcd", "abcabcd", *["".join(rng.choice("abcdxé") for _ in range(rng.randrange(14))) for _ in range(60)]]

    def longest(value):
        plain = re.compile(regex)
        first = plain.search(value)
        if not first:
            return None
        for left in range(len(value) - first.start() + 1):
            m = re.compile(f"(?:{regex})(?=(?s:.{{{left}}})\\Z)").match(value, first.start())
            if m:
                return (m[1] or "") if plain.groups else m[0]

    rows = spark.createDataFrame(list(enumerate(values)), "n int, line string").selectExpr("n", f"{text.capture('line', regex)} AS got")
    assert [r.got for r in rows.orderBy("n").collect()] == [longest(v) for v in values]


def test_sql_functions(spark, lines):
    register_log(lines(FILES), "test_log")
    rows = spark.sql("SELECT line, log_places(line, 'aa') AS aa, log_places(line, 'é') AS e, log_places(line, '') AS none FROM test_log").collect()
    assert all((r.aa, r.e, r.none) == (naive(r.line, "aa"), naive(r.line, "é"), []) for r in rows) and len(rows) == 9
    cuts = [(2, 5), (-3, None), (None, -2), (9, 1), (-500, 500), (-10, -4), (None, None)]
    for first, last in cuts:
        value = lambda x: "NULL" if x is None else str(x)
        found = spark.sql(f"SELECT line, log_slice(line, {value(first)}, {value(last)}) AS cut, {text.byte_slice('line', first, last)} AS same FROM test_log").collect()
        assert all(r.cut == r.same for r in found)
