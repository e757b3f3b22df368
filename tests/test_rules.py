import glob

import pytest

import logtrawl as lt
from logtrawl import Context, Count, Custom, Exit, File, Interval, MaxCount, Print, Regex, Rule, RuleSet
from logtrawl.functions import template
from logtrawl.operators import sinks
from logtrawl.plans import examples


def texts(out, sink=None):
    rows = lt.in_order(out).collect()
    return [(r.sink, r.text) if sink is None else r.text for r in rows if sink in (None, r.sink)]


def test_print_repeats_per_match(lines):
    assert texts(lt.run([Rule("x", Print())], lines({0: ["x x", "y", "x"]})), "stdout") == ["x x\n"] * 2 + ["x\n"]


def test_nested_product_and_order(lines):
    rules = [Rule("p", Rule("c", Print("${match}${offset} ")), Print("${match}${offset}\n"))]
    table = lines({0: ["pcpcc"]}).selectExpr("*", "0L AS line_offset")
    assert texts(lt.run(rules, table), "stdout") == ["c1 ", "c3 ", "c4 ", "p0\n", "c1 ", "c3 ", "c4 ", "p2\n"]


def test_three_levels(lines):
    rules = [Rule("a", Rule("b", Rule("c", Print("abc ${line}\n")), Print("ab\n")), Rule("d", Print("ad\n")))]
    got = texts(lt.run(rules, lines({0: ["a b", "a b c", "d b c", "a d", "a"]})), "stdout")
    assert got == ["ab\n", "abc a b c\n", "ab\n", "ad\n"]


def test_longer_pattern_first_at_the_same_end(lines):
    rules = [Rule("c", Print("c ")), Rule("abc", Print("abc ")), Rule("bc", Print("bc "))]
    assert texts(lt.run(rules, lines({0: ["abc"]})), "stdout") == ["abc ", "bc ", "c "]


def test_format_parts(lines):
    fmt = "${lineno}|${line_offset}|${offset}|${match}|${match+2}|${match/}}|${match/ }|${line:,2}|${line:-2}|${line:1,3}|${time}|${x}|$$\\n"
    table = lines({0: ["2020-07-04 00:00:00 k=v}w z"]}).selectExpr("*", "100L AS line_offset")
    got = texts(lt.run([Rule("k=", Print(fmt))], table), "stdout")
    assert got == ["0|100|120|k=|k=v}|k=v|k=v}w|20| z|02|1593820800000000|${x}|$$\n"]


def test_each_part_keeps_its_own_numbers():
    parts = template.parse_format("${line:1,2}${line:-3,}${match+4}${match/;}")
    assert [(p.kind, p.start, p.end, p.value) for p in parts] == [
        ("line", 1, 2, ""), ("line", -3, None, ""), ("match_plus", 4, None, ""), ("match_until", None, None, ";")
    ]


def test_counts(lines):
    rules = [
        Rule("x", Print(), Count("x: ${count}\\n"), Rule("y", Count("y\\t${count}"))),
        Rule("never", Count("never ${count}"), Rule("x", Count("below ${count}"))),
        Rule("z", Count("plain \\q")),
    ]
    table = lines({0: ["x x y", "z"], 1: ["x"]})
    want = ["x: 3\n", "y\t2", "never 0", "below 0", "plain q"]
    assert texts(lt.run(rules, table), "stdout")[-5:] == want
    only = [Rule("x", Count("x: ${count}\\n"), Rule("y", Count("y\\t${count}"))), *rules[1:]]
    assert texts(lt.run(only, table), "stdout") == want


def test_max_count_acts_exactly_n_times(lines):
    rules = [Rule("x", Print("a"), MaxCount(2), Rule("y", Print("y")), Count("${count}"))]
    table = lines({0: ["x y y", "n"], 1: ["x", "x y"], 2: ["x x"]})
    assert texts(lt.run(rules, table), "stdout") == ["a", "y", "y", "a", "2"]
    assert texts(lt.run([Rule("x", MaxCount(0), Print("a"))], table), "stdout") == ["a"] * 5


def test_limits_at_several_depths(lines):
    rules = [
        Rule("x", MaxCount(3), Rule("y", MaxCount(2), Print("y"), Rule("z", MaxCount(1), Print("z"))), Print("x")),
        Rule("w", MaxCount(1), Rule("y", Print("Y"))),
        Rule("v", Rule("y", MaxCount(1), Print("V")), Print("v")),
    ]
    table = lines({0: ["x", "x y z", "w y"], 1: ["w y", "x y z y", "v y", "x y z", "v y"]})
    assert "".join(texts(lt.run(rules, table), "stdout")) == "xyzxYyxVvv"


def test_nested_max_count_is_shared_by_all_parents(lines):
    rules = [Rule("x", Rule("y", MaxCount(3), Print("y")), Print("x"))]
    assert texts(lt.run(rules, lines({0: ["x y y", "x y y", "x y"]})), "stdout") == ["y", "y", "x", "y", "x", "x"]


def test_max_count_exit(lines):
    rules = [Rule("x", MaxCount(2, exit=True), Print("x${line}")), Rule("z", Print("z"), Count("${count}"))]
    table = lines({0: ["z", "x1", "z"], 1: ["z x2 z", "z", "x3"]})
    assert texts(lt.run(rules, table), "stdout") == ["z", "xx1", "z", "z", "xz x2 z", "3"]
    assert texts(lt.run([Rule("x", MaxCount(9, exit=True), Print("x"))], table), "stdout") == ["x"] * 3


def test_exit(lines, spark):
    rules = RuleSet(
        [Rule("stop", Exit(), Print("S"), Rule("s", Print("s"))), Rule("x", Print("x"), Count("${count}"))],
        on_end=[Print("end")], on_file_start=[Print("[${filename}]")], on_file_end=[Print("/")],
    )
    table = lines({0: ["x", "x"], 1: ["x", "x stop x stop"], 2: ["x"]})
    files = spark.createDataFrame([(n, f"f{n}", None) for n in range(3)], "file_rank bigint, path string, rotate_ts timestamp")
    got = "".join(texts(lt.run(rules, table, files), "stdout"))
    assert got == "[f0]xx/[f1]xxSss/end4"


def test_interval(lines):
    stamps = ["2020-01-01 00:00:01 x", "no stamp x", "2020-01-01 00:00:14.001220 x x"]
    rules = [Rule("x", Interval("[${time}]\\n")), Rule("never", Interval("${time}"))]
    got = texts(lt.run(rules, lines({0: stamps, 1: ["2020-01-01 00:00:10 x"]})), "stdout")
    assert got == ["[0d 0h 0m 13s 1220us]\n", "[0d 0h 0m 0s 0us]\n", "[0d 0h 0m 4s 1220us]\n"]


def test_variables(lines):
    rules = [
        Rule("set", Regex("v=([a-z]*)", "v"), Rule("deep", Regex("d=[0-9]", "d"))),
        Rule("show", Print("${v},${d} ")),
        Rule("both", Regex("v=([a-z]*)", "v"), Print("${v};")),
    ]
    table = lines({0: ["show", "set v=a", "show set no", "both", "set deep d=1 v=b"], 1: ["show", "both v=c", "show"]})
    assert "".join(texts(lt.run(rules, table), "stdout")) == "${v},${d} a,${d} a;b,d=1 c;c,d=1 "
    matched = texts(lt.run(rules, table, var_scope="match"), "stdout")
    assert "".join(matched) == "${v},${d} ${v},${d} ${v};${v},${d} c;${v},${d} "
    assert "".join(texts(lt.run([Rule("x", Regex("x(=)?", "v"), Print("[${v}]"))], lines({0: ["x"]})), "stdout")) == "[]"


def test_match_scope_reads_parents(lines):
    rules = [Rule("a", Regex("u=([0-9]+)", "u"), Rule("b", Print("${u}${w}")), Regex("w=.", "w"))]
    got = texts(lt.run(rules, lines({0: ["a b u=12 w=3"]}), var_scope="match"), "stdout")
    assert got == ["12${w}"]


def test_routing(lines):
    rules = [
        Rule(
            "x", Print("1"), File("f"), Print("2"), Rule("y", Print("3"), File(stderr=True, stdout=True), Print("4")),
            File(stderr=True), Print("5"), Count("${count}"),
        )
    ]
    assert texts(lt.run(rules, lines({0: ["x y"]}))) == [
        ("stdout", "1"), ("f", "2"), ("stdout", "3"), ("stdout", "4"), ("stderr", "5"), ("stdout", "1")
    ]


def test_context(lines):
    files = {0: ["a", "b", "hit", "c", "d"], 1: ["hit"]}
    got = texts(lt.run([Rule("hit", Context(before=1, after=2, fmt="${lineno}${line}${match}\n"), Print())], lines(files)), "stdout")
    assert got == ["1bb\n", "3cc\n", "4dd\n", "hit\n", "hit\n"]


def test_several_contexts(lines):
    rules = [
        Rule("b", Context(after=1), File("f"), Context(before=1, fmt="<${line}>")),
        Rule("d", MaxCount(1), Context(before=2, after=9, fmt="(${line})")),
    ]
    got = texts(lt.run(rules, lines({0: ["a", "b", "c", "d", "e", "d"]})))
    assert got == [("stdout", "c\n"), ("f", "<a>")] + [("stdout", f"({c})") for c in "bced"]
    assert texts(lt.run([Rule("b", Context()), Rule("c", Print())], lines({0: ["b", "c"]}))) == [("stdout", "c\n")]


def test_custom_action(lines):
    lt.register_action("shout", lambda matches, suffix: matches.filter("line <> 'x2'").selectExpr("*", f"upper(concat(pattern, line, '{suffix}')) AS text"))
    rules = [Rule("x", Custom("shout", {"suffix": "!\n"}), Print())]
    assert texts(lt.run(rules, lines({0: ["x1", "x2"]})), "stdout") == ["XX1!\n", "x1\n", "x2\n"]


def test_custom_action_at_end(lines):
    def total(matches, **_):
        return matches.selectExpr("concat(count(1), ' in ', count(distinct line)) AS text")

    lt.register_action("size", lambda matches: matches.selectExpr("*", "length(line) AS text"), at_end=total)
    rules = [Rule("x", Count("${count},"), Custom("size")), Rule("n", Count("${count};"))]
    assert texts(lt.run(rules, lines({0: ["x x", "xyz"]})), "stdout") == ["3", "3", "3", "3,", "3 in 2", "0;"]


def test_plain_strings_print(lines):
    assert texts(lt.run([Rule("a", Print("A")), "b"], lines({0: ["b a", "b"]})), "stdout") == ["b a\n", "A", "b\n"]


def test_output_lines_and_sinks(spark, lines, tmp_path):
    rules = [
        Rule("x", Rule("y", Print("Y ")), File("f"), Print("${lineno}"), File(stdout=True), Print()),
        Rule("z", Print("one\\n\\ntwo\\n")),
        Rule("end", File("log", append=True), Print("tail")),
    ]
    out = lt.run(rules, lines({0: ["x y", "z"], 1: ["x", "end"]}))
    got = {}
    for r in lt.output_lines(out).orderBy("sink", "out_lineno").collect():
        got.setdefault(r.sink, []).append((r.out_lineno, r.line))
    assert got == {
        "stdout": [(0, "Y x y"), (1, "one"), (2, ""), (3, "two"), (4, "x")], "f": [(0, "00")], "log": [(0, "tail")]
    }
    folder = str(tmp_path / "out")
    modes = lt.Program(rules).append_sinks()
    for _ in range(2):
        lt.write_output(out, folder, modes)

    def content(sink):
        return "".join(open(p).read() for p in sorted(glob.glob(f"{folder}/sink={sink}/*/part*")))

    assert content("stdout") == "Y x y\none\n\ntwo\nx\n"
    assert content("f") == "00\n" and content("log") == "tail\ntail\n"


def read_back(spark, folder):
    found = {}
    for r in lt.read_output(spark, folder).orderBy("sink", "run", "part", "pos").collect():
        found.setdefault(r.sink, []).append(r.line)
    return found


def test_appended_runs_stay_in_order(spark, lines, tmp_path, monkeypatch):
    folder = str(tmp_path / "out of [runs] %41")
    rules = [Rule("x", File("more/é+%2B.log", append=True), Print(), File("new"), Print())]
    modes = lt.Program(rules).append_sinks()
    wrote = []
    for n in range(12):
        texts = [f"x {n} {i}" for i in range(7)]
        assert lt.write_output(lt.run(rules, lines({0: texts})), folder, modes) == n
        wrote += texts
        assert read_back(spark, folder) == {"more/é+%2B.log": wrote, "new": texts}
    # a run that fails at its end leaves nothing behind that counts
    out = lt.run(rules, lines({0: ["x lost"]}))
    with monkeypatch.context() as patched:
        patched.setattr("logtrawl.operators.sinks._commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            lt.write_output(out, folder, modes)
    assert read_back(spark, folder) == {"more/é+%2B.log": wrote, "new": texts}
    assert lt.write_output(out, folder, modes) == 12
    assert read_back(spark, folder) == {"more/é+%2B.log": [*wrote, "x lost"], "new": ["x lost"]}
    # no text, no run
    assert lt.write_output(out.filter("false"), folder, modes) is None
    assert lt.read_output(spark, str(tmp_path / "never")).count() == 0
    with pytest.raises(RuntimeError, match="another run"):
        sinks._commit(spark, folder, {"number": 12, "folder": "run=x", "sinks": {}})


def test_lifecycle(spark, lines):
    rules = RuleSet(
        [Rule("x", Print())], on_start=[Print("begin\n")], on_end=[Print("a"), File(stderr=True), Print("b")],
        on_file_start=[Print("${filename} ${rotate-time}\n")], on_file_end=[Print("-")],
    )
    files = spark.sql("SELECT 0L AS file_rank, '/l/a' AS path, timestamp'2020-09-17 04:40:01' AS rotate_ts UNION ALL SELECT 1L, '/l/b', null")
    got = texts(lt.run(rules, lines({0: ["x"], 1: ["n"]}), files))
    assert [t for _, t in got] == ["begin\n", "/l/a 2020-09-17 04:40:01\n", "x\n", "-", "/l/b n/a\n", "-", "a", "b"]
    assert got[-1][0] == "stderr"


@pytest.mark.parametrize(
    "rules",
    [
        [Rule("", Print())],
        [Rule("a\nb", Print())],
        [Rule("a", Print()), Rule("a", Print())],
        [Rule("a", Rule("", Print()))],
        [Rule("a", "print")],
        [Rule("a", File())],
        [Rule("a", File("f"), File("f", append=True))],
        [Rule("a", Count("${count} ${count}"))],
        [Rule("a", Interval("${time}${time}"))],
        [Rule("a", MaxCount(-1))],
        [Rule("a", Custom("not there"))],
        RuleSet([], on_start=[Print()]),
        RuleSet([], on_start=[Print("${line}")]),
        RuleSet([], on_end=[Print("${filename}")]),
        RuleSet([], on_end=[Count("${count}")]),
    ],
)
def test_rejected(rules):
    with pytest.raises(ValueError):
        lt.Program(rules)


def test_missing_columns(lines):
    table = lines({0: ["x"]}).drop("lineno")
    with pytest.raises(ValueError):
        lt.run([Rule("x", Print("${lineno}"))], table)
    with pytest.raises(ValueError):
        lt.run(RuleSet([Rule("x", Print())], on_file_end=[Print("-")]), table)
    lt.run([Rule("x", Rule("x", Print("${offset}")))], table)


def test_last_duplicate_wins_if_asked(lines):
    rules = [Rule("x", Print("a")), Rule("x", Print("b"))]
    assert texts(lt.run(rules, lines({0: ["x"]}), on_duplicate="last"), "stdout") == ["b"]


def test_block_size_does_not_matter(lines):
    rules = [
        Rule("x", MaxCount(9), Regex("n=([0-9]+)", "n"), Interval("${time} "), Rule("y", Print("${n}"), MaxCount(4)), Count("${count}")),
        Rule("stop", Exit()),
        Rule("n=1", Print("<${n}>")),
    ]
    files = {
        f: [f"2020-01-01 00:{f:02d}:{n:02d} n={n * f} {'x' * (n % 3)} {'y' if n % 2 else ''}" for n in range(12)] + ["stop"] * (f == 3)
        for f in range(5)
    }
    want = texts(lt.run(rules, lines(files, block_rows=1000)))
    assert len(want) > 20
    for size in (1, 3, 7):
        assert texts(lt.run(rules, lines(files, block_rows=size))) == want


def test_many_rules_like_few(lines):
    """More rules than are tested one by one give the same as each rule alone."""
    files = {0: [f"id={n % 90} v={n}" for n in range(200)]}
    rules = [Rule(f"id={n} ", Rule("v=1", Print("${match+2};"))) for n in range(80)]
    got = texts(lt.run(rules, lines(files, 64)), "stdout")
    want = [f"v={str(n)[:3]};" for n in range(200) if n % 90 < 80 and str(n)[0] == "1"]
    assert got == want


def test_examples(spark, lines):
    files = spark.createDataFrame([(0, "/l/a", None)], "file_rank bigint, path string, rotate_ts timestamp")
    log = ["2020-01-01 00:00:00 START", "2020-01-01 00:00:01 o-1 NEW acct=7 x", "2020-01-01 00:00:02 o-2 NEW",
           "2020-01-01 00:00:03 o-1 CHANGE acct=8 x", "2020-01-01 00:00:05 o-1 CHANGE"]
    table = lines({0: log})
    assert texts(lt.run(examples.tally(["START", "NEW"], "found"), table, files)) == [
        ("found", log[0] + "\n"), ("found", log[1] + "\n"), ("found", log[2] + "\n"), ("stdout", "START\t1\n"), ("stdout", "NEW\t2\n")
    ]
    got = texts(lt.run(examples.pauses("o-1", {"changes": "CHANGE"}), table), "changes")
    assert got == ["0d 0h 0m 2s 0us\n"]
    got = texts(lt.run(examples.fields_of("o-1", "CHANGE", ["acct="], "f"), table))
    assert got == [("f", "acct=8\n"), ("stdout", "CHANGE: 2\n")]
    assert texts(lt.run(examples.first_of("o-1", "CHANGE"), table), "stdout") == [log[3] + "\n"]


def test_variables_in_blocks_and_context(spark, lines):
    table = lines({0: ["a", "set u=1.", "b"], 1: ["c"], 2: ["set u=2.", "d", "set u=3.", "e"]})
    files = spark.createDataFrame([(0, "f0", None), (1, "f1", None), (2, "f2", None)], "file_rank bigint, path string, rotate_ts timestamp")
    rules = RuleSet(
        [Rule("set", Regex("u=([0-9])", "u"), Context(after=1, fmt="<${u} ${line}>"))],
        on_start=[Print("start ${u}")], on_end=[Print("end ${u}")],
        on_file_start=[Print("open ${u}")], on_file_end=[Print("close ${u}")],
    )
    shown = [r.text for r in lt.in_order(lt.run(rules, table, files)).collect()]
    assert shown == [
        "start ${u}", "open ${u}", "<1 b>", "close 1", "open 1", "close 1", "open 1", "<2 d>", "<3 e>", "close 3", "end 3",
    ]
    alone = lt.run(rules, table, files, var_scope="match").filter("text like '<%'")
    assert sorted(r.text for r in alone.collect()) == ["<1 b>", "<2 d>", "<3 e>"]


def test_a_variable_never_set_keeps_its_name(spark, lines):
    rules = RuleSet([Rule("x", Regex("u=([0-9])", "u"))], on_end=[Print("end ${u} ${v}")])
    assert [r.text for r in lt.run(rules, lines({0: ["y"]})).collect()] == ["end ${u} ${v}"]


def test_nested_limits_do_not_multiply_the_plan(lines):
    table = lines({0: ["a b c d"] * 5})

    def plan(depth):
        rule = Rule("d", MaxCount(2), Print())
        for pattern in "cba"[3 - depth:]:
            rule = Rule(pattern, MaxCount(3), rule)
        return len(lt.run([rule], table)._jdf.queryExecution().optimizedPlan().toString())

    assert plan(3) < 3 * plan(1)


def test_many_counts(lines):
    table = lines({0: ["n1 n2 n1", "n30 n3"], 1: ["n1"]})
    flat = lt.run([Rule(f"n{n} ", Count(f"{n}=${{count}}")) for n in range(40)], table)
    got = dict(r.text.split("=") for r in flat.collect())
    assert got == {str(n): str({1: 1, 2: 1, 30: 1}.get(n, 0)) for n in range(40)}
    nested = lt.run([Rule(f"n{n}", Count(f"{n}=${{count}}"), Rule("n", Count(f"{n}n=${{count}}"))) for n in range(9)], table)
    got = dict(r.text.split("=") for r in nested.collect())
    assert (got["1"], got["1n"], got["3"], got["3n"], got["4n"]) == ("3", "7", "2", "4", "0")


def test_a_line_without_an_end_is_refused(spark, lines, monkeypatch):
    """Prints of a sink that never end its line do not become one row of any size."""
    table = lines({0: ["ab"] * 50})
    out = lt.run([Rule("a", Print("E"), File("other.txt"), Print("whole\n"))], table)
    assert lt.output_lines(out).filter("sink = 'stdout'").first().line == "E" * 50
    monkeypatch.setattr("logtrawl.operators.sinks.LINE_BYTES", 49)
    with pytest.raises(ValueError, match="stdout"):
        lt.output_lines(out)
