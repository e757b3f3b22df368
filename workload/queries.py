"""The registered queries: each takes a session and a table folder and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtrawl import (
    Context, Count, Custom, Exit, File, Interval, MaxCount, Print, Regex, Rule, RuleSet, context_lines,
    count_patterns, files_from, files_until, list_logs, list_summary, output_lines, register_action, run, search,
    search_lines, search_table, split_by_size, time_range, with_ts,
)
from logtrawl.functions import template, text, times
from logtrawl.operators import analysis
from logtrawl.operators.match import MATCH_ORDER
from logtrawl.operators.ordered import running_total
from logtrawl.plans.run import occurrences
from logtrawl.sources import catalog as files
from logtrawl.session import materialize
from logtrawl.sources import tables

from .file_queries import FILE_QUERIES

EVENT_TYPES = ["| SIGNUP |", "| PURCHASE |", "| ERROR |", "| VIEW |", "| CLICK |"]
NOW = times.stamp_span("2024-02-01 00:00:00")[0]


# ---- matching -----------------------------------------------------------------------------------------


def search_any(spark: SparkSession, sf: str) -> DataFrame:
    found = search_lines(tables.document_log(spark, sf), ["nthe", "tion", "é", ""])
    return found.selectExpr("file_rank AS doc_id", "lineno", "line")


def search_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    found = search(tables.document_log(spark, sf), ["the", "anan", "é", "|"])
    return found.selectExpr("file_rank AS doc_id", "lineno", "pattern", "occurrence", "match_pos", "match_end")


def search_order(spark: SparkSession, sf: str) -> DataFrame:
    found = search(tables.document_log(spark, sf), ["nthe", "the", "he", "e"])
    ranked = running_total(found, {"match_no": "1L"}, MATCH_ORDER, across_files=False)
    return ranked.selectExpr("file_rank AS doc_id", "match_no", "pattern", "lineno", "match_pos")


def search_pattern_table(spark: SparkSession, sf: str) -> DataFrame:
    words = spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr("explode(split(text, '[ \\t\\n\\r]+')) AS pattern")
    found = search_table(tables.document_log(spark, sf), words)
    return found.selectExpr("file_rank AS doc_id", "pattern", "match_pos", "occurrence").groupBy("doc_id", "pattern").agg(
        F.expr("count(1) AS n"), F.expr("min(match_pos) AS first_pos"), F.expr("max(occurrence) AS top")
    )


def nested_all_of(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of a match and a nested one."""
    found = occurrences([Rule("the", Rule("er", Print()))], tables.document_log(spark, sf))
    return found.selectExpr("file_rank AS doc_id", "pos AS lineno", "ord[0] AS parent_end", "match_pos")


def print_matches(spark: SparkSession, sf: str) -> DataFrame:
    out = run([Rule("| ERROR |", Print()), Rule("user_id=13 ", Print())], tables.event_log(spark, sf))
    return out.select("file_rank", "pos", "sink", "text")


# ---- counts and ordered operators ---------------------------------------------------------------------


def count_rules(spark: SparkSession, sf: str) -> DataFrame:
    return count_patterns(tables.document_log(spark, sf), ["the", "anan", "é", "tion", "no such text"])


def count_nested(spark: SparkSession, sf: str) -> DataFrame:
    rules = [
        Rule("the", Count("the: ${count}\\n"), Rule("er", Count("er in the:\\t${count}"))),
        Rule("no such text", Count("none: ${count}\\n"), Rule("er", Count("below none: ${count}\\n"))),
    ]
    return run(rules, tables.document_log(spark, sf)).select("sink", "text")


def interval_by_rule(spark: SparkSession, sf: str) -> DataFrame:
    found = with_ts(search(tables.event_log(spark, sf), EVENT_TYPES)).drop("line")
    timed = analysis.interval(materialize(found, "found"))
    return timed.selectExpr("event_id", "pattern", "interval_us", f"{times.duration_text('interval_us')} AS shown")


def max_count(spark: SparkSession, sf: str) -> DataFrame:
    found = materialize(search(tables.event_log(spark, sf), EVENT_TYPES).drop("line"), "found")
    return analysis.max_count(found, 100).select("event_id", "pattern")


def exit_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    rules = [Rule("| ERROR |", Print("${match} ${line:-5,}\\n")), Rule("2024-01-20 ", Exit(), Print("end ${time}\\n"))]
    return run(rules, tables.event_log(spark, sf)).select("file_rank", "pos", "text")


def max_count_exit(spark: SparkSession, sf: str) -> DataFrame:
    rules = [
        Rule("| ERROR |", Print("E ${line:,26}\\n"), MaxCount(150, exit=True), Count("errors ${count}\\n")),
        Rule("| VIEW |", Print("V ${line:,26}\\n"), Count("views ${count}\\n")),
    ]
    return run(rules, tables.event_log(spark, sf)).select("file_rank", "pos", "sink", "text")


def nested_max_count(spark: SparkSession, sf: str) -> DataFrame:
    inner = Rule("user_id=1", MaxCount(30), Print("${match/ } ${lineno}\\n"), Count("${count}"))
    rules = [Rule("| ERROR |", MaxCount(200), inner)]
    return run(rules, tables.with_lineno(tables.event_log(spark, sf))).select("file_rank", "text")


def regex_extract(spark: SparkSession, sf: str) -> DataFrame:
    log = tables.event_log(spark, sf)
    user, k = text.capture("line", "user_id=([0-9]+) k=9"), text.capture("line", "k=1[0-9]")
    return log.selectExpr("event_id", f"{user} AS user", f"{k} AS k")


def var_carry(spark: SparkSession, sf: str) -> DataFrame:
    rules = [
        Rule("| ERROR |", Regex("user_id=([0-9]*)", "user")),
        Rule("| PURCHASE |", Regex("k=(9[0-9])", "high"), Print("${user} ${high}\\n")),
    ]
    return run(rules, tables.event_log(spark, sf)).select("file_rank", "pos", "text")


def var_match(spark: SparkSession, sf: str) -> DataFrame:
    rules = [
        Rule("| PURCHASE |", Regex("k=(9[0-9])", "high"), Regex("user_id=([0-9]*)", "user"), Print("${user} ${high}\\n")),
    ]
    return run(rules, tables.event_log(spark, sf), var_scope="match").select("file_rank", "pos", "text")


# ---- time ranges, splitting, context ------------------------------------------------------------------


def cat_range(spark: SparkSession, sf: str) -> DataFrame:
    log = tables.event_log_multi(spark, sf)
    start = times.stamp_span("2024-01-05 06:30:00")[0]
    found = time_range(log, start, times.end_argument("100:15:00", start))
    return found.select("day", "pos", "line")


def cat_continued(spark: SparkSession, sf: str) -> DataFrame:
    """Files cut at any line, so that some begin with lines that go on from the file before."""
    log = tables.event_log_multi(spark, sf).withColumn("file_rank", F.expr("pos div 500"))
    start = times.stamp_span("2024-01-05 06:30:00")[0]
    found = time_range(log, start, times.end_argument("100:15:00", start))
    return found.select("file_rank", "pos", "line")


def cat_split(spark: SparkSession, sf: str) -> DataFrame:
    log = tables.event_log_multi(spark, sf).selectExpr("*", "concat('/logs/app.log-', day, '.gz') AS path")
    return split_by_size(log, 20_000).select("day", "pos", "chunk", "chunk_name")


def context(spark: SparkSession, sf: str) -> DataFrame:
    log = tables.document_log(spark, sf)
    found = context_lines(log, search_lines(log, ["ananth", "|"]), before=2, after=1)
    return found.selectExpr("file_rank AS doc_id", "lineno", "is_hit", "line")


def context_action(spark: SparkSession, sf: str) -> DataFrame:
    log = tables.with_lineno(tables.event_log(spark, sf))
    rules = [Rule("user_id=13 ", Context(before=1, after=2, fmt="${lineno}: ${line:29,}\\n"), Print())]
    return run(rules, log).select("file_rank", "pos", "text")


def line_positions(spark: SparkSession, sf: str) -> DataFrame:
    log = tables.event_log_multi(spark, sf)
    size = "(octet_length(line) + 1L)"
    placed = running_total(log, {"lineno": "1L", "_end": size}, ["pos"], across_files=False)
    return placed.selectExpr("day", "pos", "lineno - 1 AS lineno", f"_end - {size} AS line_offset")


# ---- formats ------------------------------------------------------------------------------------------


def line_slice(spark: SparkSession, sf: str) -> DataFrame:
    log = tables.event_log(spark, sf)
    cuts = {"a": (2, 5), "b": (-3, None), "c": (None, -2), "d": (9, 1), "e": (-500, 500), "f": (-10, -4)}
    return log.selectExpr("event_id", *[f"{text.byte_slice('line', *cut)} AS {name}" for name, cut in cuts.items()])


def byte_sizes(spark: SparkSession, sf: str) -> DataFrame:
    log = tables.document_log(spark, sf)
    return log.selectExpr(
        "file_rank AS doc_id", "lineno", f"bigint(octet_length({text.byte_slice('line', 3, 40)})) AS cut",
        "bigint(octet_length(line)) AS size",
    )


def match_plus(spark: SparkSession, sf: str) -> DataFrame:
    found = search(tables.event_log(spark, sf), ["user_id=", "k="])
    shown = text.match_plus("line", "match_pos", "pattern", 3)
    return found.selectExpr("event_id", "match_pos", f"{shown} AS shown")


def match_until(spark: SparkSession, sf: str) -> DataFrame:
    found = search(tables.event_log(spark, sf), ["user_id=", "k="])
    shown = text.match_until("line", "match_pos", "pattern", " ")
    return found.selectExpr("event_id", "match_pos", f"{shown} AS shown")


def render_format(spark: SparkSession, sf: str) -> DataFrame:
    log = tables.with_lineno(tables.event_log(spark, sf))
    fmt = "${lineno}|${match}|${match+4}|${match/ }|${line:,19}|${line:-4,}|${time}|${none}|\\n"
    return search(log, [" user_id="]).selectExpr("event_id", f"{template.render(fmt)} AS text")


def time_parse(spark: SparkSession, sf: str) -> DataFrame:
    log = tables.event_log_multi(spark, sf)
    heads = {"second": 19, "minute": 16, "day": 10, "part": 22}
    return log.selectExpr(
        "day", "pos", f"{times.line_micros('line')} AS full_us",
        *[f"{times.line_micros(f'left(line, {size})')} AS {name}_us" for name, size in heads.items()],
    )


def time_format(spark: SparkSession, sf: str) -> DataFrame:
    log = tables.event_log(spark, sf)
    return log.selectExpr(
        "event_id", f"{times.micros_to_stamp('ts_us')} AS stamp", f"{times.micros_to_stamp('ts_us', True)} AS fine"
    )


def duration_text(spark: SparkSession, sf: str) -> DataFrame:
    log = tables.event_log(spark, sf)
    gone = f"ts_us - {times.stamp_span('2023-12-30')[0]}L"
    return log.selectExpr("event_id", f"{times.duration_text(gone)} AS shown")


def duration_parts(spark: SparkSession, sf: str) -> DataFrame:
    log = tables.event_log(spark, sf)
    gone = f"ts_us - {times.stamp_span('2020-05-17 01:02:03')[0]}L"
    whole = times.duration_parts(gone)
    some = times.duration_parts(gone, ("month", "hour"))
    return log.selectExpr(
        "event_id", *[f"{v} AS {k}" for k, v in whole.items()], *[f"{v} AS some_{k}" for k, v in some.items()]
    )


def hms_parse(spark: SparkSession, sf: str) -> DataFrame:
    log = tables.event_log(spark, sf)
    shapes = {"full": 8, "minute": 5, "hour": 2}
    return log.selectExpr(
        "event_id", *[f"{times.hms_micros_col(f'substring(line, 12, {n})')} AS {name}_us" for name, n in shapes.items()]
    )


# ---- catalog ------------------------------------------------------------------------------------------


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    return files.describe(tables.event_catalog(spark, sf), "app.log", NOW)


def _listed(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(
        "file_rank", "path", "size_bytes", "unix_micros(first_ts) AS first_us", "unix_micros(rotate_ts) AS rotate_us",
        "hours", "minutes", "seconds", "size_mb", "est_mb",
    )


def catalog_list(spark: SparkSession, sf: str) -> DataFrame:
    return _listed(list_logs(_catalog(spark, sf)))


def catalog_at(spark: SparkSession, sf: str) -> DataFrame:
    return _listed(list_logs(_catalog(spark, sf), at="2024-01-11 03:00:10"))


def catalog_range(spark: SparkSession, sf: str) -> DataFrame:
    return _listed(list_logs(_catalog(spark, sf), start="2024-01-11 03:00:10", end="50:00:00"))


def catalog_month(spark: SparkSession, sf: str) -> DataFrame:
    return _listed(list_logs(_catalog(spark, sf), at="2024-01"))


def catalog_summary(spark: SparkSession, sf: str) -> DataFrame:
    total = list_summary(_catalog(spark, sf))
    return total.selectExpr(
        "unix_micros(first_ts) AS first_us", "unix_micros(last_ts) AS last_us",
        *[c for c in total.columns if c not in ("first_ts", "last_ts")],
    )


def rotate_time(spark: SparkSession, sf: str) -> DataFrame:
    # every page address as the name of a rotated file, some with a dash elsewhere in the path
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    named = pages.selectExpr(
        "page_id",
        "concat('/logs/a-1/', regexp_replace(url, '[^a-z]', ''), '.log', "
        "if(page_id % 3 = 0, '', concat('-20200916-', page_id + 1600317601)), if(page_id % 2 = 0, '.gz', '')) AS path",
    )
    rotated = f"unix_micros({files.rotate_ts('path')})"
    return named.selectExpr(
        "page_id", f"{rotated} AS rotate_us", f"coalesce({times.micros_to_stamp(rotated)}, 'n/a') AS shown"
    )


def _chosen(rows: DataFrame) -> DataFrame:
    return rows.select("file_rank", "path", "size_bytes")


def files_after(spark: SparkSession, sf: str) -> DataFrame:
    return _chosen(files_from(_catalog(spark, sf), times.time_spec("2:weeks", NOW)))


def files_before(spark: SparkSession, sf: str) -> DataFrame:
    return _chosen(files_until(_catalog(spark, sf), times.time_spec("2024-01-20 12:00:00", NOW)))


# ---- rule sets ----------------------------------------------------------------------------------------


def route_sinks(spark: SparkSession, sf: str) -> DataFrame:
    rules = [
        Rule(
            "| ERROR |",
            Count("errors: ${count}\\n"),
            Print(),
            File("errors.log"),
            Print("${match} at ${time}\\n"),
            Rule("user_id=13 ", Print("user 13\\n"), File("user13.log", append=True), Print("${line}\\n")),
            File(stderr=True),
            Print("E"),
        ),
        Rule("| VIEW |", File("views.log"), Print("${line:29,}\\n"), File(stdout=True), Print("v\\n")),
    ]
    return run(rules, tables.event_log(spark, sf)).select("file_rank", "pos", "sink", "text")


def lifecycle_rows(spark: SparkSession, sf: str) -> DataFrame:
    rules = RuleSet(
        [Rule("| SIGNUP |", Print("${line:,19}\\n"), Count("signups ${count}\\n"))],
        on_start=[Print("begin\\n")],
        on_end=[Print("end\\n"), File("end.log"), Print("done\\n")],
        on_file_start=[Print("start ${filename} (${rotate-time})\\n")],
        on_file_end=[Print("stop ${filename}\\n")],
    )
    known = _catalog(spark, sf).withColumn("file_rank", F.expr("file_rank + 19723"))
    return run(rules, tables.event_log(spark, sf), known).select("sink", "text")


def lifecycle_variables(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks that print the variable as it stands when they run."""
    rules = RuleSet(
        [Rule("| ERROR |", Regex("user_id=([[:digit:]]+)", "user"))],
        on_start=[Print("first ${user}\\n")],
        on_end=[Print("last ${user}\\n")],
        on_file_start=[Print("${filename} opens after ${user}\\n")],
        on_file_end=[Print("${filename} closes with ${user}\\n")],
    )
    known = _catalog(spark, sf).withColumn("file_rank", F.expr("file_rank + 19723"))
    return run(rules, tables.event_log(spark, sf), known).select("sink", "text")


def count_many(spark: SparkSession, sf: str) -> DataFrame:
    """A thousand counts in one pass."""
    rules = [Rule(f"user_id={n} ", Count(f"{n}: ${{count}}\\n")) for n in range(1000)]
    return run(rules, tables.event_log(spark, sf)).select("sink", "text")


def output_text(spark: SparkSession, sf: str) -> DataFrame:
    rules = [
        Rule(
            "user_id=1",
            Rule("| ERROR |", Print("ERROR ")),
            Rule("| CLICK |", Print("CLICK "), File("clicks.log"), Print("${match/=}${line:,10}\\n${lineno}\\n")),
            Print("${match/ }: "),
            Print(),
        )
    ]
    return output_lines(run(rules, tables.with_lineno(tables.event_log(spark, sf))))


def _first_field(matches: DataFrame, delimiter: str) -> DataFrame:
    """A custom action: the text between the first two delimiters of the line."""
    return matches.selectExpr("*", f"trim(split_part(line, '{delimiter}', 2)) AS text")


register_action("first_field", _first_field)


def custom_action(spark: SparkSession, sf: str) -> DataFrame:
    rules = [Rule("user_id=13 ", Custom("first_field", {"delimiter": "|"}), Print())]
    return run(rules, tables.event_log(spark, sf)).select("file_rank", "pos", "text")


def many_rules(spark: SparkSession, sf: str) -> DataFrame:
    """More patterns than are tested one by one, with counts and nested rules."""
    error = Rule("| ERROR |", Print("${match} ${line:,10}\\n"))
    rules = [Rule(f"user_id={n} ", Count(f"{n}: ${{count}}\\n"), error) for n in range(100)]
    return run(rules, tables.event_log(spark, sf)).select("file_rank", "text")


def track_entity(spark: SparkSession, sf: str) -> DataFrame:
    """One user's day sheet: pauses between views, a file of purchases with their number, a file of some errors."""
    rules = [
        Rule(
            "user_id=7 ",
            Rule("| VIEW |", Interval("${time} between views\\n")),
            Rule("| PURCHASE |", Count("purchases: ${count}\\n"), File("purchases.txt"), Print("${line:,26} bought, line ${lineno}\\n")),
            Rule("| ERROR |", Rule(" k=1", File("errors.txt"), Print("${line:,10}${match}\\n"))),
        )
    ]
    return run(rules, tables.with_lineno(tables.event_log(spark, sf))).select("file_rank", "pos", "sink", "text")


def posix_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Captures with POSIX character classes."""
    kind, user = text.capture("line", "[|] ([[:upper:]]+) [|]"), text.capture("line", "user_id=([[:digit:]]+)")
    return tables.event_log(spark, sf).selectExpr("pos AS event_id", f"{kind} AS kind", f"{user} AS user_id")


QUERIES = FILE_QUERIES | {
    q.__name__: q
    for q in (
        search_any, search_occurrences, search_order, search_pattern_table, nested_all_of, print_matches,
        count_rules, count_nested, interval_by_rule, max_count, exit_cutoff, max_count_exit, nested_max_count,
        regex_extract, var_carry, var_match, cat_range, cat_continued, cat_split, context, context_action, line_positions,
        line_slice, byte_sizes, match_plus, match_until, render_format, time_parse, time_format, duration_text,
        duration_parts, hms_parse, catalog_list, catalog_at, catalog_range, catalog_month, catalog_summary,
        rotate_time, files_after, files_before, route_sinks, lifecycle_rows, lifecycle_variables,
        count_many, output_text, custom_action,
        many_rules, track_entity, posix_classes,
    )
}
