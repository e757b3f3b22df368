"""Queries over log files that Spark writes from the events table: listed, read, numbered, cut by time, and sinks read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtrawl import (
    Custom, File, Print, Program, Rule, cat, catalog, choose_files, list_logs, read_chosen, read_logs, read_output,
    register_action, run, search, with_positions, write_output,
)
from logtrawl.functions import text, times
from logtrawl.operators.ordered import running_total
from logtrawl.plans.sql import register_log
from logtrawl.session import work_dir
from logtrawl.sources import tables
from logtrawl.sources.catalog import basename

FILE_EVENTS = 500
NOW = times.stamp_span("2024-03-01 00:00:00")[0]


def event_files(spark: SparkSession, sf: str) -> str:
    """The folder of log files of ``FILE_EVENTS`` events each, rotated in the second after their last event, every other one
    compressed, the last one live. A file is one row of events in order, so the folder grows by files, not by their size."""
    root = f"{work_dir(spark)}/logtrawl/event-files-{uuid.uuid4().hex}"
    log = tables.event_log(spark, sf).selectExpr("event_id", f"event_id div {FILE_EVENTS} AS part", "ts_us", "line")
    ends = {r.part: r.ends for r in log.groupBy("part").agg(F.expr("max(ts_us) div 1000000 + 1 AS ends")).collect()}  # one row a file
    last = max(ends, default=0)
    dealt = log.repartition("part").sortWithinPartitions("part", "event_id").select("part", "line")
    for codec, own in (("gzip", f"part % 2 = 0 AND part < {last}"), ("none", f"part % 2 = 1 OR part = {last}")):
        dealt.filter(own).write.partitionBy("part").option("compression", codec).text(f"{root}/written-{codec}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(f"{root}/logs/old"))
    for status in files.globStatus(path(f"{root}/written-*/part=*/part-*")):
        part = int(status.getPath().getParent().getName()[5:])
        name = "app.log" if part == last else f"old/app.log-20240201-{ends[part]}" + ".gz" * (part % 2 == 0)
        files.rename(status.getPath(), path(f"{root}/logs/{name}"))
    return f"{root}/logs"


def file_list(spark: SparkSession, sf: str) -> DataFrame:
    listed = list_logs(catalog(spark, event_files(spark, sf), "app.log", NOW))
    return listed.selectExpr(
        "file_rank", f"{basename('path')} AS name", "unix_micros(first_ts) AS first_us", "unix_micros(rotate_ts) AS rotate_us",
        "if(path LIKE '%.gz', null, size_bytes) AS plain_bytes",
    )


def file_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = with_positions(read_logs(spark, catalog(spark, event_files(spark, sf), "app.log", NOW)), offset=True)
    return lines.select("file_rank", "lineno", "line_offset", "line")


def file_cat(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the files, named one by one, cut by time."""
    files = catalog(spark, event_files(spark, sf), "app.log", NOW, first_lines=False)
    paths = [r.path for r in files.filter("file_rank % 2 = 0").orderBy("file_rank").collect()]
    return cat(spark, paths, "2024-01-05 06:30:00", "300:15:00").select("file_rank", "line")


def file_direction(spark: SparkSession, sf: str) -> DataFrame:
    """Backwards from a time, by files and by lines."""
    files = catalog(spark, event_files(spark, sf), "app.log", NOW)
    chosen = choose_files(files, before="2024-01-11 12:00:00", now=NOW)
    lines = read_chosen(spark, files, before="2024-01-11 12:00:00", now=NOW, granularity="line")
    counted = lines.groupBy("file_rank").agg(F.expr("count(1) AS n_lines"), F.expr("max(line) AS last_line"))
    return chosen.select("file_rank", F.expr(f"{basename('path')} AS name")).join(counted, "file_rank", "left")


def file_search(spark: SparkSession, sf: str) -> DataFrame:
    """Rules over compressed and plain files, with the places of matches in their files."""
    lines = with_positions(read_logs(spark, catalog(spark, event_files(spark, sf), "app.log", NOW)), offset=True)
    rules = [Rule(" user_id=1", Print("${match/ } ${offset} ${line_offset} ${lineno}\\n"))]
    return run(rules, lines).select("file_rank", "text")


def sinks_read_back(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs over the events: one sink goes on, the other is written anew."""
    folder = f"{work_dir(spark)}/logtrawl/sinks-{uuid.uuid4().hex}"
    for kind in ("ERROR", "VIEW"):
        rules = [Rule(f"| {kind} |", File("all.log", append=True), Print("${line:,26}\\n"), File("last.log"), Print("${line:29,}\\n"))]
        write_output(run(rules, tables.event_log(spark, sf)), folder, Program(rules).append_sinks())
    lines = read_output(spark, folder)
    order = "(PARTITION BY sink, run ORDER BY part, pos)"
    return lines.selectExpr("sink", "run", f"bigint(row_number() OVER {order}) AS n", "line")


def regex_longest(spark: SparkSession, sf: str) -> DataFrame:
    """Alternatives of which an earlier one matches less."""
    log = tables.event_log(spark, sf)
    shapes = {"digits": "k=([0-9]|[0-9][0-9]|)", "word": "(PUR|PURCHASE|V|VIE|VIEW)( [|]|W)?", "pair": "(user|user_id)(=1|_id=[0-9]+)?", "whole": "event_id=1|event_id=[0-9]+|event"}
    return log.selectExpr("event_id", *[f"{text.capture('line', regex)} AS {name}" for name, regex in shapes.items()])


def last_of_equal_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """A pattern given twice counts once, in its last place; a plain string prints its lines."""
    rules = [Rule("| ERROR |", Print("first\\n")), "| CLICK |", Rule("| ERROR |", Print("${match/ } last\\n"))]
    out = run(rules, tables.event_log(spark, sf), on_duplicate="last")
    found = search(tables.event_log(spark, sf), ["user_id=7 ", "k=7", "user_id=7 "], on_duplicate="last")
    texts = out.selectExpr("pos", "text")
    return texts.unionByName(found.selectExpr("pos", "concat(pattern, ' ', match_pos) AS text"))


def offset_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Places of matches in the file, and in the line for nested rules."""
    log = tables.with_lineno(tables.event_log(spark, sf))
    size = "(octet_length(line) + 1L)"
    placed = running_total(log, {"_end": size}, ["pos"], across_files=False).selectExpr("*", f"_end - {size} AS line_offset").drop("_end")
    rules = [Rule("| VIEW |", Print("${offset} ${line_offset}\\n"), Rule("k=", Print("${offset} ${line_offset}\\n")))]
    return run(rules, placed).select("file_rank", "text")


def _slow(matches: DataFrame, factor: int) -> DataFrame:
    return matches.selectExpr("*", f"length(line) * {factor} AS text").filter(f"pos % {factor} = 0")


def _sum(matches: DataFrame, factor: int) -> DataFrame:
    return matches.agg(F.expr(f"concat('sum ', coalesce(sum(length(line) * {factor}), 0)) AS text"))


register_action("line_sizes", _slow, _sum)


def custom_at_end(spark: SparkSession, sf: str) -> DataFrame:
    """An own action that prints values of its own and one more at the end of the run."""
    return run([Rule("| ERROR |", Custom("line_sizes", {"factor": 3}))], tables.event_log(spark, sf)).selectExpr("file_rank", "pos", "sink", "text")


def sql_search(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences of patterns, in SQL only."""
    register_log(tables.event_log(spark, sf), "sql_search_log")
    return spark.sql(
        """SELECT event_id, pattern, bigint(nth) AS occurrence, place AS match_pos
        FROM (SELECT event_id, pattern, log_places(line, pattern) AS places FROM sql_search_log
              LATERAL VIEW explode(array('user_id=1', '0', '|')) AS pattern)
        LATERAL VIEW posexplode(places) AS nth, place"""
    )


def sql_values(spark: SparkSession, sf: str) -> DataFrame:
    """Pauses between events of a kind and day, and values cut out of their lines, in SQL only."""
    register_log(tables.event_log(spark, sf), "sql_values_log")
    return spark.sql(
        """SELECT event_id, log_stamp(us) AS stamp, log_duration(us - before) AS pause, log_until(line, place, 'user_id=', ' ') AS user,
               log_slice(line, -4, NULL) AS tail, log_slice(line, 11, 16) AS clock
        FROM (SELECT event_id, line, log_us(line) AS us, get(log_places(line, 'user_id='), 0) AS place,
                     lag(log_us(line)) OVER (PARTITION BY day, event_type ORDER BY event_id) AS before FROM sql_values_log)
        WHERE before IS NOT NULL"""
    )


FILE_QUERIES = {
    q.__name__: q
    for q in (
        file_list, file_lines, file_cat, file_direction, file_search, sinks_read_back, regex_longest, last_of_equal_patterns,
        offset_formats, custom_at_end, sql_search, sql_values,
    )
}
