"""Logs derived from ordinary tables: one table row per log line, or one document per log file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..operators.ordered import running_total
from .lines import lines_of, spread


def document_log(spark: SparkSession, directory: str) -> DataFrame:
    """Each document is a log file, each of its lines a log line."""
    docs = spread(spark.read.parquet(f"{directory}/documents.parquet").select("doc_id", "source", "text"), "doc_id")
    cut = docs.selectExpr("doc_id", "source", "posexplode(split(text, '\\n')) AS (lineno, line)")
    return lines_of(cut, file_rank="doc_id", pos="lineno", keep=["source", "bigint(lineno) AS lineno"])


def event_log(spark: SparkSession, directory: str) -> DataFrame:
    """One line per event in the order the events were recorded, one file per day.

    The event number is the place in the log, so a block is a range of numbers and never grows with a day.
    """
    events = spread(spark.read.parquet(f"{directory}/events.parquet").drop("value"), "event_id")
    line = (
        "concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS'), ' | ', upper(event_type), ' | event_id=', event_id, "
        "' user_id=', user_id, ' k=', coalesce(get_json_object(props, '$.k'), ''))"
    )
    return lines_of(
        # the text is made once: filters on a generated column are not moved before it
        events.selectExpr("event_id", "ts", "event_type", f"explode(array({line})) AS line"),
        file_rank="datediff(ts, date'1970-01-01')",
        pos="event_id",
        keep=["date_format(ts, 'yyyyMMdd') AS day", "unix_micros(timestamp(concat(ts, 'Z'))) AS ts_us", "event_type", "event_id"],
    )


def event_log_multi(spark: SparkSession, directory: str) -> DataFrame:
    """The event log with two lines without a timestamp after every error."""
    frames = ", ".join(f"concat('    at frame{n} event_id=', event_id)" for n in (1, 2))
    cut = event_log(spark, directory).selectExpr(
        "file_rank", "day", "event_id",
        f"posexplode(if(event_type = 'error', array(line, {frames}), array(line))) AS (sub, line)",
    )
    return lines_of(cut, pos="event_id * 3 + sub", keep=["day", "event_id"])


def with_lineno(lines: DataFrame) -> DataFrame:
    """Number the lines of each file from 0, counting through its blocks."""
    numbered = running_total(lines, {"lineno": "1L"}, ["pos"], across_files=False)
    return numbered.selectExpr(*[f"`{c}`" for c in lines.columns], "lineno - 1 AS lineno")


def event_catalog(spark: SparkSession, directory: str) -> DataFrame:
    """Files of the event log: one per day, rotated at midnight, the last day still live."""
    days = event_log(spark, directory).selectExpr("day", "file_rank", "ts_us", "octet_length(line) + 1L AS bytes")
    return days.groupBy("day", "file_rank").agg(
        F.expr("min(ts_us) AS first_us"), F.expr("sum(bytes) AS size_bytes")
    ).selectExpr(
        "day",
        "if(day = max(day) OVER (PARTITION BY 1), '/logs/app.log', "
        f"concat('/logs/old/app.log-', day, '-', (file_rank + 1) * {times.DAY // times.SECOND}L, '.gz')) AS path",
        "size_bytes",
        "timestamp_micros(first_us) AS first_ts",
    )
