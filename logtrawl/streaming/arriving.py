"""Search, counts, intervals and limits over log files as they arrive.

Order on a stream is arrival order: batch by batch, inside a batch by file time and position. That is weaker
than the order of a finished collection, where rotation times rank the files.

Intervals and limits keep one small row per rule between batches, written next to the stream's checkpoint. Each
batch is worked like a finished collection, so a rule that matches in most lines is still spread over blocks
instead of being one state task. The matches of a batch are a table only as long as its sink runs, which must read
its rows before it returns; of the states, the last two stay.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import times
from ..functions.text import any_of, count_in, sql_text
from ..operators.match import MATCH_ORDER, check_patterns, search
from ..operators.ordered import previous, running_total
from ..session import drop, write_table
from ..sources.catalog import literal_glob
from ..sources.lines import BLOCK_ROWS

Sink = Callable[[DataFrame, int], None]


def stream_lines(spark: SparkSession, directory: str, name: str = "", max_files: int | None = None) -> DataFrame:
    """Lines of files whose name starts with ``name``, as they appear below ``directory``."""
    reader = spark.readStream.option("lineSep", "\n").option("pathGlobFilter", f"{literal_glob(name)}*")
    reader = reader.option("recursiveFileLookup", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(directory).selectExpr(
        "value AS line", "_metadata.file_path AS path", "_metadata.file_modification_time AS file_time",
        "_metadata.file_block_start AS block",
    )


def stream_search(lines: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """One row per occurrence, as in a finished collection but without line numbers. Append mode."""
    return search(lines, patterns)


def stream_counts(lines: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Occurrences per pattern so far, ``pattern, n``, also 0. Complete or update mode."""
    wanted = check_patterns(patterns)
    sums = [f"coalesce(sum({count_in('line', p)}), 0) AS _{i}" for i, p in enumerate(wanted)]
    rows = ", ".join(f"struct({sql_text(p)} AS pattern, _{i} AS n)" for i, p in enumerate(wanted))
    return lines.filter(any_of("line", wanted)).agg(*[F.expr(s) for s in sums]).selectExpr(f"inline(array({rows}))")


def stream_intervals(
    lines: DataFrame, patterns: Sequence[str], sink: Sink, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Time since the previous match per pattern, across batches; ``sink(rows, batch_id)`` gets each batch."""

    def step(matches: DataFrame, old: DataFrame):
        timed = matches.selectExpr("*", f"{times.line_ts('line')} AS ts").filter("ts IS NOT NULL")
        paired = previous(timed, "_before", "unix_micros(ts)", MATCH_ORDER, ["pattern"])
        known = paired.join(old.withColumnRenamed("value", "_old"), "pattern", "left")
        rows = known.selectExpr(
            *[f"`{c}`" for c in timed.columns], "abs(unix_micros(ts) - coalesce(_before, _old)) AS interval_us"
        ).filter("interval_us IS NOT NULL")
        place = f"struct(file_rank, block, {', '.join(MATCH_ORDER)})"
        latest = timed.selectExpr("pattern", "unix_micros(ts) AS us", f"{place} AS place").groupBy("pattern").agg(
            F.expr("max_by(us, place) AS value")
        )
        return rows, _replaced(old, latest, "coalesce(value, _old)")

    return _run(lines, patterns, step, sink, checkpoint, trigger)


def stream_max_count(
    lines: DataFrame, patterns: Sequence[str], n: int, sink: Sink, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """The first ``n`` matches per pattern over the whole stream."""

    def step(matches: DataFrame, old: DataFrame):
        counted = running_total(matches, {"_rank": "1L"}, MATCH_ORDER, ["pattern"])
        known = counted.join(old.withColumnRenamed("value", "_old"), "pattern", "left")
        rows = known.filter(f"_rank + coalesce(_old, 0) <= {n}").select(*matches.columns)
        added = matches.groupBy("pattern").agg(F.expr("count(1) AS value"))
        return rows, _replaced(old, added, "coalesce(value, 0) + coalesce(_old, 0)")

    return _run(lines, patterns, step, sink, checkpoint, trigger)


def _replaced(old: DataFrame, new: DataFrame, value: str) -> DataFrame:
    joined = new.join(old.withColumnRenamed("value", "_old"), "pattern", "full")
    return joined.selectExpr("pattern", f"{value} AS value")


def _run(lines, patterns, step, sink: Sink, checkpoint: str, trigger) -> StreamingQuery:
    state = f"{checkpoint}/rules"
    schema = "pattern string, value bigint"

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # a batch that is run again starts from the same state, so it gives the same rows
        old = spark.read.schema(schema).parquet(f"{state}/{batch_id - 1}") if batch_id else spark.createDataFrame([], schema)
        found, path = write_table(search(batch, patterns).selectExpr("*", "monotonically_increasing_id() AS pos"), "batch")
        try:
            rows, new = step(_placed(found), old)
            sink(rows, batch_id)
            new.coalesce(1).write.mode("overwrite").parquet(f"{state}/{batch_id}")
        finally:
            drop(spark, path)
        # this batch may be run again from the state before it; older ones are done for good
        if batch_id > 1:
            drop(spark, f"{state}/{batch_id - 2}")

    writer = lines.writeStream.foreachBatch(each).option("checkpointLocation", f"{checkpoint}/stream")
    return (writer.trigger(**trigger) if trigger else writer).start()


def _placed(matches: DataFrame) -> DataFrame:
    """Give the matches of a batch a place: files by time and path, then blocks, then lines.

    A ``.gz`` file is one split; its matches are dealt with in blocks of ``BLOCK_ROWS``.
    """
    kept = [c for c in matches.columns if c not in ("file_time", "block")]
    # one row per file of the batch
    files = matches.select("path", "file_time").distinct().selectExpr(
        "path", "bigint(row_number() OVER (ORDER BY file_time, path)) AS file_rank"
    )
    block = f"if(path LIKE '%.gz', pos div {BLOCK_ROWS}L, block) AS block"
    return matches.join(files, "path").selectExpr(*[f"`{c}`" for c in kept], block, "file_rank")
