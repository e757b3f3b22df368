"""Log lines as DataFrames.

Every line carries its place: ``file_rank`` (processing order of its file), ``block`` (a stretch of the file
of bounded size), ``pos`` (ascending inside the file) and ``line``. Order is therefore data, never an accident
of partitioning. Operators that need order work per ``(file_rank, block)`` and combine blocks afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..session import BROADCAST_BYTES, materialize
from .catalog import literal_glob, rotate_ts

BLOCK_ROWS = 1 << 20


def lines_of(
    df: DataFrame, line: str = "line", file_rank: str = "file_rank", pos: str = "pos", block_rows: int = BLOCK_ROWS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Any DataFrame of text as log lines, by SQL expressions.

    ``pos`` must ascend inside a file; blocks are ranges of it. ``keep`` are further columns to keep.
    """
    return df.selectExpr(
        f"bigint({file_rank}) AS file_rank", f"bigint({pos}) div {block_rows}L AS block", f"bigint({pos}) AS pos",
        f"{line} AS line", *keep,
    )


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores for a table that is stored in fewer pieces than there are cores; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def read_logs(spark: SparkSession, files, ignore_missing: bool = False) -> DataFrame:
    """Lines of the given files: a catalog, or a list of paths taken in the given order.

    Only ``\\n`` ends a line. Plain files are split into blocks and read in parallel; a ``.gz`` file is one
    task, its lines are then dealt with in blocks of ``BLOCK_ROWS``.
    """
    if isinstance(files, DataFrame):
        chosen = files.select("path", "file_rank", "rotate_ts")
    else:
        ranked = [(_qualified(spark, p), n) for n, p in enumerate(files)]
        chosen = spark.createDataFrame(ranked, "path string, file_rank bigint").selectExpr(
            "path", "file_rank", f"{rotate_ts('path')} AS rotate_ts"
        )
    # the file list is on the driver in any case: the scan lists it there
    rows = chosen.collect()
    if not rows:
        return spark.createDataFrame(
            [], "file_rank bigint, block bigint, pos bigint, line string, path string, rotate_ts timestamp"
        )
    scan = (
        spark.read.option("lineSep", "\n")
        .option("ignoreMissingFiles", ignore_missing)
        .text([literal_glob(r.path) for r in rows])
    )
    if not ignore_missing:
        _all_read([r.path for r in rows], scan.inputFiles())
    scan = (
        scan.selectExpr(
            "value AS line", f"{_plain('_metadata.file_path')} AS path", "_metadata.file_block_start AS _start",
            "monotonically_increasing_id() AS pos",
        )
    )
    table = spark.createDataFrame(rows, chosen.schema)
    if sum(len(r.path) + 64 for r in rows) <= BROADCAST_BYTES:
        table = F.broadcast(table)
    # every line has a file; one that is not in the list must not drop out unseen
    rank = "coalesce(file_rank, raise_error(concat('not in the list of files: ', path)))"
    return scan.join(table, "path", "left").selectExpr(
        f"{rank} AS file_rank", f"if(path LIKE '%.gz', pos div {BLOCK_ROWS}L, _start) AS block", "pos", "line", "path", "rotate_ts"
    )


def _all_read(listed: list[str], read: list[str]) -> None:
    """Fail if the scan passes over a listed file, as it does over names that begin with ``_`` or ``.``."""
    plain = lambda p: re.sub("^([a-z0-9]+):/+", r"\1:/", p)
    found = {plain(p) for p in read} | {plain(unquote(p)) for p in read}
    missing = {p for p in listed if plain(p) not in found}
    if missing:
        raise ValueError(f"{len(missing)} listed files would not be read, such as {min(missing)}")


def _plain(path: str) -> str:
    """The scan reports paths as URIs; file listings, and people, write them plainly."""
    return f"if(contains({path}, '%'), url_decode(replace({path}, '+', '%2B')), {path})"


def _qualified(spark: SparkSession, path: str) -> str:
    """A path spelled as the scan reports it."""
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    return named.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(named).toString()


def with_positions(lines: DataFrame, offset: bool = False) -> DataFrame:
    """Add ``lineno`` (0-based in the file) and, if asked for, ``line_offset`` (byte offset of the line).

    For lines whose ``pos`` is gapless inside a block, as ``read_logs`` makes them. One pass counts the lines
    of each block; numbering itself is then arithmetic and moves no line. Offsets also need a running sum
    inside the blocks, which shuffles the lines by block.
    """
    unit = ["file_rank", "block"]
    counted = materialize(
        lines.selectExpr(*unit, "pos", "octet_length(line) + 1L AS _size")
        .groupBy(*unit)
        .agg(F.expr("min(pos) AS _first"), F.expr("count(1) AS _rows"), F.expr("sum(_size) AS _bytes")),
        "blocks",
    )
    before = "(PARTITION BY file_rank ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    bases = counted.selectExpr(
        *unit, "_first", "_rows", f"coalesce(sum(_rows) OVER {before}, 0) AS _line0", f"coalesce(sum(_bytes) OVER {before}, 0) AS _byte0"
    )
    if counted.count() * 40 <= BROADCAST_BYTES:
        bases = F.broadcast(bases)
    # the two passes must have read the same splits: no line may be lost or misnumbered unseen
    same = "pos - _first BETWEEN 0 AND _rows - 1"
    extra = [f"if({same}, _line0 + pos - _first, raise_error('the lines were split otherwise when they were counted')) AS lineno"]
    if offset:
        inside = "(PARTITION BY file_rank, block ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        extra.append(f"_byte0 + coalesce(sum(octet_length(line) + 1L) OVER {inside}, 0) AS line_offset")
    return lines.join(bases, unit, "left").selectExpr(*[f"`{c}`" for c in lines.columns], *extra)


def with_ts(lines: DataFrame) -> DataFrame:
    """Add ``ts``, the timestamp at the start of the line, NULL if it has none."""
    return lines.selectExpr("*", f"{times.line_ts('line')} AS ts")
