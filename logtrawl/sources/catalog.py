"""The catalog: one row per log file of a family, with time span, size and processing order.

Columns: ``log_name, path, size_bytes, is_gz, is_live, first_ts, rotate_ts, key_ts, file_rank``. A family is
the live file plus its rotations, ``<name>.log-YYYYMMDD-<epoch seconds>[.gz]``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..functions.text import sql_text

GZ_RATIO = 20  # assumed size of a .gz file's content, as a multiple of its stored size


def basename(path: str) -> str:
    return f"substring_index({path}, '/', -1)"


def literal_glob(name: str) -> str:
    """A file name or path as a glob that only it fits."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", name)


def rotate_ts(path: str) -> str:
    """Rotation time from the file name: the digits after its last dash, NULL for a live file."""
    digits = f"regexp_extract({basename(path)}, '-([0-9]+)([.]gz)?$', 1)"
    return f"timestamp_seconds(try_cast({digits} AS bigint))"


def catalog(
    spark: SparkSession, root: str, log_name: str, now: int | None = None, first_lines: bool = True
) -> DataFrame:
    """Every file below ``root`` whose base name starts with ``log_name``.

    Listing touches no file content. ``first_lines=False`` leaves ``first_ts`` NULL and opens no file. Spark's readers
    pass over files whose names begin with ``_`` or ``.``; a ``log_name`` of that kind is refused.
    """
    return describe(_listed(spark, root, log_name).drop("changed"), log_name, now, first_lines)


def _listed(spark: SparkSession, root: str, log_name: str) -> DataFrame:
    if log_name.startswith(("_", ".")):
        raise ValueError(f"Spark does not read files whose names begin with {log_name[0]}")
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", literal_glob(log_name) + "*")
        .load(root)
        .selectExpr("path", "length AS size_bytes", "modificationTime AS changed")
    )


def kept_catalog(spark: SparkSession, root: str, log_name: str, store: str, now: int | None = None) -> DataFrame:
    """``catalog`` that keeps the times of first lines in the folder ``store`` between calls.

    Only files that are new, or whose size or time of change is another than before, are opened. Each call that finds any writes a
    new version of the table; the one before stays for readers that still use it, older ones go.
    """
    same = ["path", "size_bytes", "changed"]
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(store).getFileSystem(spark._jsc.hadoopConfiguration())
    whole = [s.getPath().getParent() for s in files.globStatus(place(f"{literal_glob(store)}/version-*/_SUCCESS")) or []]
    versions = sorted(int(p.getName()[8:]) for p in whole)
    schema = "path string, size_bytes bigint, changed timestamp, first_ts timestamp"
    old = spark.read.schema(schema).parquet(literal_glob(f"{store}/version-{versions[-1]}")) if versions else spark.createDataFrame([], schema)
    listed = _listed(spark, root, log_name)
    fresh = listed.join(old.select(*same), same, "left_anti")
    gone = old.select(*same).join(listed, same, "left_anti")
    if not versions or not fresh.isEmpty() or not gone.isEmpty():
        version = versions[-1] + 1 if versions else 0
        opened = _first_lines(fresh).selectExpr(*same, f"{times.line_ts('first_line')} AS first_ts")
        listed.join(old, same).select(*same, "first_ts").unionByName(opened).write.parquet(f"{store}/version-{version}")
        old = spark.read.schema(schema).parquet(literal_glob(f"{store}/version-{version}"))
        for number in versions[:-1]:
            files.delete(place(f"{store}/version-{number}"), True)
    return describe(old.drop("changed"), log_name, now)


def catalog_of(spark: SparkSession, paths: str | Sequence[str], now: int | None = None, first_lines: bool = True) -> DataFrame:
    """The catalog of just these files, taken literally, without their rotations; they keep the order they are given in."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    places = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    stores = [place.getFileSystem(spark._jsc.hadoopConfiguration()) for place in places]
    found = [(str(s.makeQualified(p).toString()), s.getFileStatus(p).getLen(), n) for n, (s, p) in enumerate(zip(stores, places, strict=True))]
    given = spark.createDataFrame(found, "path string, size_bytes bigint, _nth bigint")
    rows = describe(given.drop("_nth"), "", now, first_lines).drop("file_rank", "log_name").join(given.drop("size_bytes"), "path")
    return rows.selectExpr(f"{basename('path')} AS log_name", *[f"`{c}`" for c in rows.columns if c != "_nth"], "_nth AS file_rank")


def describe(files: DataFrame, log_name: str, now: int | None = None, first_lines: bool = True) -> DataFrame:
    """Turn ``path, size_bytes`` rows (``first_ts`` too, where it is known) into catalog rows."""
    known = files.selectExpr(
        f"{sql_text(log_name)} AS log_name", "path", "size_bytes", "path LIKE '%.gz' AS is_gz",
        f"{rotate_ts('path')} AS rotate_ts", *[c for c in files.columns if c == "first_ts"],
    ).selectExpr("*", "rotate_ts IS NULL AS is_live")
    if "first_ts" not in files.columns:
        if first_lines:
            known = _first_lines(known).selectExpr("*", f"{times.line_ts('first_line')} AS first_ts").drop("first_line")
        else:
            known = known.selectExpr("*", "cast(null AS timestamp) AS first_ts")
    return with_order(known, now)


def _first_lines(files: DataFrame) -> DataFrame:
    """Files with ``first_line``: read by the executors where they can open the store themselves, else by Spark's own file
    systems, which only the driver reaches, many at a time."""
    from pyarrow import fs

    store = "regexp_extract(path, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)"
    unknown = []
    for row in files.groupBy(F.expr(f"{store} AS store")).agg(F.min("path").alias("path")).collect():  # one row a kind of store
        try:
            fs.FileSystem.from_uri(_local(row.path))
        except (pa.ArrowException, OSError):
            unknown.append(row.store)
    read = files.mapInPandas(_with_first_line, files.schema.simpleString()[7:-1] + ",first_line:string")
    if not unknown:
        return read
    other = f"{store} IN ({', '.join(map(sql_text, unknown))})"
    heads = _heads(files.sparkSession, [r.path for r in files.filter(other).select("path").collect()])
    table = files.sparkSession.createDataFrame(heads, "path string, first_line string")
    near = files.filter(f"NOT {other}")
    read = near.mapInPandas(_with_first_line, files.schema.simpleString()[7:-1] + ",first_line:string")
    return read.unionByName(files.filter(other).join(table, "path"))


def _heads(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, str]]:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def head(path: str) -> tuple[str, str]:
        place = jvm.org.apache.hadoop.fs.Path(path)
        stream = place.getFileSystem(conf).open(place)
        try:
            codec = codecs.getCodec(place) if path.endswith(".gz") else None
            content = codec.createInputStream(stream) if codec is not None else stream
            first = jvm.org.apache.commons.io.input.BoundedInputStream(content, 64)
            return path, jvm.org.apache.commons.io.IOUtils.toString(first, "ISO-8859-1").split("\n")[0]
        finally:
            stream.close()

    with ThreadPoolExecutor(32) as pool:
        return list(pool.map(head, paths))


def _local(path: str) -> str:
    """Spark writes ``file:/x``, others ``/x``."""
    return path[5:] if re.match(r"file:/(?!/)", path) else path


def _with_first_line(batches):
    """Head of each file, enough to hold a timestamp at byte 0 of its first line."""
    from pyarrow import fs

    for batch in batches:
        heads = []
        for path in batch["path"]:
            store, inner = fs.FileSystem.from_uri(_local(path))
            with store.open_input_stream(inner, compression="gzip" if path.endswith(".gz") else None) as stream:
                heads.append(stream.read(64).split(b"\n")[0].decode("utf-8", "replace"))
        yield batch.assign(first_line=heads)


def with_order(files: DataFrame, now: int | None = None) -> DataFrame:
    """Add ``key_ts`` (rotation time, ``now`` for the live file) and ``file_rank``, oldest first.

    The window spans one row per file, never file content.
    """
    moment = times.now_micros() if now is None else now
    return files.selectExpr("*", f"coalesce(rotate_ts, timestamp_micros({moment}L)) AS key_ts").selectExpr(
        "*", "bigint(row_number() OVER (ORDER BY key_ts, path) - 1) AS file_rank"
    )


def reversed_order(files: DataFrame) -> DataFrame:
    """Newest file first; lines inside a file still ascend."""
    return files.drop("file_rank").selectExpr(
        "*", "bigint(row_number() OVER (ORDER BY key_ts DESC, path DESC) - 1) AS file_rank"
    )


# ---- sizes and listings -------------------------------------------------------------------------------


def size_mb(size: str) -> str:
    return f"{size} div 1000000"


def est_uncompressed_bytes(size: str, is_gz: str) -> str:
    return f"if({is_gz}, {size} * {GZ_RATIO}, null)"


def list_logs(
    files: DataFrame, at: str | None = None, start: str | None = None, end: str | None = None,
    now: int | None = None,
) -> DataFrame:
    """Files in time order with span, duration and size.

    ``at`` keeps the file that contains the moment, ``start``/``end`` the files that overlap the range. A
    partial ``at`` such as ``2020-07`` is a range; ``end`` may be a duration counted from ``start``.
    """
    if at is not None and (start is not None or end is not None):
        raise ValueError("give either at or a range")
    if at is not None:
        moment, width = times.stamp_span(at)
        # a full stamp names one moment, a coarser one the whole day, month, ...
        files = files_at(files, moment) if width <= times.SECOND else files_between(files, moment, moment + width - 1)
    elif start is not None:
        begin, width = times.stamp_span(start)
        until = times.end_argument(end, begin) if end is not None else begin + max(width, 1) - 1
        files = files_between(files, begin, until)
    elif end is not None:
        raise ValueError("end needs a start")
    parts = times.duration_parts("unix_micros(rotate_ts) - unix_micros(first_ts)", ("hour", "minute", "second"))
    return files.selectExpr(
        "file_rank", "path", "first_ts", "rotate_ts", "size_bytes", *[f"{parts[p]} AS {p}s" for p in parts if p != "micro"],
        f"{size_mb('size_bytes')} AS size_mb", f"{size_mb(est_uncompressed_bytes('size_bytes', 'is_gz'))} AS est_mb",
    ).orderBy("file_rank")


def files_at(files: DataFrame, moment: int) -> DataFrame:
    """The files whose span holds the moment; the live file has no end, an unknown beginning excludes nothing."""
    when = f"timestamp_micros({moment}L)"
    return files.filter(f"(first_ts IS NULL OR first_ts <= {when}) AND (rotate_ts IS NULL OR rotate_ts > {when})")


def files_between(files: DataFrame, start: int, end: int) -> DataFrame:
    """The files whose span overlaps ``[start, end]``; an unknown beginning excludes nothing."""
    return files.filter(
        f"(first_ts IS NULL OR first_ts <= timestamp_micros({end}L)) AND key_ts >= timestamp_micros({start}L)"
    )


def list_summary(files: DataFrame) -> DataFrame:
    """One row over all given files: span, duration parts, sizes and file count."""
    total = files.selectExpr(
        "min(first_ts) AS first_ts", "max(key_ts) AS last_ts", "sum(size_bytes) AS size_bytes",
        f"coalesce(sum({est_uncompressed_bytes('size_bytes', 'is_gz')}), 0) AS est_bytes", "count(1) AS files",
    )
    parts = times.duration_parts(
        "unix_micros(last_ts) - unix_micros(first_ts)", ("month", "day", "hour", "minute", "second")
    )
    unit = "if(size_bytes > 1000000000, 1000000000, 1000000)"
    return total.selectExpr(
        "*", *[f"{parts[p]} AS {p}s" for p in parts if p != "micro"], f"size_bytes div {unit} AS size_shown",
        f"est_bytes div {unit} AS est_shown", "if(size_bytes > 1000000000, 'GB', 'MB') AS unit",
    )


# ---- choosing the files a search reads ----------------------------------------------------------------


def files_from(files: DataFrame, moment: int) -> DataFrame:
    """Files that may hold lines at or after the moment, oldest first."""
    return files.filter(f"key_ts > timestamp_micros({moment}L)")


def files_until(files: DataFrame, moment: int) -> DataFrame:
    """Files that may hold lines up to the moment, newest first.

    Everything up to the first file that ends after the moment; no file is opened. A file known to begin
    later is dropped.
    """
    when = f"timestamp_micros({moment}L)"
    kept = files.selectExpr("*", "lag(key_ts) OVER (ORDER BY key_ts, path) AS _before").filter(
        f"(_before IS NULL OR _before <= {when}) AND (first_ts IS NULL OR first_ts <= {when})"
    )
    return reversed_order(kept.drop("_before"))


def choose_files(
    files: DataFrame, before: str | None = None, after: str | None = None, now: int | None = None
) -> DataFrame:
    """Search direction: backwards from ``before``, forwards from ``after``; by default backwards from now."""
    if before is not None and after is not None:
        raise ValueError("give either before or after")
    now = times.now_micros() if now is None else now
    if after is not None:
        return files_from(files, times.time_spec(after, now))
    return files_until(files, times.time_spec(before, now) if before is not None else now)
