"""Writing: printed texts to their sinks, lines of a time range, chunks."""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_lines
from ..session import materialize
from ..sources.catalog import literal_glob
from .ordered import running_total

LINE_BYTES = 256 * 1024 * 1024  # a line is one value of one row, which cannot be of any size


def output_lines(output: DataFrame) -> DataFrame:
    """Join printed texts to whole lines per sink: ``sink, out_lineno, line``.

    A print without a newline is continued by the next one of the same sink, so a line may have several
    texts. Line numbers come from counting newlines in log order, block by block. A line of more than ``LINE_BYTES``,
    such as all prints of a sink that never ends a line, is refused before it is put together.
    """
    cut = output.selectExpr(
        "file_rank", "block", "pos", "ord", "sink", f"{split_lines('text')} AS _parts"
    ).selectExpr(
        "file_rank", "block", "pos", "ord", "sink", "size(_parts) - 1 AS _last", "posexplode(_parts) AS (piece, part)"
    )
    # counted and then joined: make the texts once
    cut = materialize(cut, "texts")
    numbered = running_total(cut, {"out_lineno": "bigint(piece > 0)"}, ["pos", "ord", "piece"], ["sink"])
    sizes = numbered.selectExpr("sink", "out_lineno", "octet_length(part) AS _n").groupBy("sink", "out_lineno")
    endless = sizes.agg(F.expr("sum(_n) AS _n")).filter(f"_n > {LINE_BYTES}").groupBy().agg(F.expr("min(sink) AS sink")).first()
    if endless.sink is not None:
        raise ValueError(f"sink {endless.sink!r} has a line of more than {LINE_BYTES} bytes: end its prints with a newline")
    joined = numbered.selectExpr(
        "sink", "out_lineno", "struct(file_rank, block, pos, ord, piece, part) AS _piece", "piece < _last AS _ended"
    ).groupBy("sink", "out_lineno").agg(
        F.expr("array_join(transform(sort_array(collect_list(_piece)), p -> p.part), '') AS line"),
        F.expr("bool_or(_ended) AS _ended"),
    )
    return joined.filter("_ended OR line <> ''").drop("_ended")


def write_output(output: DataFrame, directory: str, append: dict[str, bool] | None = None) -> int | None:
    """Write each sink to ``<directory>/sink=<name>/run=<number>-<id>`` as text files in log order; returns the number.

    Runs are numbered, and a list of what a run wrote is its last file, so a run that fails before does not count. Sinks
    are overwritten unless ``append`` says otherwise (``Program.append_sinks``): what earlier runs wrote to them is then deleted.
    """
    spark = output.sparkSession
    number = max((run["number"] for run in _runs(spark, directory)), default=-1) + 1
    folder = f"{number:010d}-{uuid.uuid4().hex[:8]}"
    arranged = output_lines(output).repartitionByRange("sink", "out_lineno").sortWithinPartitions("sink", "out_lineno")
    arranged.select("sink", F.lit(folder).alias("run"), "line").write.mode("append").partitionBy("sink", "run").text(directory)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(directory).getFileSystem(spark._jsc.hadoopConfiguration())
    written = [s.getPath() for s in files.globStatus(path(f"{literal_glob(directory)}/sink=*/run={folder}")) or []]
    if not written:
        return None
    sinks = {p.getParent().getName(): "append" if (append or {}).get(_sink_name(p.getParent().getName())) else "overwrite" for p in written}
    _commit(spark, directory, {"number": number, "folder": f"run={folder}", "sinks": sinks})
    for sink, mode in sinks.items():
        for old in files.listStatus(path(f"{directory}/{sink}")) if mode == "overwrite" else []:
            # runs before this one; one that began later is none of its business
            if old.getPath().getName() < f"run={number:010d}-":
                files.delete(old.getPath(), True)
    return number


def read_output(spark: SparkSession, directory: str) -> DataFrame:
    """What the sinks hold, ``sink, run, part, pos, line``; in this order the lines are as they were written.

    Runs that did not end are left out, and so is what a later run has overwritten.
    """
    held: dict[str, list[tuple[int, str]]] = {}
    for run in sorted(_runs(spark, directory), key=lambda r: r["number"]):
        for sink, mode in run["sinks"].items():
            kept = held.get(sink, []) if mode == "append" else []
            held[sink] = [*kept, (run["number"], f"{directory}/{sink}/{run['folder']}")]
    paths = [place for places in held.values() for _, place in places]
    if not paths:
        return spark.createDataFrame([], "sink string, run bigint, part string, pos bigint, line string")
    plain = "url_decode(replace({0}, '+', '%2B'))"
    # the path is reported as a URI, and the name in it is written as names of folders are
    place = f"regexp_extract({plain.format('_metadata.file_path')}, '/sink=([^/]*)/run=([0-9]+)-[^/]*/([^/]*)$', {{0}})"
    lines = spark.read.option("lineSep", "\n").text([literal_glob(p) for p in paths])
    return lines.selectExpr(
        f"{plain.format(place.format(1))} AS sink", f"bigint({place.format(2)}) AS run",
        f"{place.format(3)} AS part", "monotonically_increasing_id() AS pos", "value AS line",
    )


def _sink_name(folder: str) -> str:
    return unquote(folder.removeprefix("sink="))


def _runs(spark: SparkSession, directory: str) -> list[dict]:
    """The lists of the runs that ended, one small file a run."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(directory).getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in files.globStatus(path(f"{literal_glob(directory)}/_runs/*.json")) or []:
        stream = files.open(status.getPath())
        found.append(json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        stream.close()
    return found


def _commit(spark: SparkSession, directory: str, run: dict) -> None:
    """Put the list of a run in place, whole or not at all; two runs cannot have one number."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(directory).getFileSystem(spark._jsc.hadoopConfiguration())
    made, last = path(f"{directory}/_runs/.{run['folder']}"), path(f"{directory}/_runs/{run['number']:010d}.json")
    stream = files.create(made, True)
    stream.write(bytearray(json.dumps(run).encode()))
    stream.close()
    if files.exists(last) or not files.rename(made, last):
        raise RuntimeError(f"another run wrote to {directory} at the same time")


def write_lines(lines: DataFrame, directory: str, chunk: str | None = None) -> None:
    """Write lines as text in log order; with ``chunk`` one folder per value of that column."""
    place = ["file_rank", "block", "pos"]
    arranged = lines.repartitionByRange(*place).sortWithinPartitions(*([chunk] if chunk else []), *place)
    if chunk:
        arranged.select(chunk, "line").write.partitionBy(chunk).text(directory)
    else:
        arranged.select("line").write.text(directory)
