"""Time ranges of lines, splitting by size, and lines around a match."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..session import BROADCAST_BYTES, materialize, small_side
from ..sources.catalog import basename, catalog_of, choose_files, files_between
from .ordered import last_before, running_total


def time_range(lines: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Lines with a timestamp in ``[start, end]``; a line without one stays with the line before it.

    Times are microseconds; either end may be open. A line at the head of a file goes on from the end of the file
    before; lines that no timestamp precedes in any of the files are left out.
    """
    if start is not None and end is not None and end <= start:
        raise ValueError("the time range is empty")
    return _in_range(lines, start, end, "0L")


def _in_range(lines: DataFrame, start: int | None, end: int | None, stretch: str) -> DataFrame:
    """Times go on from file to file inside a ``stretch`` only.

    A pass over places and times tells which blocks lie inside the range, outside, or across one of its ends. Only the
    lines of the last kind are moved, to find the time that a line without one goes on from.
    """
    low, high = (f"{start}L" if start is not None else "null"), (f"{end}L" if end is not None else "null")
    own = f"if({times.line_micros('line')} IS NULL, null, struct({times.line_micros('line')} AS us, {stretch} AS stretch))"
    times_of = lines.selectExpr("file_rank", "block", "pos", f"{own} AS _at", f"{stretch} AS _own")
    blocks = materialize(_block_kinds(times_of, low, high), "spans")
    kinds = {r.kind: r["count"] for r in blocks.groupBy("kind").count().collect()}  # at most three
    if sum(kinds.values()) * 64 <= BROADCAST_BYTES:
        blocks = F.broadcast(blocks)
    kept = [f"`{c}`" for c in lines.columns]
    same = "coalesce({0}, raise_error('a block without its times: the input changed between two reads'))"
    known = lines.join(blocks, ["file_rank", "block"], "left").withColumn("kind", F.expr(same.format("kind")))
    parts = [known.filter("kind = 'inside'").selectExpr(*kept)]
    if "edge" in kinds:
        inside = "(PARTITION BY file_rank, block ORDER BY pos ROWS UNBOUNDED PRECEDING)"
        stamped = known.filter("kind = 'edge'").selectExpr(*kept, "_in", f"{own} AS _own_at")
        stamped = stamped.selectExpr("*", f"coalesce(last(_own_at, true) OVER {inside}, _in) AS _at")
        wanted = f"_at.stretch = {stretch} AND coalesce(_at.us >= {low}, true) AND coalesce(_at.us <= {high}, true)"
        parts.append(stamped.filter(wanted).selectExpr(*kept))
    return reduce(DataFrame.unionByName, parts)


def _block_kinds(times_of: DataFrame, low: str, high: str) -> DataFrame:
    """Per block, ``kind`` (all its lines are ``inside`` the range, all ``outside``, or it holds an ``edge``) and ``_in``, the
    time that goes on into it. ``times_of`` has a row per line: its place, ``_at`` (time and stretch) and ``_own`` stretch."""
    spans = times_of.groupBy("file_rank", "block").agg(
        F.expr("min(_own) AS _own"), F.expr("min(_at.us) AS _low"), F.expr("max(_at.us) AS _high"),
        F.expr("min_by(_at IS NULL, pos) AS _headless"), F.expr("max_by(_at, if(_at IS NULL, null, pos)) AS _edge_at"),
    )
    # one pass over the lines; what follows has a row per block
    spans = materialize(spans, "times")
    joined = spans.drop("_edge_at").join(last_before(spans, ["_edge_at"]), ["file_rank", "block"], "left")
    # lines before the first time of a block have the time that goes on into it, if it is of the same stretch
    head = "if(_headless AND _edge_at.stretch = _own, _edge_at.us, null)"
    joined = joined.selectExpr(
        "file_rank", "block", "_edge_at AS _in", f"least(_low, {head}) AS _low", f"greatest(_high, {head}) AS _high",
        f"_headless AND {head} IS NULL AS _lost",
    )
    kind = (
        f"CASE WHEN _low IS NULL OR coalesce(_high < {low}, false) OR coalesce(_low > {high}, false) THEN 'outside' "
        f"WHEN _lost OR coalesce(_low < {low}, false) OR coalesce(_high > {high}, false) THEN 'edge' ELSE 'inside' END"
    )
    return joined.selectExpr("file_rank", "block", "_in", f"{kind} AS kind")


def cat(spark, files: DataFrame | str | Sequence[str], start: str, end: str, read=None) -> DataFrame:
    """Lines of a time range from a catalog, or from files that are named one by one and taken literally, in this
    order. ``end`` may be a duration counted from ``start``.

    Only files whose span overlaps the range are read. What goes on from a file that is not read is outside the range.
    """
    from ..sources.lines import read_logs

    begin, _ = times.stamp_span(start)
    until = times.end_argument(end, begin)
    if until <= begin:
        raise ValueError("the time range is empty")
    if not isinstance(files, DataFrame):
        files = catalog_of(spark, files)
    chosen = files_between(files, begin, until)
    lines = (read or read_logs)(spark, chosen)
    # files next to each other, one row per file
    stretches = chosen.selectExpr("file_rank", "file_rank - row_number() OVER (ORDER BY file_rank) AS _stretch")
    joined = lines.join(small_side(stretches, "stretches", 32), "file_rank").select(*lines.columns, "_stretch")
    return _in_range(joined, begin, until, "_stretch").drop("_stretch")


def read_chosen(
    spark, files: DataFrame, before: str | None = None, after: str | None = None, now: int | None = None,
    granularity: str = "file", read=None,
) -> DataFrame:
    """The lines of the files that ``choose_files`` takes, in its order.

    ``granularity="line"`` leaves out the lines of these files on the wrong side of the time; a line without one goes with
    the line before it, in the order of time of the files.
    """
    from ..sources.lines import read_logs

    if granularity not in ("file", "line"):
        raise ValueError("granularity is file or line")
    now = times.now_micros() if now is None else now
    chosen = choose_files(files, before, after, now)
    read = read or read_logs
    if granularity == "file" or (before is None and after is None):
        return read(spark, chosen)
    moment = times.time_spec(after if after is not None else before, now)
    ascending = files.join(chosen.select("path"), "path", "left_semi")
    lines = time_range(read(spark, ascending), moment if after is not None else None, moment if before is not None else None)
    ranks = small_side(chosen.selectExpr("path", "file_rank AS _rank"), "ranks", 256)
    return lines.join(ranks, "path").selectExpr(*["_rank AS file_rank" if c == "file_rank" else f"`{c}`" for c in lines.columns])


def split_by_size(lines: DataFrame, chunk_bytes: int, path: str = "path", order: Sequence[str] = ("pos",)) -> DataFrame:
    """Add ``chunk`` and ``chunk_name`` (``aa-<file>``, ``ab-<file>``, ...), cut at line ends.

    The file in a name is the one the chunk begins in, without ``.gz``.
    """
    if chunk_bytes <= 0:
        raise ValueError("the chunk size must be positive")
    kept = [f"`{c}`" for c in lines.columns]
    size = "bigint(octet_length(line) + 1)"
    # a chunk begins in the file that holds its first byte: one row per file tells which
    whole = lines.selectExpr("file_rank", f"{path} AS _path", f"{size} AS _bytes").groupBy("file_rank").agg(
        F.expr("min(_path) AS _path"), F.expr("sum(_bytes) AS _bytes"), F.expr("0L AS block")
    )
    ended = running_total(materialize(whole, "files"), {"_end": "_bytes"}, ["file_rank"])
    first, last = f"(_end - _bytes + {chunk_bytes - 1}L) div {chunk_bytes}L", f"(_end - 1) div {chunk_bytes}L"
    begun = ended.filter(f"{first} <= {last}").selectExpr("_path", f"explode(sequence({first}, {last})) AS chunk")
    base = "regexp_replace(" + basename("_path") + ", '[.]gz$', '')"
    names = begun.selectExpr("chunk", f"concat({chunk_letters('chunk')}, '-', {base}) AS chunk_name")
    cut = running_total(lines, {"_bytes": size}, list(order)).selectExpr(
        *kept, f"(_bytes - 1) div {chunk_bytes}L AS chunk"
    )
    return cut.join(small_side(names, "chunks", 256), "chunk").selectExpr(*kept, "chunk", "chunk_name")


def chunk_letters(chunk: str) -> str:
    """``aa`` to ``zz``; after those, names grow by ``zz`` in front, so they still sort in order."""
    return (
        f"concat(repeat('zz', int({chunk} div 676)), char(97 + {chunk} % 676 div 26), char(97 + {chunk} % 26))"
    )


def context_lines(lines: DataFrame, hits: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """The hit lines and their neighbours, each line once, marked by ``is_hit``.

    ``hits`` holds the lines asked for, ``lines`` all lines, both with ``file_rank, block`` and ``lineno``. Few wanted
    numbers are sent to where the lines are read. Many hits go with the lines to their blocks, once: a window in
    the block tells which lines are near a hit, and blocks tell their neighbours how far their first and last hit reach.
    """
    if before < 0 or after < 0:
        raise ValueError("before and after must not be negative")
    keys = [c for c in ("file_rank", "block", "lineno") if c in hits.columns]
    hits = materialize(hits.select(*keys).distinct(), "hits")
    if "block" not in keys or hits.count() * (before + after + 1) * 32 <= BROADCAST_BYTES:
        return _numbers_around(lines, hits, before, after)
    return _halo(lines, hits, before, after)


def _numbers_around(lines: DataFrame, hits: DataFrame, before: int, after: int) -> DataFrame:
    wanted = (
        hits.selectExpr("file_rank", "lineno", f"explode(sequence({-before}L, {after}L)) AS _step")
        .selectExpr("file_rank", "lineno + _step AS lineno", "_step = 0 AS is_hit")
        .groupBy("file_rank", "lineno")
        .agg(F.expr("bool_or(is_hit) AS is_hit"))
    )
    wanted = small_side(wanted, "wanted", 32)
    return lines.join(wanted, ["file_rank", "lineno"]).selectExpr(*[f"`{c}`" for c in lines.columns], "is_hit")


def _halo(lines: DataFrame, hits: DataFrame, before: int, after: int) -> DataFrame:
    kept = [f"`{c}`" for c in lines.columns]
    unit = ["file_rank", "block"]
    spans = lines.groupBy(*unit).agg(F.expr("min(lineno) AS _low"), F.expr("max(lineno) AS _high"))
    edges = hits.groupBy(*unit).agg(F.expr("min(lineno) AS _first"), F.expr("max(lineno) AS _last")).join(spans, unit)
    # one row per block, opened to at most before + after numbers
    beyond = (
        f"concat(if(_first - {before} < _low AND _low > 0, sequence(greatest(_first - {before}, 0L), _low - 1), array()), "
        f"if(_last + {after} > _high, sequence(_high + 1, _last + {after}), array()))"
    )
    beyond = small_side(edges.selectExpr("file_rank", f"explode({beyond}) AS lineno", "true AS _beyond").distinct(), "beyond", 32)
    marks = hits.selectExpr(*unit, "lineno", "true AS _mark")
    marked = lines.withColumn("_mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    inside = "(PARTITION BY file_rank, block ORDER BY lineno RANGE BETWEEN"
    near = marked.selectExpr(
        *kept, "_mark", f"max(_mark) OVER {inside} CURRENT ROW AND CURRENT ROW) AS is_hit",
        f"max(_mark) OVER {inside} {after} PRECEDING AND {before} FOLLOWING) AS _near",
    ).filter("NOT _mark")
    return near.join(beyond, ["file_rank", "lineno"], "left").filter("_near OR _beyond").selectExpr(*kept, "is_hit")
