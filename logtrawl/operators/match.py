"""Finding fixed strings in lines: every occurrence of every pattern, overlapping ones included."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import (
    any_of, byte_chars, byte_len, bytes_text, count_in, pattern_spec, places, sql_text, trie_regex,
)
from ..session import BROADCAST_BYTES, materialize
from .scan import FOUND, Scan, found_in

# Up to this many patterns are tested one by one in generated code. Beyond it one expression for all of them is faster.
INLINE_PATTERNS = 12
# Patterns of a table become one expression up to this size, beyond it they are joined.
PATTERN_BYTES = 1024 * 1024
# Patterns of a larger table are found by grams of so many bytes, in pieces of lines, with a set of so many marks at most.
GRAM, PIECE_BYTES, GRAM_BITS = 4, 1024, 1 << 23
# The rarest gram of a pattern is told from one line of so many.
GRAM_SAMPLE = 32


# Order of matches inside a file: by line, then where the match ends, the longer pattern first.
MATCH_ORDER = ("pos", "match_end", "-match_len")


def check_patterns(patterns: Sequence[str], on_duplicate: str = "error") -> list[str]:
    """Patterns that can match, in order. Duplicates are an error unless the last one is to win."""
    for pattern in patterns:
        if "\n" in pattern:
            raise ValueError(f"a pattern cannot span lines: {pattern!r}")
    usable = [p for p in patterns if p]
    if len(set(usable)) < len(usable):
        if on_duplicate != "last":
            raise ValueError(f"pattern given twice: {sorted(p for p, n in Counter(usable).items() if n > 1)}")
        # the last one keeps its place
        usable = list(dict.fromkeys(reversed(usable)))[::-1]
    return usable


def search_lines(lines: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """The lines that hold at least one pattern. For a few patterns the test reaches the scan as a pushed filter."""
    usable = check_patterns(patterns, on_duplicate="last")
    if len(usable) <= INLINE_PATTERNS:
        return lines.filter(any_of("line", usable))
    return lines.filter(f"{bytes_text('line')} rlike {sql_text(trie_regex([byte_chars(p) for p in usable]))}")


def search(lines: DataFrame, patterns: Sequence[str], on_duplicate: str = "error") -> DataFrame:
    """One row per occurrence: ``pattern, occurrence, match_pos, match_end, match_len`` next to the line.

    ``occurrence`` counts from 0 within line and pattern. Works on batch and streaming lines.
    """
    usable = check_patterns(patterns, on_duplicate)
    size = pattern_size(usable)
    return find(lines, usable).selectExpr(
        *[f"`{c}`" for c in lines.columns], f"{pattern_text(usable)} AS pattern", "occurrence", "match_pos",
        f"match_pos + {size} AS match_end", f"{size} AS match_len",
    )


def find(lines: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Occurrences of checked patterns by number: ``pattern_id, occurrence, match_pos``.

    The patterns are data of one expression, so the plan does not grow with their number.
    """
    if len(patterns) > INLINE_PATTERNS:
        return _find_many(lines, patterns)
    specs = ", ".join(pattern_spec(p, id=n) for n, p in enumerate(patterns))
    hits = (
        f"flatten(transform(filter(array({specs}), spec -> contains(line, spec.text)), spec -> "
        f"transform({places('line', 'spec')}, (at, n) -> "
        "struct(spec.id AS pattern_id, bigint(n) AS occurrence, at AS match_pos))))"
    )
    found = lines.filter(any_of("line", patterns))
    if not patterns:
        return found.selectExpr("*", "0 AS pattern_id", "0L AS occurrence", "0L AS match_pos")
    return found.selectExpr("*", f"inline({hits})")


def pattern_text(patterns: Sequence[str], number: str = "pattern_id") -> str:
    """The pattern of a number; the list is a constant."""
    return f"get(array({', '.join(map(sql_text, patterns)) or chr(39) * 2}), {number})"


def pattern_size(patterns: Sequence[str], number: str = "pattern_id") -> str:
    return f"get(array({', '.join(f'{byte_len(p)}L' for p in patterns) or '0L'}), {number})"


def _find_many(lines: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """One pass over the bytes finds all patterns in all lines of a batch, as one array a line; it is opened at the end,
    where columns that nothing asks for are gone. The work does not depend on the number of patterns."""
    schema = T.StructType([*lines.schema.fields, T.StructField("_found", FOUND)])
    found = found_in(Scan([p.encode("utf-8") for p in patterns]), lines.columns.index("line"), schema)
    return lines.mapInArrow(found, schema).selectExpr(*[f"`{c}`" for c in lines.columns], "inline(_found)")


def count_by_number(lines: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Occurrences of checked patterns, ``pattern_id, n``, of those that occur; summed in the task that finds them.

    Counted are the longest patterns at each place; a pattern has the counts of all that begin with it.
    """
    raw = [byte_chars(p) for p in patterns]
    finder = sql_text(f"(?=({trie_regex(raw)}))")
    found = lines.selectExpr(f"explode(regexp_extract_all({bytes_text('line')}, {finder}, 1)) AS _hit")
    counted = found.groupBy("_hit").agg(F.expr("count(1) AS n"))
    number = {p: n for n, p in enumerate(raw)}
    begun = [(p, number[p[:n]]) for p in raw for n in range(1, len(p) + 1) if p[:n] in number]
    table = lines.sparkSession.createDataFrame(pa.table({"_hit": [b[0] for b in begun], "pattern_id": pa.array([b[1] for b in begun], pa.int32())}))
    return counted.join(table, "_hit").groupBy("pattern_id").agg(F.expr("sum(n) AS n"))


def search_table(lines: DataFrame, patterns: DataFrame, column: str = "pattern") -> DataFrame:
    """Like ``search`` with the patterns of a table (empty and NULL ones never match, duplicates count once).

    The size of the table decides the way, never the result: a small one is sent to every task, a large one
    is joined on the exact text.
    """
    texts = patterns.selectExpr(f"`{column}` AS pattern").filter("octet_length(pattern) > 0").distinct()
    size = texts.selectExpr(
        "count(1) AS n", "coalesce(sum(octet_length(pattern)), 0) AS bytes",
        "coalesce(bool_or(contains(pattern, char(10))), false) AS spans",
    ).first()
    if size.spans:
        raise ValueError("a pattern cannot span lines")
    if size.bytes + 64 * size.n <= PATTERN_BYTES:
        return search(lines, [r.pattern for r in texts.collect()])
    return _search_join(lines, texts)


def _search_join(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """Each pattern is looked for by its rarest gram, and only where a gram of some pattern stands.

    A set of bits of bounded size tells at each byte whether such a gram may stand there. Where one may, the gram is joined with
    those of the patterns and the pattern compared with the line: at once if the patterns are small enough to be sent to
    every task, else when the lines are joined back to the places. How rare a gram is decides the work, never the result.
    """
    kept = [f"`{c}`" for c in lines.columns]
    place = ["file_rank", "block", "pos"]
    chosen = _rarest_grams(lines, texts)
    size = chosen.selectExpr("count(1) AS n", "coalesce(sum(octet_length(_text)), 0) AS bytes", "collect_set(octet_length(_gram)) AS sizes").first()
    if not size.n:
        return search(lines, [])
    placed = _gram_places(lines, sorted(size.sizes)).filter(_may_stand(chosen, size.n))
    start = "match_pos >= 0 AND substring(binary(line), match_pos + 1, octet_length(_text)) = _text"
    small = size.bytes + 64 * size.n <= BROADCAST_BYTES
    found = placed.join(F.broadcast(chosen) if small else chosen, "_gram").selectExpr("*", "_at - _offset AS match_pos")
    if small:
        found = found.filter(start)
    inside = "(PARTITION BY file_rank, block, pos, pattern ORDER BY match_pos)"
    number = f"bigint(row_number() OVER {inside} - 1) AS occurrence"
    found = found.select(*place, "pattern", "match_pos", *([] if small else ["_text"]))
    joined = lines.join(found.selectExpr("*", number), place) if small else lines.join(found, place).filter(start).selectExpr("*", number)
    return joined.selectExpr(
        *kept, "pattern", "occurrence", "bigint(match_pos) AS match_pos",
        "bigint(match_pos + octet_length(pattern)) AS match_end", "bigint(octet_length(pattern)) AS match_len",
    )


def _gram_places(lines: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """``file_rank, block, pos, line, _at, _gram`` of every byte of the lines: the grams of these sizes that begin there.

    Long lines are cut first, so that a gram is never taken out of more than a piece.
    """
    cuts = (
        f"transform(sequence(0, int((octet_length(raw) - 1) div {PIECE_BYTES})), "
        f"n -> struct(n * {PIECE_BYTES} AS _base, substring(raw, n * {PIECE_BYTES} + 1, {PIECE_BYTES + GRAM - 1}) AS _piece))"
    )
    pieces = lines.filter("octet_length(line) > 0").selectExpr(
        "file_rank", "block", "pos", "line", f"inline(transform(array(binary(line)), raw -> {cuts})[0])"
    )
    every = f"explode(sequence(0, least(octet_length(_piece), {PIECE_BYTES}) - 1)) AS _in"
    grams = pieces.selectExpr("*", every)
    grams = grams.selectExpr("*", f"explode(array({', '.join(map(str, sizes))})) AS _size") if len(sizes) > 1 else grams.selectExpr("*", f"{sizes[0]} AS _size")
    return grams.filter("_in + _size <= octet_length(_piece)").selectExpr(
        "file_rank", "block", "pos", "line", "_base + _in AS _at", "substring(_piece, _in + 1, _size) AS _gram"
    )


def _rarest_grams(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """``pattern, _text, _gram, _offset``: of each pattern the gram that some of the lines have least (a shorter pattern is its own)."""
    whole = texts.selectExpr("pattern", "binary(pattern) AS _text")
    grams = whole.selectExpr("*", f"explode(sequence(0, greatest(octet_length(_text) - {GRAM}, 0))) AS _offset").selectExpr(
        "*", f"substring(_text, _offset + 1, {GRAM}) AS _gram"
    )
    some = lines.filter(f"pmod(xxhash64(file_rank, block, pos), {GRAM_SAMPLE}) = 0").select("file_rank", "block", "pos", "line")
    counted = _gram_places(some, [GRAM]).groupBy("_gram").agg(F.expr("count(1) AS n"))
    ranked = grams.join(counted, "_gram", "left").groupBy("pattern").agg(F.expr("min(struct(coalesce(n, 0) AS n, _offset, _gram)) AS best"))
    return materialize(ranked.selectExpr("pattern", "binary(pattern) AS _text", "best._gram AS _gram", "best._offset AS _offset"), "grams")


def _may_stand(chosen: DataFrame, n: int):
    """A test of ``_gram``: one byte of a constant for each remainder of a hash, at most ``GRAM_BITS``."""
    width = min(GRAM_BITS, 1 << max(10, (16 * n - 1).bit_length()))
    slot = f"pmod(xxhash64(_gram), {width})"
    found = chosen.selectExpr(f"int({slot}) AS slot").distinct().toPandas()["slot"].to_numpy()
    marks = np.zeros(width, np.uint8)
    marks[found] = 1
    return F.substring(F.lit(marks.tobytes()), F.expr(f"int({slot}) + 1"), F.lit(1)) == F.lit(b"\x01")


def count_patterns(lines: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Occurrences per pattern, ``pattern, n``, also for a pattern that never occurs.

    One pass and one partial sum per task; no occurrence becomes a row.
    """
    if not patterns:
        return lines.sparkSession.createDataFrame([], "pattern string, n bigint")
    if len(patterns) > INLINE_PATTERNS:
        return _count_many(lines, patterns)
    sums = [f"coalesce(sum({count_in('line', p)}), 0) AS _{i}" for i, p in enumerate(patterns)]
    rows = ", ".join(f"struct({sql_text(p)} AS pattern, _{i} AS n)" for i, p in enumerate(patterns))
    return lines.filter(any_of("line", patterns)).selectExpr(*sums).selectExpr(f"inline(array({rows}))")


def _count_many(lines: DataFrame, patterns: Sequence[str]) -> DataFrame:
    usable = check_patterns(patterns, on_duplicate="last")
    counted = count_by_number(lines, usable).selectExpr(f"{pattern_text(usable)} AS pattern", "n")
    # one row per pattern asked for
    asked = lines.sparkSession.createDataFrame(pa.table([list(patterns)], names=["pattern"]))
    return asked.join(counted, "pattern", "left").selectExpr("pattern", "coalesce(n, 0) AS n")
