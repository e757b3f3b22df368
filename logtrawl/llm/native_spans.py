"""Positions of regular-expression matches with SQL functions only.

Spark tells the texts of all matches and the texts between them, both leftmost and non-overlapping. Running sums of their lengths are
the positions, in code points. The sums are taken in pieces of ``PIECE`` matches, so a text with very many matches
costs in proportion to their number. A span is ``struct<start long, end long, value string>``, its end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 64


def literal(pattern: str) -> str:
    """A raw SQL string."""
    if "'" not in pattern:
        return f"r'{pattern}'"
    return f'r"{pattern}"' if '"' not in pattern else "concat(" + ", \"'\", ".join(f"r'{p}'" for p in pattern.split("'")) + ")"


def with_spans(df: DataFrame, text: str, patterns: dict[str, str], only_if: dict[str, str] | None = None) -> DataFrame:
    """``df`` with a column of spans for each named pattern. ``only_if`` has a cheap SQL test by name: a text that
    fails it holds no match. The text must not be null."""
    only_if = only_if or {}
    cut = {k: f"transform(split({text}, {literal(p)}, -1), x -> cast(char_length(x) as long))" for k, p in patterns.items()}
    df = df.selectExpr("*", *[f"if({only_if[k]}, {e}, array(0L)) as _gap_{k}" if k in only_if else f"{e} as _gap_{k}" for k, e in cut.items()])
    df = df.selectExpr("*", *[f"if(size(_gap_{k}) > 1, regexp_extract_all({text}, {literal(p)}, 0), cast(array() as array<string>)) as _hit_{k}" for k, p in patterns.items()])
    df = df.selectExpr("*", *[f"zip_with(slice(_gap_{k}, 1, size(_hit_{k})), _hit_{k}, (g, m) -> g + char_length(m)) as _step_{k}" for k in patterns])
    piece = f"slice(_step_{{k}}, i * {PIECE} + 1, {PIECE})"
    parts = f"sequence(0, cast(ceil(size(_step_{{k}}) / {PIECE}) as int) - 1)"
    running = "aggregate({over}, array({begin}), (done, x) -> concat(done, array(element_at(done, -1) + x)))"
    totals = f"transform({parts}, i -> aggregate({piece}, 0L, (sum, x) -> sum + x))"
    df = df.selectExpr("*", *[f"if(size(_step_{k}) = 0, array(0L), {running.format(over=totals.format(k=k), begin='0L')}) as _base_{k}" for k in patterns])
    inner = running.format(over=piece, begin="_base_{k}[i]")
    ends = f"flatten(transform({parts}, i -> slice({inner}, 2, {PIECE})))"
    df = df.selectExpr("*", *[f"if(size(_step_{k}) = 0, cast(array() as array<long>), {ends.format(k=k)}) as _end_{k}" for k in patterns])
    spans = "zip_with(_end_{k}, _hit_{k}, (e, m) -> named_struct('start', e - char_length(m), 'end', e, 'value', m)) as {k}"
    df = df.selectExpr("*", *[spans.format(k=k) for k in patterns])
    return df.drop(*[f"_{part}_{k}" for k in patterns for part in ("gap", "hit", "step", "base", "end")])


def joined(columns: dict[str, str]) -> Column:
    """``kind:start:end`` of all spans, by start, then kind in the order of ``columns`` (kind to column), comma-joined."""
    ranked = [f"transform({c}, s -> struct(s.start as start, {i} as rank, '{k}' as kind, s.end as stop))" for i, (k, c) in enumerate(columns.items())]
    text = "transform(array_sort(concat(" + ", ".join(ranked) + ")), s -> concat_ws(':', s.kind, cast(s.start as string), cast(s.stop as string)))"
    return F.array_join(F.expr(text), ",")
