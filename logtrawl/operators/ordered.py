"""Ordered state without a global sort.

A log is ordered by file, then by position. Operators such as "the previous match" or "the n-th match" follow
that order over the whole log. A window without partitions would put every row into one task, so they run in
two levels: a window inside each ``(file_rank, block)``, whose size is bounded however large a file or a rule
is, and a second one over a single edge row per block. Very many small files are grouped once more, so that
the last level holds one row per ``FILES_PER_GROUP`` files.

Joining the edge rows back needs no further move of the rows: the window has already placed them by block.

Values and orders are SQL expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILES_PER_GROUP = 1 << 16


def running_total(
    df: DataFrame, amounts: dict[str, str], order: Sequence[str], by: Sequence[str] = (), across_files: bool = True
) -> DataFrame:
    """Add running sums (current row included) in log order."""
    unit = [*by, "file_rank", "block"]
    inside = f"(PARTITION BY {_list(unit)} ORDER BY {_list(order)} ROWS UNBOUNDED PRECEDING)"
    edges = df.selectExpr(*unit, *[f"{a} AS _edge_{n}" for n, a in amounts.items()]).groupBy(*unit).agg(
        *_exprs([f"sum(_edge_{n}) AS _edge_{n}" for n in amounts])
    )
    before = _before(edges, [f"_edge_{n}" for n in amounts], "sum", by, across_files)
    local = df.selectExpr("*", *[f"sum({a}) OVER {inside} AS {n}" for n, a in amounts.items()])
    return local.join(before, unit, "left").selectExpr(
        *_names(df), *[f"{_placed(f'{n} + coalesce(_edge_{n}, 0)')} AS {n}" for n in amounts]
    )


def last_before(blocks: DataFrame, names: Sequence[str]) -> DataFrame:
    """For a table with one row per block: the last value that is not NULL in the rows of all blocks before."""
    return _before(blocks, names, "last", (), True).drop("_placed")


def carry_last(
    df: DataFrame, values: dict[str, str], order: Sequence[str], by: Sequence[str] = (), across_files: bool = True
) -> DataFrame:
    """Add, per value, the last one that is not NULL up to and including the current row."""
    unit = [*by, "file_rank", "block"]
    inside = f"(PARTITION BY {_list(unit)} ORDER BY {_list(order)} ROWS UNBOUNDED PRECEDING)"
    before = _before(_last_edges(df, values, unit, order), [f"_edge_{n}" for n in values], "last", by, across_files)
    local = df.selectExpr("*", *[f"last({v}, true) OVER {inside} AS {n}" for n, v in values.items()])
    return local.join(before, unit, "left").selectExpr(
        *_names(df), *[f"{_placed(f'coalesce({n}, _edge_{n})')} AS {n}" for n in values]
    )


def previous(
    df: DataFrame, name: str, value: str, order: Sequence[str], by: Sequence[str] = (), across_files: bool = True
) -> DataFrame:
    """Add the value of the row before, in log order. The value must not be NULL in any row."""
    unit = [*by, "file_rank", "block"]
    inside = f"(PARTITION BY {_list(unit)} ORDER BY {_list(order)})"
    before = _before(_last_edges(df, {name: value}, unit, order), [f"_edge_{name}"], "last", by, across_files)
    local = df.selectExpr("*", f"lag({value}) OVER {inside} AS {name}")
    return local.join(before, unit, "left").selectExpr(*_names(df), f"{_placed(f'coalesce({name}, _edge_{name})')} AS {name}")


def _last_edges(df: DataFrame, values: dict[str, str], unit: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per block, the last value that is not NULL; ``max_by`` skips rows without a place."""
    rows = df.selectExpr(*unit, f"struct({_list(order)}) AS _place", *[f"{v} AS _edge_{n}" for n, v in values.items()])
    return rows.groupBy(*unit).agg(
        *_exprs([f"max_by(_edge_{n}, if(_edge_{n} IS NULL, null, _place)) AS _edge_{n}" for n in values])
    )


def _before(edges: DataFrame, names: Sequence[str], fold: str, by: Sequence[str], across_files: bool) -> DataFrame:
    """Per block, the fold of the edge rows of all blocks before it."""
    earlier = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

    def folded(name: str) -> str:
        return f"sum({name})" if fold == "sum" else f"last({name}, true)"

    if not across_files:
        span = f"(PARTITION BY {_list([*by, 'file_rank'])} ORDER BY block {earlier})"
        return edges.selectExpr(*by, "file_rank", "block", "true AS _placed", *[f"{folded(n)} OVER {span} AS {n}" for n in names])

    grouped = edges.selectExpr("*", f"file_rank div {FILES_PER_GROUP} AS _group")
    span = f"(PARTITION BY {_list([*by, '_group'])} ORDER BY file_rank, block {earlier})"
    near = grouped.selectExpr(*by, "file_rank", "block", "_group", *[f"{folded(n)} OVER {span} AS {n}" for n in names])
    total = "sum({0})" if fold == "sum" else "max_by({0}, if({0} IS NULL, null, struct(file_rank, block)))"
    totals = grouped.groupBy(*by, "_group").agg(*_exprs([f"{total.format(n)} AS _far{n}" for n in names]))
    # one row per FILES_PER_GROUP files (and rule)
    over = f"(PARTITION BY {_list(by) if by else '1'} ORDER BY _group {earlier})"
    far = totals.selectExpr(*by, "_group", *[f"{folded('_far' + n)} OVER {over} AS _far{n}" for n in names])
    both = "coalesce({0}, 0) + coalesce(_far{0}, 0) AS {0}" if fold == "sum" else "coalesce({0}, _far{0}) AS {0}"
    return near.join(far, [*by, "_group"], "left").selectExpr(
        *by, "file_rank", "block", "true AS _placed", *[both.format(n) for n in names]
    )


def _placed(value: str) -> str:
    """Every block has an edge row; one without means that the rows were read in other blocks the second time."""
    return f"if(_placed, {value}, raise_error('a block without its edge: the input changed between two reads'))"


def _list(parts: Sequence[str]) -> str:
    return ", ".join(parts)


def _names(df: DataFrame) -> list[str]:
    return [f"`{c}`" for c in df.columns]


def _exprs(texts: Sequence[str]):
    return [F.expr(t) for t in texts]
