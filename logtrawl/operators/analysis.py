"""Ordered analysis of matches: intervals, limits and exits. Orders, keys and values are SQL expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from .match import MATCH_ORDER
from .ordered import previous, running_total


def interval(
    matches: DataFrame, order: Sequence[str] = MATCH_ORDER, by: Sequence[str] = ("pattern",), ts: str = "ts",
    name: str = "interval_us",
) -> DataFrame:
    """Microseconds since the previous match of the same rule, in log order and across files.

    Always positive, whichever way the files run. Lines without a timestamp take no part; the first match of a
    rule has no interval and is left out.
    """
    paired = previous(matches.filter(f"{ts} IS NOT NULL"), "_before", f"unix_micros({ts})", order, by)
    return paired.filter("_before IS NOT NULL").selectExpr(
        *[f"`{c}`" for c in matches.columns], f"abs(unix_micros({ts}) - _before) AS {name}"
    )


def max_count(
    matches: DataFrame, n: int, order: Sequence[str] = MATCH_ORDER, by: Sequence[str] = ("pattern",)
) -> DataFrame:
    """The first ``n`` matches per rule in log order; 0 is no limit.

    Each block first keeps at most ``n`` of its own, then the blocks are counted through.
    """
    if n == 0:
        return matches
    inside = f"(PARTITION BY {', '.join([*by, 'file_rank', 'block'])} ORDER BY {', '.join(order)})"
    few = matches.selectExpr("*", f"row_number() OVER {inside} AS _rank").filter(f"_rank <= {n}").drop("_rank")
    return running_total(few, {"_rank": "1L"}, order, by).filter(f"_rank <= {n}").drop("_rank")


def until(rows: DataFrame, triggers: DataFrame, key: str) -> DataFrame:
    """Rows up to and including the first trigger; all rows if there is none.

    ``key`` is a struct that orders rows and triggers alike. The cut is one minimum, read as a scalar.
    """
    cut = triggers.selectExpr(f"min({key}) AS cut").scalar()
    return rows.withColumn("_cut", cut).filter(f"_cut IS NULL OR {key} <= _cut").drop("_cut")
