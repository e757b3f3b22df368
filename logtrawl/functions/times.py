"""Timestamps at the start of a log line, durations, and time arguments.

Functions on columns return the text of a SQL expression. Functions on plain text (arguments of a query) run
on the driver and work with microseconds since the epoch, UTC.
"""

from __future__ import annotations

import calendar
import re
from collections.abc import Sequence
from datetime import datetime, timedelta, timezone

from .text import sql_text

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR
WEEK = 7 * DAY
MONTH = 30 * DAY
YEAR = 365 * DAY

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_STAMP = sql_text(r"^\d{4}-\d{2}-\d{1,2}( \d{1,2}(:\d{1,2}(:\d{1,2}(\.\d{1,6})?)?)?)?")


def line_ts(line: str) -> str:
    """Timestamp at byte 0 of a line (``YYYY-MM-DD[ hh[:mm[:ss[.ffffff]]]]``, UTC), NULL if there is none.

    The usual forms, with seconds or microseconds, take one cast. Every other shape goes through the pattern,
    which accepts missing time parts and a fraction of any length.
    """
    usual = f"left({line}, 19) like '____-__-__ __:__:__'"
    width = f"if(substring({line}, 20, 1) = '.', 26, 19)"
    hours = "substring_index(head, ' ', -1)"
    full = (
        "concat(substring_index(head, ' ', 1), ' ', case when not contains(head, ' ') then '00:00:00' "
        f"when not contains(head, ':') then concat({hours}, ':00:00') "
        f"when substring_index(head, ':', 2) = head then concat({hours}, ':00') else {hours} end, 'Z')"
    )
    other = f"transform(array(regexp_extract({line}, {_STAMP}, 0)), head -> try_cast({full} as timestamp))[0]"
    return (
        f"coalesce(if({usual}, try_cast(concat(left({line}, {width}), 'Z') as timestamp), null), "
        f"if(substring({line}, 5, 1) = '-', {other}, null))"
    )


def line_micros(line: str) -> str:
    """``line_ts`` as microseconds since the epoch, NULL if the line has no timestamp."""
    return f"unix_micros({line_ts(line)})"


def micros_to_stamp(micros: str, fraction: bool = False) -> str:
    """Microseconds to ``YYYY-MM-DD hh:mm:ss[.ffffff]``, UTC whatever the session zone is."""
    shape = "yyyy-MM-dd HH:mm:ss.SSSSSS" if fraction else "yyyy-MM-dd HH:mm:ss"
    shown = f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast({micros} / 1000000bd as decimal(18, 6)))"
    return f"date_format({shown}, '{shape}')"


def duration_text(micros: str) -> str:
    """Microseconds as ``Nd Nh Nm Ns Nus``."""
    parts = duration_parts(micros, ("day", "hour", "minute", "second"))
    shown = ", ' ', ".join(f"string({value}), '{'us' if name == 'micro' else name[0]}'" for name, value in parts.items())
    return f"concat({shown})"


_UNITS = {"year": YEAR, "month": MONTH, "day": DAY, "hour": HOUR, "minute": MINUTE, "second": SECOND}


def duration_parts(micros: str, units: Sequence[str] = tuple(_UNITS)) -> dict[str, str]:
    """Peel the asked units off a duration, largest first; what is left over is ``micro``.

    A month is 30 days and a year 365 days.
    """
    unknown = set(units) - set(_UNITS)
    if unknown:
        raise ValueError(f"unknown units: {sorted(unknown)}")
    parts: dict[str, str] = {}
    rest = f"({micros})"
    for unit, size in _UNITS.items():
        if unit in units:
            parts[unit] = f"({rest} div {size}L)"
            rest = f"({rest} % {size}L)"
    parts["micro"] = rest
    return parts


def hms_micros_col(text: str) -> str:
    """``hh[:mm[:ss]]`` as microseconds; a missing part counts as 0."""
    sizes = enumerate((HOUR, MINUTE, SECOND))
    return "(" + " + ".join(
        f"coalesce(try_cast(get(split({text}, ':'), {n}) as bigint), 0L) * {size}L" for n, size in sizes
    ) + ")"


# ---- arguments, on the driver -------------------------------------------------------------------------


def to_micros(moment: datetime) -> int:
    moment = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
    return (moment - _EPOCH) // timedelta(microseconds=1)


def now_micros() -> int:
    return to_micros(datetime.now(timezone.utc))


def hms_micros(text: str) -> int:
    """``hh[:mm[:ss]]`` as microseconds."""
    if not re.fullmatch(r"\d+(:\d+){0,2}", text):
        raise ValueError(f"not a duration (hh:mm:ss): {text!r}")
    return sum(int(p) * size for p, size in zip(text.split(":"), (HOUR, MINUTE, SECOND)))


_SPAN = re.compile(
    r"(\d{4})-(\d{1,2})(?:-(\d{1,2})(?:[ T](\d{1,2})(?::(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,6}))?)?)?)?)?"
)


def stamp_span(text: str) -> tuple[int, int]:
    """Start and width of a possibly partial timestamp.

    ``2020-07`` is the whole of July, ``2020-07-04 03`` one hour, a stamp with a fraction has width 0.
    """
    found = _SPAN.fullmatch(text.strip())
    if not found:
        raise ValueError(f"not a timestamp (YYYY-MM-DD hh:mm:ss): {text!r}")
    year, month, day, hour, minute, second, fraction = found.groups()
    start = to_micros(
        datetime(int(year), int(month), int(day or 1), int(hour or 0), int(minute or 0), int(second or 0))
    )
    if fraction is not None:
        return start + int(fraction.ljust(6, "0")), 0
    if second is not None:
        return start, SECOND
    if minute is not None:
        return start, MINUTE
    if hour is not None:
        return start, HOUR
    if day is not None:
        return start, DAY
    return start, calendar.monthrange(int(year), int(month))[1] * DAY


def time_spec(text: str, now: int | None = None) -> int:
    """``n:days``, ``n:weeks``, ``n:months`` ago, or a timestamp, as microseconds."""
    found = re.fullmatch(r"(\d+):(day|week|mon)[a-z]*", text.strip())
    if found:
        size = {"day": DAY, "week": WEEK, "mon": MONTH}[found.group(2)]
        return (now_micros() if now is None else now) - int(found.group(1)) * size
    return stamp_span(text)[0]


def end_argument(text: str, start: int) -> int:
    """End of a range: a timestamp, or a duration ``hh:mm:ss`` counted from ``start``."""
    if re.fullmatch(r"\d+(:\d+){0,2}", text.strip()):
        return start + hms_micros(text.strip())
    return stamp_span(text)[0]
