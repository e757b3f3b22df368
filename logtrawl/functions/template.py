"""Print formats, compiled on the driver to one SQL expression."""

from __future__ import annotations

import re
from dataclasses import dataclass

from . import text, times
from .text import sql_text


@dataclass(frozen=True)
class Part:
    """A piece of a format: literal text, or a variable with its arguments."""

    kind: str
    value: str = ""
    start: int | None = None
    end: int | None = None


_VARIABLE = re.compile(r"\$\{([^}]*)\}")
_LINE = re.compile(r"line:(-?\d+)?(?:(,)(-?\d+)?)?")
_FIXED = ("lineno", "offset", "line_offset", "match", "line", "time", "rotate-time", "filename")


def parse_format(fmt: str) -> list[Part]:
    """Cut a print format into parts. ``\\n`` written as two characters is a newline."""
    parts: list[Part] = []
    at = 0
    while at < len(fmt):
        begin = fmt.find("${", at)
        if begin < 0:
            parts.append(_literal(fmt[at:]))
            break
        if begin > at:
            parts.append(_literal(fmt[at:begin]))
        if fmt.startswith("${match/", begin) and len(fmt) > begin + 9 and fmt[begin + 9] == "}":
            # the delimiter may itself be a closing brace
            parts.append(Part("match_until", fmt[begin + 8]))
            at = begin + 10
            continue
        found = _VARIABLE.match(fmt, begin)
        if not found:
            parts.append(_literal(fmt[begin:]))
            break
        parts.append(_variable(found.group(1)))
        at = found.end()
    return parts


def _literal(value: str) -> Part:
    return Part("text", value.replace("\\n", "\n"))


def _variable(name: str) -> Part:
    if name in _FIXED:
        return Part(name)
    sliced = _LINE.fullmatch(name)
    if sliced:
        first, _, last = sliced.groups()
        return Part("line", "", int(first) if first else None, int(last) if last else None)
    more = re.fullmatch(r"match\+(\d+)", name)
    if more:
        return Part("match_plus", "", int(more.group(1)))
    return Part("variable", name)


def needs(fmt: str | None) -> set[str]:
    """The optional line columns a format reads."""
    if fmt is None:
        return set()
    columns = {
        "lineno": "lineno", "offset": "line_offset", "line_offset": "line_offset",
        "rotate-time": "rotate_ts", "filename": "path",
    }
    return {columns[p.kind] for p in parse_format(fmt) if p.kind in columns}


def variables(fmt: str | None) -> set[str]:
    return set() if fmt is None else {p.value for p in parse_format(fmt) if p.kind == "variable"}


def line_dependent(fmt: str) -> bool:
    return any(p.kind not in ("text", "filename", "rotate-time", "variable") for p in parse_format(fmt))


def render(
    fmt: str, pattern: str = "pattern", at: str = "match_pos", nested: bool = False,
    values: dict[str, str] | None = None,
) -> str:
    """The text of a format for a row with ``line`` and whatever else the format names.

    ``pattern`` and ``at`` are expressions: the matched text and its byte offset in the line. In a nested rule
    ``${offset}`` is the offset in the line, otherwise the offset in the file. ``values`` are the expressions
    of variables; a variable without a value prints its name.
    """
    shown = [_render_part(p, pattern, at, nested, values or {}) for p in parse_format(fmt)]
    return f"concat({', '.join(shown)})" if shown else "''"


def _render_part(part: Part, pattern: str, at: str, nested: bool, values: dict[str, str]) -> str:
    if part.kind == "text":
        return sql_text(part.value)
    if part.kind == "lineno":
        return "string(lineno)"
    if part.kind == "offset":
        return f"string({at})" if nested else f"string(line_offset + {at})"
    if part.kind == "line_offset":
        return "string(line_offset)"
    if part.kind == "line":
        return text.byte_slice("line", part.start, part.end)
    if part.kind == "match":
        return pattern
    if part.kind == "match_plus":
        return text.match_plus("line", at, pattern, part.start)
    if part.kind == "match_until":
        return text.match_until("line", at, pattern, part.value)
    if part.kind == "time":
        return f"coalesce(string({times.line_micros('line')}), '0')"
    if part.kind == "filename":
        return "path"
    if part.kind == "rotate-time":
        return f"coalesce({times.micros_to_stamp('unix_micros(rotate_ts)')}, 'n/a')"
    name = sql_text("${" + part.value + "}")
    return f"coalesce({values[part.value]}, {name})" if part.value in values else name


def pieces(fmt: str, name: str) -> list[str]:
    """The literal text before and after ``${name}`` in a ``count`` or ``interval`` format.

    Here ``\\n`` is a newline, ``\\t`` a tab, and a backslash before anything else is dropped.
    """
    found = fmt.split("${" + name + "}")
    if len(found) > 2:
        raise ValueError(f"${{{name}}} may be given once: {fmt!r}")
    return [_escapes(p) for p in found]


def fill(fmt: str, name: str, value: str) -> str:
    """The text of an ``interval`` format around the expression ``value``."""
    found = [sql_text(p) for p in pieces(fmt, name)]
    return found[0] if len(found) == 1 else f"concat({found[0]}, string({value}), {found[1]})"


def _escapes(value: str) -> str:
    known = {"n": "\n", "t": "\t"}
    return re.sub(r"\\(.?)", lambda m: known.get(m.group(1), m.group(1)), value, flags=re.S)
