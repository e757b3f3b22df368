"""Fixed-string matching and byte slicing as SQL expressions.

Functions return the text of an expression, for ``selectExpr``, ``filter`` and ``F.expr``; a whole expression
then costs one call from Python. Positions and slices count bytes, 0-based, as log offsets do. Patterns are
fixed strings.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from itertools import groupby
from os.path import commonprefix

_CHUNK = 128


def sql_text(value: str) -> str:
    """A string constant. Text with quotes, escapes or ``$`` (variables in SQL text) is spelled in hex."""
    if re.fullmatch(r"[^'\\$\x00-\x1f]*", value):
        return f"'{value}'"
    return f"string(X'{value.encode('utf-8').hex()}')"


def byte_len(pattern: str) -> int:
    return len(pattern.encode("utf-8"))


def literal_regex(pattern: str) -> str:
    """The pattern as a regular expression that matches exactly it."""
    return "".join("\\" + c if c.isascii() and not c.isalnum() else c for c in pattern)


def bytes_text(line: str) -> str:
    """A line with one character per byte, whatever its encoding: what is cut out of it has byte lengths."""
    return f"decode(binary({line}), 'ISO-8859-1')"


def byte_chars(pattern: str) -> str:
    """A pattern as it stands in ``bytes_text``."""
    return pattern.encode("utf-8").decode("latin-1")


_WIDE = 8
_NESTING = 40


def trie_regex(words: Sequence[str]) -> str:
    """A regular expression for the longest of the words that begins at a place; shared beginnings are tested once.

    Where many words part, the next character first chooses among groups of them. Words that part more than
    ``_NESTING`` times are listed from there on, so neither the making nor the matching nests any deeper.
    """
    return _trie(sorted(set(words)), _NESTING)


def _trie(words: Sequence[str], depth: int) -> str:
    optional = words[0] == ""
    if not depth:
        listed = sorted(words[optional:], key=len, reverse=True)
        return f"(?:{'|'.join(map(literal_regex, listed))})" + "?" * optional
    parted = [(char, list(own)) for char, own in groupby(words[optional:], key=lambda w: w[0])]
    branches = []
    for char, own in parted:
        shared = commonprefix([own[0], own[-1]])
        rest = _trie([w[len(shared):] for w in own], depth - 1) if len(own) > 1 else ""
        branches.append((literal_regex(char), literal_regex(shared) + rest))
    if len(branches) > _WIDE:
        step = math.isqrt(len(branches)) + 1
        groups = [branches[n : n + step] for n in range(0, len(branches), step)]
        tests = [f"(?=[{''.join(char for char, _ in g)}])(?:{'|'.join(b for _, b in g)})" for g in groups]
    else:
        tests = [b for _, b in branches]
    if not optional and len(tests) == 1:
        return tests[0]
    return f"(?:{'|'.join(tests)})" + "?" * optional


def can_overlap(pattern: str) -> bool:
    """Whether two occurrences may share bytes: some start of the pattern is also its end."""
    return any(pattern.startswith(pattern[-n:]) for n in range(1, len(pattern)))


def any_of(line: str, patterns: Sequence[str]) -> str:
    """True where at least one pattern occurs. Empty patterns never match."""
    return "(" + (" OR ".join(f"contains({line}, {sql_text(p)})" for p in patterns if p) or "false") + ")"


def all_of(line: str, patterns: Sequence[str]) -> str:
    """True where every pattern occurs. An empty pattern never matches."""
    if not all(patterns):
        return "(false)"
    return "(" + (" AND ".join(f"contains({line}, {sql_text(p)})" for p in patterns) or "true") + ")"


def count_in(line: str, pattern: str) -> str:
    """Number of occurrences of a pattern in a line, overlapping ones included.

    A pattern that cannot overlap itself is counted by how much shorter the line gets without it; only several
    occurrences of one that can need a regular expression.
    """
    if not pattern:
        return "0L"
    text = sql_text(pattern)
    if can_overlap(pattern):
        regex = sql_text(f"(?={literal_regex(byte_chars(pattern))})")
        hits = f"if(substring_index({line}, {text}, 2) = {line}, 1L, bigint(regexp_count({bytes_text(line)}, {regex})))"
    else:
        hits = f"(octet_length({line}) - octet_length(replace({line}, {text}, ''))) div {byte_len(pattern)}"
    return f"if(contains({line}, {text}), {hits}, 0L)"


def pattern_facts(pattern: str) -> dict:
    """What ``places`` needs to know about a pattern."""
    size = byte_len(pattern)
    bare = not can_overlap(pattern)
    regex = literal_regex(byte_chars(pattern))
    return {
        "text": pattern, "regex": regex if bare else f"(?={regex})", "bare": bare, "start": -size if bare else -1,
        "skip": size if bare else 0, "size": size,
    }


def pattern_spec(pattern: str, **more: int) -> str:
    """The facts of a pattern as a constant struct."""

    def constant(value) -> str:
        if isinstance(value, str):
            return sql_text(value)
        return str(value).lower() if isinstance(value, bool) else f"{value}L"

    fields = [f"'{name}', {value}" for name, value in more.items()]
    fields += [f"'{name}', {constant(value)}" for name, value in pattern_facts(pattern).items()]
    return f"named_struct({', '.join(fields)})"


def places(line: str, spec: str) -> str:
    """Byte offsets of a pattern in a line that holds it, ascending; overlapping ones included.

    The offset of a single occurrence is the length of what stands before it. For several, the line is cut where
    the pattern begins, and the lengths of the cuts are added up. A pattern that may overlap itself is looked for
    without consuming it; an extra byte in front then keeps an occurrence at offset 0 apart (a newline, which no
    pattern holds). The cuts are made in the bytes, so lines in another encoding keep their offsets. Appending to an
    array copies it, so for very many cuts the sums are built chunk by chunk.
    """

    def sums(parts: str, start: str) -> str:
        return (
            f"slice(aggregate({parts}, array({start}), (acc, part) -> "
            f"array_append(acc, element_at(acc, -1) + length(part) + {spec}.skip)), 2, size({parts}))"
        )

    few = sums("slice(cuts, 1, size(cuts) - 1)", f"{spec}.start")
    chunks = (
        f"transform(sequence(0, int((size(cuts) - 2) div {_CHUNK})), "
        f"n -> slice(cuts, n * {_CHUNK} + 1, least({_CHUNK}, size(cuts) - 1 - n * {_CHUNK})))"
    )
    widths = f"transform(chunks, chunk -> aggregate(chunk, 0L, (acc, part) -> acc + length(part) + {spec}.skip))"
    starts = f"aggregate({widths}, array({spec}.start), (acc, width) -> array_append(acc, element_at(acc, -1) + width))"
    many = (
        f"transform(array({chunks}), chunks -> flatten(zip_with(chunks, slice({starts}, 1, size(chunks)), "
        f"(chunk, base) -> {sums('chunk', 'base')})))[0]"
    )
    once = f"substring_index({line}, {spec}.text, 2) = {line}"
    only = f"array(bigint(octet_length(substring_index({line}, {spec}.text, 1))))"
    raw = bytes_text(line)
    cuts = f"split(if({spec}.bare, {raw}, concat(char(10), {raw})), {spec}.regex, -1)"
    several = f"transform(array({cuts}), cuts -> if(size(cuts) <= {_CHUNK}, {few}, {many}))[0]"
    return f"if({once}, {only}, {several})"


def positions(line: str, pattern: str) -> str:
    """Byte offsets of all occurrences of a pattern, an empty array if there are none."""
    if not pattern:
        return "cast(array() as array<bigint>)"
    found = f"transform(array({pattern_spec(pattern)}), spec -> {places(line, 'spec')})[0]"
    return f"if(contains({line}, {sql_text(pattern)}), {found}, cast(array() as array<bigint>))"


def split_lines(value: str) -> str:
    """The pieces of a text between newlines, with their bytes as they are."""
    raw = f"transform(split({bytes_text(value)}, '\\n'), part -> string(encode(part, 'ISO-8859-1')))"
    return f"if(is_valid_utf8({value}), split({value}, '\\n'), {raw})"


# ---- slices -------------------------------------------------------------------------------------------


def byte_slice(line: str, start: int | None = None, end: int | None = None) -> str:
    """Bytes ``start`` (included) to ``end`` (excluded); a negative number counts from the end of the line."""
    if not start and end is None:
        return line
    size = f"octet_length({line})"

    def edge(value: int | None, missing: str) -> str:
        if value is None:
            return missing
        return f"greatest({size} - {-value}, 0)" if value < 0 else f"least({value}, {size})"

    first, last = edge(start, "0"), edge(end, size)
    return f"string(substring(binary({line}), {first} + 1, greatest({last} - {first}, 0)))"


def match_plus(line: str, at: str, pattern: str, more: int) -> str:
    """The match and up to ``more`` bytes after it, within the line. ``pattern`` is an expression."""
    return f"string(substring(binary({line}), int({at} + 1), int(octet_length({pattern}) + {more})))"


def match_until(line: str, at: str, pattern: str, delimiter: str) -> str:
    """The match and what follows it, up to but without the delimiter, or up to the end of the line."""
    rest = f"string(substring(binary({line}), int({at} + octet_length({pattern}) + 1)))"
    return f"concat({pattern}, substring_index({rest}, {sql_text(delimiter)}, 1))"


# POSIX character classes and what Java calls them, fixed names
_CLASSES = {
    "alnum": "Alnum", "alpha": "Alpha", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph",
    "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "xdigit": "XDigit",
}


def java_regex(regex: str) -> str:
    """An extended regular expression for Java: ``[:digit:]`` and its like, as they stand inside brackets."""
    return re.sub(r"\[:([a-z]+):\]", lambda m: f"\\p{{{_CLASSES[m[1]]}}}" if m[1] in _CLASSES else m[0], regex)


def _has_group(regex: str) -> bool:
    """Whether a Java pattern captures anything: a parenthesis outside brackets, not escaped, and plain or named."""
    return re.search(r"\((?!\?)|\(\?<[A-Za-z]", _bare(regex)) is not None


def _bare(regex: str) -> str:
    """A Java pattern without what is quoted, escaped or in brackets."""
    return re.sub(r"\[\^?\]?[^\]]*\]", "", re.sub(r"\\Q.*?\\E|\\.", "", regex, flags=re.DOTALL))


def capture(line: str, regex: str) -> str:
    """First group of the first match (the whole match if the pattern has no group), NULL without a match.

    POSIX classes are understood. The match is the longest of those that begin first, as egrep has it; of several ways
    to match as much, the one that prefers earlier alternatives and longer repeats. A pattern without alternatives and
    repeated groups is matched as it is. Others are matched up to a bound on what is left of the line behind the match,
    which halving makes as small as it can be. Patterns with back references, which egrep lacks, prefer the first alternative.
    """
    regex = java_regex(regex)
    group = 1 if _has_group(regex) else 0
    pattern = sql_text(regex)
    if not re.search(r"\||\)[*+?{]", _bare(regex)) or re.search(r"\\[1-9k]", regex):
        return f"if({line} rlike {pattern}, regexp_extract({line}, {pattern}, {group}), null)"

    def bounded(least: str, most: str) -> str:
        whole = f"(?:{regex})" if group else f"({regex})"
        parts = "'(?s:^.{'", "skipped", sql_text("})" + whole + "(?=(?s:.{"), least, "','", most, sql_text("})\\z)")
        return f"concat({', '.join(parts)})"

    middle = "(span.low + span.high) div 2"
    halved = (
        f"aggregate(sequence(0, int(log2(length({line}) + 1)) + 1), struct(0L AS low, bigint(length({line}) - skipped) AS high), (span, n) -> "
        f"if(span.low < span.high, if({line} rlike {bounded('0', middle)}, "
        f"struct(span.low AS low, {middle} AS high), struct({middle} + 1 AS low, span.high AS high)), span), span -> span.low)"
    )
    start = f"length(regexp_extract({line}, {sql_text(f'^((?s:.*?))(?:{regex})')}, 1))"
    found = f"transform(array({halved}), rest -> regexp_extract({line}, {bounded('rest', 'rest')}, 1))[0]"
    return f"if({line} rlike {pattern}, transform(array({start}), skipped -> {found})[0], null)"
