"""Rule sets for common tasks, to be used as they are or as models. The texts to look for are arguments."""

from __future__ import annotations

from collections.abc import Sequence

from .rules import Count, Exit, File, Interval, Print, Rule, RuleSet


def tally(texts: Sequence[str], sink: str | None = None) -> RuleSet:
    """Lines that hold each text, to a sink if one is named, and at the end a table of how many occurrences there were."""
    to = [File(sink)] if sink else []
    return RuleSet([Rule(text, Count(f"{text}\\t${{count}}\\n"), *to, Print()) for text in texts])


def pauses(entity: str, steps: dict[str, str]) -> RuleSet:
    """A file for each step of an entity with the times between its occurrences. ``steps`` maps a file to its text."""
    return RuleSet([Rule(entity, *[Rule(text, File(sink), Interval("${time}\\n")) for sink, text in steps.items()])])


def fields_of(entity: str, event: str, fields: Sequence[str], sink: str | None = None) -> RuleSet:
    """For an event of an entity: its ``name=value`` fields up to the next blank, and how often it occurred."""
    values = [Rule(field, *([File(sink)] if sink else []), Print("${match/ }\\n")) for field in fields]
    return RuleSet([Rule(entity, Rule(event, Count(f"{event}: ${{count}}\\n"), *values))])


def first_of(entity: str, event: str) -> RuleSet:
    """Print the first line that holds both texts, and stop."""
    return RuleSet([Rule(entity, Rule(event, Print(), Exit()))])
