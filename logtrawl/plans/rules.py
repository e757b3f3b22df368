"""Rules: a fixed string and what to do with each match of it.

    Rule("ERROR", Count("errors: ${count}\\n"),
         Rule(" user_id=", Print("${match/ }\\n")),
         Print())

Actions run in the order given. A rule inside a rule searches the line its parent matched, once per match.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions import template


@dataclass(frozen=True)
class Print:
    """The line and a newline, or a format without one."""

    fmt: str | None = None


@dataclass(frozen=True)
class Regex:
    """Capture from the line into a variable; without a match the variable stays as it is."""

    pattern: str
    var: str


@dataclass(frozen=True)
class Count:
    """Number of matches, printed at the end, also when it is 0."""

    fmt: str
    sink: str = "stdout"


@dataclass(frozen=True)
class Interval:
    """Time since the previous match of the rule."""

    fmt: str


@dataclass(frozen=True)
class MaxCount:
    """The rule acts on its first ``n`` matches only; with ``exit`` the run ends after the last of them."""

    n: int
    exit: bool = False


@dataclass(frozen=True)
class File:
    """Where later actions of the same rule write to."""

    name: str | None = None
    append: bool = False
    stdout: bool = False
    stderr: bool = False

    @property
    def sink(self) -> str:
        return "stdout" if self.stdout else "stderr" if self.stderr else str(self.name)


@dataclass(frozen=True)
class Exit:
    """End the run after the current top-level match."""


@dataclass(frozen=True)
class Context:
    """Print the lines before and after the match, as they are or in a format."""

    before: int = 0
    after: int = 0
    fmt: str | None = None


@dataclass(frozen=True)
class Custom:
    """A registered action, see ``register_action``."""

    name: str
    args: dict = field(default_factory=dict, hash=False)


class Rule:
    def __init__(self, pattern: str, *actions):
        self.pattern = pattern
        self.actions = actions

    def __repr__(self) -> str:
        return f"Rule({self.pattern!r}, {', '.join(map(repr, self.actions))})"


@dataclass(frozen=True)
class RuleSet:
    """Top-level rules and the blocks that run at the start and end of the run and of each file.

    A plain string among the rules prints the lines it occurs in.
    """

    rules: Sequence[Rule | str]
    on_start: Sequence = ()
    on_end: Sequence = ()
    on_file_start: Sequence = ()
    on_file_end: Sequence = ()


Action = Callable[..., DataFrame]
_actions: dict[str, tuple[Action, Action | None]] = {}


def register_action(name: str, action: Action, at_end: Action | None = None) -> None:
    """Add an action: ``action(matches, **args)`` returns the matches with a column ``text`` of any type.

    It gets one row per match with ``line``, ``pattern``, ``match_pos`` and the place of the line, and may drop
    rows. Rows keep their place, so the output stays in order. ``at_end(matches, **args)`` returns rows with a
    ``text`` for the end of the run, usually an aggregate.
    """
    _actions[name] = (action, at_end)


def registered(name: str) -> tuple[Action, Action | None]:
    if name not in _actions:
        raise ValueError(f"unknown action {name!r}")
    return _actions[name]


@dataclass(frozen=True)
class Step:
    """One action of one rule, with what was settled before the run."""

    id: int
    node: int
    index: int
    action: object
    sink: str


@dataclass(frozen=True)
class Node:
    """A rule in its tree: ``index`` is its place among the actions of its parent."""

    id: int
    pattern: str
    parent: int | None
    index: int
    depth: int
    steps: tuple[Step, ...]
    children: tuple[int, ...]
    path: tuple[str, ...]

    def acts(self) -> bool:
        return any(not isinstance(s.action, File) for s in self.steps)


class Program:
    """A validated rule tree, flattened parent first."""

    def __init__(self, rules: RuleSet | Sequence[Rule | str], on_duplicate: str = "error"):
        self.set = rules if isinstance(rules, RuleSet) else RuleSet(list(rules))
        self.nodes: list[Node] = []
        self.roots: list[int] = []
        self._steps = 0
        self._modes: dict[str, bool] = {}
        from ..operators.match import check_patterns

        listed = [Rule(r, Print()) if isinstance(r, str) else r for r in self.set.rules]
        if not all(r.pattern for r in listed):
            raise ValueError("a rule needs a pattern")
        kept = check_patterns([r.pattern for r in listed], on_duplicate)
        chosen = {r.pattern: r for r in listed}
        for pattern in kept:
            self.roots.append(self._add(chosen[pattern], None, 0, 0, ()))
        self.lifecycle = {
            name: self._lifecycle(name, getattr(self.set, name))
            for name in ("on_start", "on_end", "on_file_start", "on_file_end")
        }

    def _add(self, rule: Rule, parent: int | None, index: int, depth: int, path: tuple[str, ...]) -> int:
        if not rule.pattern or "\n" in rule.pattern:
            raise ValueError(f"not a pattern: {rule.pattern!r}")
        node_id = len(self.nodes)
        self.nodes.append(None)  # keeps the place; children are numbered after their parent
        steps, children = [], []
        sink = "stdout"
        for n, action in enumerate(rule.actions):
            if isinstance(action, Rule):
                children.append(self._add(action, node_id, n, depth + 1, (*path, rule.pattern)))
                continue
            sink = self._check(action, sink)
            steps.append(Step(self._steps, node_id, n, action, sink))
            self._steps += 1
        self.nodes[node_id] = Node(
            node_id, rule.pattern, parent, index, depth, tuple(steps), tuple(children), (*path, rule.pattern)
        )
        return node_id

    def _check(self, action, sink: str) -> str:
        if isinstance(action, File):
            if not (action.stdout or action.stderr):
                if not action.name:
                    raise ValueError("File needs a name, stdout or stderr")
                if self._modes.setdefault(action.name, action.append) != action.append:
                    raise ValueError(f"sink {action.name!r} is both appended to and overwritten")
            return action.sink
        if isinstance(action, Count):
            template.pieces(action.fmt, "count")
        elif isinstance(action, Interval):
            template.pieces(action.fmt, "time")
        elif isinstance(action, MaxCount):
            if action.n < 0:
                raise ValueError("MaxCount must not be negative")
        elif isinstance(action, Custom):
            registered(action.name)
        elif not isinstance(action, (Print, Regex, Exit, Context)):
            raise ValueError(f"not an action: {action!r}")
        return sink

    def _lifecycle(self, name: str, actions: Sequence) -> list[tuple[str, str]]:
        """``(sink, format)`` of the prints of a block without a line."""
        prints, sink = [], "stdout"
        for action in actions:
            if isinstance(action, File):
                sink = self._check(action, sink)
            elif isinstance(action, Print) and action.fmt is not None and not template.line_dependent(action.fmt):
                if name in ("on_start", "on_end") and template.needs(action.fmt):
                    raise ValueError(f"{name} has no file: {action.fmt!r}")
                prints.append((sink, action.fmt))
            else:
                raise ValueError(f"{name} cannot run {action!r}: there is no line")
        return prints

    def steps(self, *kinds) -> list[Step]:
        return [s for n in self.nodes for s in n.steps if isinstance(s.action, kinds)]

    def append_sinks(self) -> dict[str, bool]:
        return dict(self._modes)

    def below(self, node_id: int) -> list[int]:
        """The node and everything nested in it."""
        found = [node_id]
        for child in self.nodes[node_id].children:
            found += self.below(child)
        return found

    def line_columns(self) -> list[str]:
        """Optional line columns that some action reads."""
        prints, contexts = self.steps(Print), self.steps(Context)
        found = set()
        for step in (*prints, *contexts):
            reads = template.needs(step.action.fmt)
            # a nested ${offset} is relative to the line and needs no offset in the file
            if isinstance(step.action, Print) and self.nodes[step.node].depth and "${line_offset}" not in (step.action.fmt or ""):
                reads.discard("line_offset")
            found |= reads
        if any(s.action.before or s.action.after for s in contexts):
            found.add("lineno")
        return sorted(found)
