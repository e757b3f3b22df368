"""Running a rule set: one scan of the lines, then the actions on what matched.

The output has one row per printed text, with its place in the log (``file_rank, block, pos``) and inside the
line (``ord``), the ``sink`` and the ``text``. Sorting by the place gives the text as one reader of the log
would print it; nothing is sorted unless asked for.

Which rule has which nested rules and actions is kept as constant arrays in the plan, indexed by rule; plans
therefore do not grow with the rule set.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import template, text, times
from ..functions.text import sql_text
from ..operators import analysis
from ..operators.match import INLINE_PATTERNS, count_by_number, find, pattern_size, pattern_text
from ..operators.ordered import carry_last, running_total
from ..session import materialize, small_side
from .rules import (
    Context, Count, Custom, Exit, Interval, MaxCount, Print, Program, Regex, Rule, RuleSet, Step, registered,
)

PLACE = ("file_rank", "block", "pos", "ord")
_FIRST, _LAST = "-1L", "9223372036854775807L"
_ROOT_KEY = "struct(file_rank, block, pos, slice(ord, 1, 2))"


def run(
    rules: RuleSet | Sequence[Rule | str], lines: DataFrame, files: DataFrame | None = None, var_scope: str = "carry",
    on_duplicate: str = "error",
) -> DataFrame:
    """Run rules over lines.

    ``files`` (a catalog) is needed for blocks at the start and end of files. ``var_scope="carry"`` lets a
    variable keep its value until it is set again, over all rules and files; ``"match"`` looks only at the
    match itself and its parents, which needs no ordered pass.
    """
    if var_scope not in ("carry", "match"):
        raise ValueError("var_scope is carry or match")
    program = Program(rules, on_duplicate)
    _check_columns(program, lines, files)
    if _only_counts(program):
        parts = [_count_texts(program, lines.sparkSession, _counts_by_rule(program, lines))]
        return reduce(DataFrame.unionByName, parts + _lifecycle(program, lines, files, None, None))

    matches = occurrences(program, lines)
    carried = var_scope == "carry" and bool(program.steps(Regex))
    readers = 2 * len(program.steps(Custom)) + bool(program.steps(Print))
    if carried or readers > 1 or program.steps(Count, Interval, MaxCount, Exit, Context):
        # several passes follow: scan the text once
        if not program.steps(Print, Regex, Interval, Context, Custom):
            matches = matches.drop("line")
        matches = materialize(matches, "matches")
    matches, triggers = _limit(program, matches)
    if triggers is not None:
        matches = analysis.until(matches, triggers, _ROOT_KEY)

    parts = [_prints(program, matches, carried), _intervals(program, matches)]
    if program.steps(Count):
        numbers = matches.groupBy("node").agg(F.expr("count(1) AS n"))
        parts.append(_count_texts(program, lines.sparkSession, numbers))
    parts.append(_context(program, matches, lines, carried))
    parts += [_custom(s, program, matches) for s in program.steps(Custom)]
    parts += _lifecycle(program, lines, files, triggers, matches if carried else None)
    parts = [p for p in parts if p is not None]
    if not parts:
        schema = "file_rank bigint, block bigint, pos bigint, ord array<bigint>, sink string, text string"
        return lines.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)


def in_order(output: DataFrame) -> DataFrame:
    return output.orderBy(*PLACE)


def _check_columns(program: Program, lines: DataFrame, files: DataFrame | None) -> None:
    missing = {"file_rank", "block", "pos", "line", *program.line_columns()} - set(lines.columns)
    if missing:
        raise ValueError(f"the rules need the line columns {sorted(missing)} (see with_positions, read_logs)")
    if (program.lifecycle["on_file_start"] or program.lifecycle["on_file_end"]) and files is None:
        raise ValueError("blocks at file start or end need the catalog of files")


# ---- matches ------------------------------------------------------------------------------------------


def occurrences(rules: Program | RuleSet | Sequence[Rule], lines: DataFrame) -> DataFrame:
    """One row per match of every rule of the tree that does something: ``node``, ``ord``, ``match_pos``.

    ``ord`` orders the matches inside a line as nested rules meet them: per level where the match ends, longer
    patterns first, then the place of the nested rule among its parent's actions. A line is opened up only if
    some rule with actions can match in it together with all its parents.
    """
    program = rules if isinstance(rules, Program) else Program(rules)
    kept = ["file_rank", "block", "pos", "line", *program.line_columns()]
    roots = [program.nodes[r] for r in program.roots]
    lines = lines.select(*kept)
    if len(program.nodes) <= INLINE_PATTERNS and not all(r.acts() for r in roots):
        lines = lines.filter(" OR ".join(text.all_of("line", n.path) for n in program.nodes if n.acts()) or "false")
    patterns = [r.pattern for r in roots]
    size = pattern_size(patterns)
    numbers = ", ".join(map(str, program.roots)) or "0"
    nested = sorted({n.pattern for n in program.nodes if n.depth})
    if nested and len(patterns) <= INLINE_PATTERNS:
        lines = _with_places(lines.filter(text.any_of("line", patterns)), nested)
    rows = find(lines, patterns)
    if nested and len(patterns) > INLINE_PATTERNS:
        rows = _with_places(rows, nested)
    rows = rows.selectExpr(
        *kept, *["_places"][: len(nested)], f"get(array({numbers}), pattern_id) AS node",
        f"array(match_pos + {size}, -{size}) AS ord", "match_pos",
    )
    for depth in range(max((n.depth for n in program.nodes), default=0)):
        rows = _open(program, depth, rows, nested)
    idle = [str(n.id) for n in program.nodes if not n.acts()]
    rows = rows.drop("_places")
    return rows.filter(f"node NOT IN ({', '.join(idle)})") if idle else rows


def _with_places(lines: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Where the nested patterns occur, found once per line however many matches will ask for it."""
    specs = ", ".join(map(text.pattern_spec, patterns))
    found = f"if(contains(line, spec.text), {text.places('line', 'spec')}, null)"
    return lines.selectExpr("*", f"transform(array({specs}), spec -> {found}) AS _places")


def _open(program: Program, depth: int, rows: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Add to the matches of one depth the matches of their nested rules, in the same lines."""
    listed = []
    for node in program.nodes:
        own = [program.nodes[c] for c in node.children] if node.depth == depth else []
        fields = ", ".join(
            f"struct({c.id} AS node, {c.index}L AS index, {patterns.index(c.pattern)} AS place, "
            f"{text.byte_len(c.pattern)}L AS size)"
            for c in own
        )
        listed.append(f"array({fields})" if own else "null")
    hit = "struct(child.node AS node, concat(ord, array(child.index, at + child.size, -child.size)) AS ord, at AS match_pos)"
    nested = (
        "flatten(transform(filter(_children, child -> _places[child.place] IS NOT NULL), "
        f"child -> transform(_places[child.place], at -> {hit})))"
    )
    own = "array(struct(node, ord, match_pos))"
    kept = [f"`{c}`" for c in rows.columns if c not in ("node", "ord", "match_pos")]
    return rows.selectExpr("*", f"get(array({', '.join(listed)}), node) AS _children").selectExpr(
        *kept, f"inline(if(_children IS NULL, {own}, concat({own}, {nested})))"
    )


def _only_counts(program: Program) -> bool:
    return bool(program.steps(Count)) and not program.steps(
        Print, Regex, Interval, MaxCount, Exit, Context, Custom
    )


def _counts_by_rule(program: Program, lines: DataFrame) -> DataFrame:
    """Matches per rule when nothing but counts is asked: no match becomes a row.

    A nested rule matches as often as the product of the matches along its path. Beyond a few rules one expression
    finds all patterns; nested rules then are matched as they are for other actions.
    """
    counted = [n for n in program.nodes if n.acts()]
    if len(program.nodes) > INLINE_PATTERNS:
        if any(n.depth for n in program.nodes):
            return occurrences(program, lines).groupBy("node").agg(F.expr("count(1) AS n"))
        # without nested rules a rule has the number of its pattern
        return count_by_number(lines, [n.pattern for n in program.nodes]).withColumnRenamed("pattern_id", "node")
    found = lines.filter(" OR ".join(text.all_of("line", n.path) for n in counted))
    sums = [
        f"coalesce(sum(if({text.all_of('line', n.path)}, {' * '.join(text.count_in('line', p) for p in n.path)}, 0L)), 0) AS _{n.id}"
        for n in counted
    ]
    rows = ", ".join(f"struct({n.id} AS node, _{n.id} AS n)" for n in counted)
    return found.selectExpr(*sums).selectExpr(f"inline(array({rows}))")


def _key(depth: int) -> str:
    """Place of the enclosing match at a depth: the start of ``ord`` up to there."""
    return f"struct(file_rank, block, pos, slice(ord, 1, {2 + 3 * depth}))"


# ---- limits and exits ---------------------------------------------------------------------------------


def _limit(program: Program, matches: DataFrame):
    """Apply match limits from the outside in; return what is left and the matches that end the run."""
    triggers = []
    limits: dict[int, int] = {}
    for step in program.steps(MaxCount):
        if step.action.n:
            limits[step.node] = min(step.action.n, limits.get(step.node, step.action.n))
    ends = {s.node for s in program.steps(MaxCount) if s.action.exit and s.action.n == limits.get(s.node)}
    for depth in sorted({program.nodes[n].depth for n in limits}):
        level = {n: count for n, count in limits.items() if program.nodes[n].depth == depth}
        allowed = ", ".join(f"{level.get(n.id, 0)}L" for n in program.nodes)
        own = matches.filter(f"node IN ({_ids(level)})").select("node", *PLACE)
        inside = "(PARTITION BY node, file_rank, block ORDER BY pos, ord)"
        # a block cannot hold the n-th match beyond its own n-th
        few = own.selectExpr("*", f"row_number() OVER {inside} AS _near").filter(f"_near <= {max(level.values())}")
        ranked = running_total(few.drop("_near"), {"_rank": "1L"}, ["pos", "ord"], ["node"])
        last = ranked.filter(f"_rank = get(array({allowed}), node)").drop("_rank")
        # at most one row per limited rule; written, so that the plan of a depth is not part of the next one's
        last = materialize(last, "limits")
        cuts = last.selectExpr(f"map_from_entries(collect_list(struct(node, {_key(depth)} AS cut))) AS cuts")
        # per node, the limited rule of this depth it is or is nested in
        limited = {inner: outer for outer in level for inner in program.below(outer)}
        outer = ", ".join(str(limited.get(n.id, "null")) for n in program.nodes)
        cut = f"try_element_at(_cuts, get(array({outer}), node))"
        matches = (
            matches.withColumn("_cuts", cuts.scalar())
            .filter(f"{cut} IS NULL OR {_key(depth)} <= {cut}")
            .drop("_cuts")
        )
        if ends & set(level):
            triggers.append(last.filter(f"node IN ({_ids(ends & set(level))})"))
    exits = {s.node for s in program.steps(Exit)}
    if exits:
        triggers.append(matches.filter(f"node IN ({_ids(exits)})").select("node", *PLACE))
    return matches, reduce(DataFrame.unionByName, triggers) if triggers else None


def end_of_run(program: Program, matches: DataFrame) -> DataFrame:
    """The matches that end the run, ``node`` and place; rules must be able to (see ``Exit``)."""
    return _limit(program, matches)[1]


def _ids(numbers) -> str:
    return ", ".join(map(str, sorted(numbers)))


# ---- actions ------------------------------------------------------------------------------------------


def _steps_of(matches: DataFrame, program: Program, steps: Sequence[Step]) -> DataFrame:
    """One row per match and step, ``ord`` extended by the place of the step."""
    chosen = {s.id for s in steps}
    listed = []
    for node in program.nodes:
        own = ", ".join(f"struct({s.id} AS step, {s.index}L AS index)" for s in node.steps if s.id in chosen)
        listed.append(f"array({own})" if own else "null")
    kept = [f"`{c}`" for c in matches.columns if c != "ord"]
    return matches.selectExpr("*", f"inline(get(array({', '.join(listed)}), node))").selectExpr(
        *kept, "concat(ord, array(index)) AS ord", "step"
    )


def _by_step(steps: Sequence[Step], same, make) -> str:
    """An expression that differs by step; steps for which ``same`` is equal share one."""
    groups: dict[object, list[Step]] = {}
    for step in steps:
        groups.setdefault(same(step), []).append(step)
    if len(groups) == 1:
        return make(steps[0])
    cases = [f"WHEN step IN ({_ids(s.id for s in alike)}) THEN {make(alike[0])}" for alike in groups.values()]
    return f"CASE {' '.join(cases)} END"


def _sink(steps: Sequence[Step]) -> str:
    return _by_step(steps, lambda s: s.sink, lambda s: sql_text(s.sink))


def _node_pattern(program: Program) -> str:
    return pattern_text([n.pattern for n in program.nodes], "node")


def _prints(program: Program, matches: DataFrame, carried: bool) -> DataFrame | None:
    prints = program.steps(Print)
    if not prints:
        return None
    used = set().union(*[template.variables(s.action.fmt) for s in prints])
    sets = [s for s in program.steps(Regex) if s.action.var in used]
    names = sorted({s.action.var for s in sets})
    if carried and sets:
        readers = {s.id for s in prints if template.variables(s.action.fmt)}
        rows = _carry_variables(_steps_of(matches, program, [*sets, *prints]), sets, names, readers)
        rows = rows.filter(f"step IN ({_ids(s.id for s in prints)})")
    else:
        rows = _steps_of(matches, program, prints)

    def shown(step: Step) -> str:
        if step.action.fmt is None:
            return "concat(line, char(10))"
        values = {v: f"_var{n}" for n, v in enumerate(names)} if carried else _match_values(program, step)
        return template.render(
            step.action.fmt, _node_pattern(program), nested=program.nodes[step.node].depth > 0, values=values
        )

    def same(step: Step):
        reads = not carried and template.variables(step.action.fmt)
        return step.action.fmt, program.nodes[step.node].depth > 0, step.id if reads else None

    return _output(rows, _sink(prints), _by_step(prints, same, shown))


def _carry_variables(rows: DataFrame, sets: Sequence[Step], names: Sequence[str], readers: set[int]) -> DataFrame:
    """Give every print the variables as set before it. Prints that read none stay out of the ordered pass."""
    values = _captures(sets, {name: f"_var{n}" for n, name in enumerate(names)})
    taking = _ids({s.id for s in sets} | readers)
    ordered = carry_last(rows.filter(f"step IN ({taking})"), values, ["pos", "ord"])
    others = rows.filter(f"step NOT IN ({taking})").selectExpr("*", *[f"string(null) AS {n}" for n in values])
    return ordered.unionByName(others)


def _captures(sets: Sequence[Step], columns: dict[str, str]) -> dict[str, str]:
    """Per column, what the steps that set its variable capture."""
    values = {}
    for name, column in columns.items():
        cases = [
            f"WHEN step = {s.id} THEN {text.capture('line', s.action.pattern)}" for s in sets if s.action.var == name
        ]
        values[column] = f"CASE {' '.join(cases)} END"
    return values


def _match_values(program: Program, step: Step) -> dict[str, str]:
    """Variables as set by the match itself and its parents, the latest first."""
    found: dict[str, list[str]] = {}
    node, before = program.nodes[step.node], step.index
    while node is not None:
        own = [s for s in node.steps if isinstance(s.action, Regex) and s.index < before]
        for s in reversed(own):
            found.setdefault(s.action.var, []).append(text.capture("line", s.action.pattern))
        before = node.index
        node = None if node.parent is None else program.nodes[node.parent]
    return {name: f"coalesce({', '.join(captures)})" for name, captures in found.items()}


def _intervals(program: Program, matches: DataFrame) -> DataFrame | None:
    steps = program.steps(Interval)
    if not steps:
        return None
    rows = _steps_of(matches, program, steps).selectExpr(*PLACE, "step", f"{times.line_ts('line')} AS ts")
    timed = analysis.interval(rows, ["pos", "ord"], by=("step",))
    shown = _by_step(
        steps, lambda s: s.action.fmt, lambda s: template.fill(s.action.fmt, "time", times.duration_text("interval_us"))
    )
    return _output(timed, _sink(steps), shown)


def _count_texts(program: Program, spark, numbers: DataFrame) -> DataFrame:
    """The texts of all counts, also of rules that never matched; ``numbers`` has ``node, n``."""
    # one row per count action of the rule set
    listed = []
    for step in program.steps(Count):
        head, *tail = template.pieces(step.action.fmt, "count")
        listed.append((step.node, step.id, step.action.sink, head, tail[0] if tail else None))
    texts = spark.createDataFrame(listed, "node int, nth bigint, sink string, head string, tail string")
    return texts.join(numbers, "node", "left").selectExpr(
        *_at(_LAST, _LAST, "array(2L, nth)"), "sink",
        "concat(head, coalesce(concat(coalesce(n, 0), tail), '')) AS text",
    )


def _variables(program: Program, matches: DataFrame, steps: Sequence[Step], used: set[str], carried: bool):
    """The rows of steps with a column per variable as set before the step, and the columns by name."""
    sets = [s for s in program.steps(Regex) if s.action.var in used]
    names = sorted({s.action.var for s in sets})
    columns = {v: f"_var{n}" for n, v in enumerate(names)}
    if carried and sets:
        readers = {s.id for s in steps}
        rows = _carry_variables(_steps_of(matches, program, [*sets, *steps]), sets, names, readers)
        return rows.filter(f"step IN ({_ids(readers)})"), columns
    rows = _steps_of(matches, program, steps)
    own = {s.id: _match_values(program, s) for s in steps}
    shown = [f"{_by_step(steps, lambda s: s.id, lambda s: own[s.id].get(v, 'string(null)'))} AS {c}" for v, c in columns.items()]
    return rows.selectExpr("*", *shown), columns


def _context(program: Program, matches: DataFrame, lines: DataFrame, carried: bool) -> DataFrame | None:
    """The lines around matches. All context actions share one join with the lines.

    A variable in a format has the value it had at the match.
    """
    steps = [s for s in program.steps(Context) if s.action.before or s.action.after]
    if not steps:
        return None
    around = {s.id: [n for n in range(-s.action.before, s.action.after + 1) if n] for s in steps}
    listed = [
        f"array({', '.join(f'{n}L' for n in around[i])})" if i in around else "null" for i in range(max(around) + 1)
    ]
    used = set().union(*[template.variables(s.action.fmt) for s in steps])
    rows, values = _variables(program, matches, steps, used, carried)
    wanted = rows.selectExpr(
        *PLACE, "step", "lineno", *values.values(), f"explode(get(array({', '.join(listed)}), step)) AS _near"
    ).selectExpr(
        "file_rank", "lineno + _near AS lineno", "step", "block AS _block", "pos AS _pos",
        "concat(ord, array(_near)) AS ord", *values.values(),
    )
    # the texts of variables have no size that is known beforehand
    wanted = materialize(wanted, "wanted") if values else small_side(wanted, "wanted", 128)
    columns = [c for c in lines.columns if c not in ("file_rank", "lineno", "block", "pos")]
    found = lines.select("file_rank", "lineno", *columns).join(wanted, ["file_rank", "lineno"])

    def shown(step: Step) -> str:
        return "concat(line, char(10))" if step.action.fmt is None else template.render(step.action.fmt, "line", "0L", values=values)

    return found.selectExpr(
        "file_rank", "_block AS block", "_pos AS pos", "ord", f"{_sink(steps)} AS sink",
        f"{_by_step(steps, lambda s: s.action.fmt, shown)} AS text",
    )


def _custom(step: Step, program: Program, matches: DataFrame) -> DataFrame:
    rows = _steps_of(matches, program, [step]).selectExpr("*", f"{_node_pattern(program)} AS pattern")
    rows = rows.drop("step", "node")
    action, at_end = registered(step.action.name)
    printed = _output(action(rows, **step.action.args), sql_text(step.sink), "string(text)")
    if at_end is None:
        return printed
    last = at_end(rows, **step.action.args).selectExpr(
        *_at(_LAST, _LAST, f"array(2L, {step.id}L)"), "'stdout' AS sink", "string(text) AS text"
    )
    return printed.unionByName(last)


def _output(rows: DataFrame, sink: str, shown: str) -> DataFrame:
    return rows.selectExpr(*PLACE, f"{sink} AS sink", f"{shown} AS text")


# ---- start and end blocks -----------------------------------------------------------------------------


def _at(file_rank: str, place: str, order: str) -> list[str]:
    return [f"{file_rank} AS file_rank", f"{place} AS block", f"{place} AS pos", f"{order} AS ord"]


def _file_values(program: Program, matches: DataFrame | None) -> tuple[DataFrame | None, dict[str, str]]:
    """Per file, the last value that its matches give to each variable of the blocks; and the columns by name."""
    used = set().union(*[template.variables(fmt) for prints in program.lifecycle.values() for _, fmt in prints])
    sets = [s for s in program.steps(Regex) if s.action.var in used]
    if matches is None or not sets:
        return None, {}
    columns = {v: f"_var{n}" for n, v in enumerate(sorted({s.action.var for s in sets}))}
    values = _captures(sets, columns)
    rows = _steps_of(matches, program, sets).selectExpr(
        "file_rank", "struct(block, pos, ord) AS _place", *[f"{value} AS {c}" for c, value in values.items()]
    )
    last = rows.groupBy("file_rank").agg(
        *[F.expr(f"max_by({c}, if({c} IS NULL, null, _place)) AS {c}") for c in values]
    )
    return materialize(last, "values"), columns


def _lifecycle(
    program: Program, lines: DataFrame, files: DataFrame | None, triggers, matches: DataFrame | None
) -> list[DataFrame]:
    """The texts of blocks. With ``matches`` a variable has the value last set before the block."""
    parts = []
    set_in, columns = _file_values(program, matches)
    ended = lines.sparkSession.range(1)
    if columns:
        # no keys: one row, also when nothing was set
        ended = set_in.selectExpr(*[f"max_by({c}, if({c} IS NULL, null, file_rank)) AS {c}" for c in columns.values()])
    for name, place in (("on_start", _FIRST), ("on_end", _LAST)):
        source, values = (ended, columns) if name == "on_end" else (lines.sparkSession.range(1), {})
        for n, (sink, fmt) in enumerate(program.lifecycle[name]):
            parts.append(
                source.selectExpr(
                    *_at(place, place, f"array(1L, {n}L)"), f"{sql_text(sink)} AS sink",
                    f"{template.render(fmt, values=values)} AS text",
                )
            )
    if not (program.lifecycle["on_file_start"] or program.lifecycle["on_file_end"]):
        return parts
    read = files.select("file_rank", "path", "rotate_ts")
    if triggers is not None:
        # files after the end of the run are never opened
        cut = triggers.selectExpr("min(file_rank) AS cut").scalar()
        read = read.withColumn("_cut", cut).filter("_cut IS NULL OR file_rank <= _cut").drop("_cut")
    # the start of a file is block 0, its end block 1, after which its values hold
    events = read.selectExpr("*", "explode(array(0L, 1L)) AS block")
    if columns:
        given = {c: f"if(block = 1, _set{c}, null)" for c in columns.values()}
        renamed = set_in.selectExpr("file_rank", *[f"{c} AS _set{c}" for c in columns.values()])
        events = carry_last(events.join(renamed, "file_rank", "left"), given, ["block"])
    for name, block, place in (("on_file_start", 0, _FIRST), ("on_file_end", 1, _LAST)):
        for n, (sink, fmt) in enumerate(program.lifecycle[name]):
            parts.append(
                events.filter(f"block = {block}").selectExpr(
                    *_at("file_rank", place, f"array({n}L)"), f"{sql_text(sink)} AS sink",
                    f"{template.render(fmt, values=columns)} AS text",
                )
            )
    return parts
