"""Search and analysis of large collections of rotated log files on Spark."""

from .functions.text import all_of, any_of
from .operators.match import count_patterns, search, search_lines, search_table
from .operators.select import cat, context_lines, read_chosen, split_by_size, time_range
from .operators.sinks import output_lines, read_output, write_lines, write_output
from .plans.rules import (
    Context, Count, Custom, Exit, File, Interval, MaxCount, Print, Program, Regex, Rule, RuleSet, register_action,
)
from .plans.run import in_order, run
from .plans.waves import files_until_exit
from .sources.catalog import (
    catalog, catalog_of, choose_files, files_from, files_until, kept_catalog, list_logs, list_summary,
)
from .sources.lines import lines_of, read_logs, with_positions, with_ts
from .streaming.arriving import stream_counts, stream_intervals, stream_lines, stream_max_count, stream_search

__all__ = [
    "Context", "Count", "Custom", "Exit", "File", "Interval", "MaxCount", "Print", "Program", "Regex", "Rule",
    "RuleSet", "all_of", "any_of", "cat", "catalog", "catalog_of", "choose_files", "context_lines", "count_patterns",
    "files_from", "files_until", "files_until_exit", "in_order", "kept_catalog", "lines_of", "list_logs", "list_summary",
    "output_lines", "read_chosen", "read_logs", "read_output", "register_action", "run", "search", "search_lines",
    "search_table",
    "split_by_size", "stream_counts", "stream_intervals", "stream_lines", "stream_max_count", "stream_search",
    "time_range", "with_positions", "with_ts", "write_lines", "write_output",
]
