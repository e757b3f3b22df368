"""The value functions for queries written in SQL, and lines as a view.

``register_sql`` makes them functions of the session. Their bodies are the expressions that the library uses itself, so a query
in SQL is planned like one that is built in Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import times
from ..sources.catalog import rotate_ts

_AT = "int(at + octet_length(pattern) + 1)"
_SIZE = "octet_length(line)"
_EDGE = "if({0} < 0, greatest({1} + {0}, 0L), least({0}, {1}))"

#: name: parameters, type, body
FUNCTIONS = {
    "log_us": ("line STRING", "BIGINT", times.line_micros("line")),
    "log_ts": ("line STRING", "TIMESTAMP", times.line_ts("line")),
    "log_stamp": ("us BIGINT", "STRING", times.micros_to_stamp("us")),
    "log_duration": ("us BIGINT", "STRING", times.duration_text("us")),
    "log_rotated": ("path STRING", "TIMESTAMP", rotate_ts("path")),
    "log_places": (
        "line STRING, pattern STRING", "ARRAY<BIGINT>",
        f"if(octet_length(pattern) BETWEEN 1 AND {_SIZE}, filter(sequence(0L, bigint({_SIZE} - octet_length(pattern))), "
        "at -> substring(binary(line), int(at + 1), octet_length(pattern)) = binary(pattern)), cast(array() AS ARRAY<BIGINT>))",
    ),
    "log_slice": (
        "line STRING, first BIGINT, last BIGINT", "STRING",
        f"string(substring(binary(line), int({_EDGE.format('coalesce(first, 0L)', _SIZE)} + 1), "
        f"int(greatest({_EDGE.format(f'coalesce(last, bigint({_SIZE}))', _SIZE)} - {_EDGE.format('coalesce(first, 0L)', _SIZE)}, 0L))))",
    ),
    "log_until": (
        "line STRING, at BIGINT, pattern STRING, stop STRING", "STRING",
        f"concat(pattern, substring_index(string(substring(binary(line), {_AT})), stop, 1))",
    ),
}


def register_sql(spark: SparkSession) -> list[str]:
    """Make the functions known to ``spark.sql`` as temporary functions; their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)


def register_log(lines: DataFrame, name: str) -> None:
    """Lines as a view, with the functions."""
    register_sql(lines.sparkSession)
    lines.createOrReplaceTempView(name)
